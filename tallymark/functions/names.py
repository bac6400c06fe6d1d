"""Cleaning of file names."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extensions that renaming may touch.
KNOWN_EXTENSIONS = ("go", "jpg", "gif", "jpeg", "wmv", "flv", "mov", "mp4", "mpg")
_ANY = "[.](" + "|".join(KNOWN_EXTENSIONS) + ")"


def same_name(name: Column, other: str | Column) -> Column:
    """Whether two names are equal but for case."""
    return F.lower(name) == F.lower(F.lit(other) if isinstance(other, str) else other)


def has_known_extension(name: Column) -> Column:
    return name.rlike(f"{_ANY}$")


def last_extension(name: Column) -> Column:
    """The rightmost known extension with its dot; empty without one."""
    return F.regexp_extract(name, f"({_ANY})$", 1)


def strip_extensions(name: Column) -> Column:
    """Without all known extensions at the end."""
    return F.regexp_replace(name, f"({_ANY})+$", "")


def strip_number(name: Column) -> Column:
    """Without a bracketed number at the end."""
    return F.regexp_replace(name, "[(][0-9]+[)]$", "")


def squeeze(name: Column) -> Column:
    """Runs of dots and of spaces become one; then one dot and one space at the end go."""
    name = F.regexp_replace(F.regexp_replace(name, "[.]{2,}", "."), " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(name, "[.]$", ""), " $", "")


def valid_rules(rules: Sequence[str]) -> list[re.Pattern]:
    """The rules that compile and have one or two groups; others are left out."""
    out = []
    for rule in rules:
        try:
            pattern = re.compile(rule)
        except re.error:
            continue
        if pattern.groups in (1, 2):
            out.append(pattern)
    return out


def load_rules(lines: DataFrame, column: str = "value") -> list[str]:
    """The valid rules of a rules file, one a line, without blank lines and comments; a file of rules is a driver's table."""
    from ..operators.filters import rule_lines

    return [r.pattern for r in valid_rules([row[column].strip() for row in rule_lines(lines, column).select(column).collect()])]


def apply_rules(name: str | None, rules: Sequence[re.Pattern], rounds: int = 100) -> str | None:
    """Replaces the name by the groups of a rule that it matches, over and over, until nothing changes or after ``rounds``."""
    for _ in range(rounds if name is not None else 0):
        before = name
        for rule in rules:
            if m := rule.search(name):
                name = "".join(g or "" for g in m.groups())
        if name == before:
            break
    return name


def rename_by_rules(name: Column, rules: Sequence[str]) -> Column:
    """:func:`apply_rules` by Arrow batches: a fixed point has no expression in SQL."""
    patterns = valid_rules(rules)

    @F.pandas_udf("string")
    def renamed(names: pd.Series) -> pd.Series:
        known = {n: apply_rules(n, patterns) for n in names.unique()}
        return names.map(known)

    return renamed(name)


def pair_score(dir0: Column, name0: Column, dir1: Column, name1: Column) -> Column:
    """Merit of the first of two equal files: longer directory +2, under "to" -2, longer name -1, under "favs" +2."""
    from .paths import has_segment

    term = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    return term(F.octet_length(dir0) > F.octet_length(dir1), 2) - term(has_segment(dir0, "to"), 2) - term(F.octet_length(name0) > F.octet_length(name1), 1) + term(has_segment(dir0, "favs"), 2)


def is_volume_id(label: Column) -> Column:
    """A UUID."""
    return label.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
