"""The configuration file: rules, volume labels, sources, restore destinations, ignore patterns."""

from __future__ import annotations

import os
import random
import string
import xml.etree.ElementTree as tree
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Config:
    rules: list[str] = field(default_factory=list)
    volumes: list[str] = field(default_factory=list)
    sources: dict[str, str] = field(default_factory=dict)
    restore: dict[str, str] = field(default_factory=dict)
    ignores: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, xml: str) -> Config:
        root = tree.fromstring(xml)
        every = lambda tag: [e.text or "" for e in root.findall(tag)]
        pairs = lambda tag: {e.get("alias", ""): e.get("path", "") for e in root.findall(tag)}
        return cls(every("af"), every("vl"), pairs("src"), pairs("restore"), every("ignore"))

    def to_xml(self) -> str:
        root = tree.Element("xc")
        for tag, values in (("af", self.rules), ("vl", self.volumes)):
            for v in values:
                tree.SubElement(root, tag).text = v
        for tag, pairs in (("src", self.sources), ("restore", self.restore)):
            for alias, path in pairs.items():
                tree.SubElement(root, tag, {"path": path, "alias": alias})
        for v in self.ignores:
            tree.SubElement(root, "ignore").text = v
        tree.indent(root)
        return tree.tostring(root, encoding="unicode")

    @classmethod
    def load(cls, name: str, places: tuple[str, ...] = (".", "~")) -> Config:
        """From the first of the places that has the file; an empty one where none has."""
        for place in places:
            path = os.path.join(os.path.expanduser(place), name)
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    return cls.parse(f.read())
        return cls()

    @classmethod
    def find(cls, name: str, places: tuple[str, ...] = (".", "~")) -> str:
        """Where the file is, or would be written: the last of the places where none has it."""
        at = [os.path.join(os.path.expanduser(p), name) for p in places]
        return next((p for p in at if os.path.exists(p)), at[-1])

    def save(self, path: str) -> None:
        """Writes the file whole, or not at all."""
        part = f"{path}.{os.getpid()}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(self.to_xml())
        os.replace(part, path)

    def set_restore(self, alias: str, path: str = "") -> None:
        """Where an alias is restored to; without a path, where its source lies.  An alias without a source needs a path."""
        if not path:
            if alias not in self.sources:
                raise KeyError(f"no source is called {alias}")
            path = self.sources[alias]
        self.restore[alias] = os.path.normpath(path)

    def remove_restore(self, alias: str) -> bool:
        return self.restore.pop(alias, None) is not None

    def remove_volume(self, label: str) -> bool:
        if label not in self.volumes:
            return False
        self.volumes.remove(label)
        return True

    def add_source(self, alias: str, path: str) -> bool:
        """False where the alias or the path is known."""
        if alias in self.sources or path in self.sources.values():
            return False
        self.sources[alias] = path
        return True

    def remove_source(self, alias: str) -> bool:
        return self.sources.pop(alias, None) is not None

    def add_volume(self, label: str) -> bool:
        if label in self.volumes:
            return False
        self.volumes.append(label)
        return True

    def add_ignore(self, pattern: str) -> bool:
        if pattern in self.ignores:
            return False
        self.ignores.append(pattern)
        return True

    def source_paths(self, arguments: list[str]) -> list[str]:
        """What was asked for, else the configured sources, else here."""
        return arguments or list(self.sources.values()) or ["."]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        pairs = lambda d: spark.createDataFrame(list(d.items()), "alias string, path string")
        listed = lambda values, name: spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, seq int")
        return {"sources": pairs(self.sources), "restore_dests": pairs(self.restore), "volumes": listed(self.volumes, "label"), "ignores": listed(self.ignores, "pattern"), "rules": listed(self.rules, "pattern")}


def new_label(known: set[str], size: int = 8) -> str:
    """Random letters that are no label yet."""
    while (label := "".join(random.choices(string.ascii_letters, k=size))) in known:
        pass
    return label


def volume_label(directory: str, name: str = ".mdbackup.xml") -> str | None:
    """The label of the nearest directory above that has one, without making one."""
    at = os.path.abspath(directory)
    while True:
        path = os.path.join(at, name)
        if os.path.exists(path):
            try:
                return tree.parse(path).getroot().findtext("label") or None
            except tree.ParseError:
                return None
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def ensure_volume_label(directory: str, config: Config, name: str = ".mdbackup.xml") -> str:
    """The label of a volume's own directory; made and written where there is none, or none that can be read, and kept in ``config``."""
    path, label = os.path.join(directory, name), None
    if os.path.exists(path):
        try:
            label = tree.parse(path).getroot().findtext("label") or None
        except tree.ParseError:
            pass
    if label is None:
        label = new_label(set(config.volumes))
        root = tree.Element("vol")
        tree.SubElement(root, "label").text = label
        part = f"{path}.{os.getpid()}.part"
        tree.ElementTree(root).write(part, encoding="unicode")
        os.replace(part, path)
    config.add_volume(label)
    return label
