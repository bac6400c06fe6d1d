"""Throughput samples and what the number of copy tokens should be."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from . import scan

#: Percent changes that count, as the decisions have always applied them.
EXPLORE, HYSTERESIS, DROP = 0.01, 0.02, -1.0


def throughput(samples: DataFrame, every: str = "1 hour") -> DataFrame:
    """Bytes a second in each window of time and for each number of tokens; windows without bytes are left out."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    w = samples.groupBy(F.window("ts", every).alias("w"), "tokens").agg(F.sum("bytes").alias("bytes"))
    return w.filter("bytes > 0").select(F.col("w.start").alias("ts"), "tokens", (F.col("bytes") / seconds).alias("throughput"))


def changes(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With the percent change from the one before, by ``seq``, within ``by``; without ``by`` the whole table is one series, of any length."""
    if by:
        s = series.withColumn("_p", F.lag("throughput").over(Window.partitionBy(*by).orderBy("seq")))
    else:
        s = scan.before(series, [F.col("seq").asc()], F.col("throughput"), "_p")
    return s.withColumn("change", (F.col("throughput") - F.col("_p")) / F.col("_p") * 100).drop("_p")


def best_so_far(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With the best throughput up to each row, and the tokens of the first row that reached it; without ``by`` the whole table is one series, of any length."""
    value = F.struct("throughput", (-F.col("seq")).alias("s"), "tokens")
    if by:
        s = series.withColumn("_b", F.max(value).over(Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        s = scan.largest_so_far(series, [F.col("seq").asc()], value, "_b")
    return s.withColumns({"best": F.col("_b.throughput"), "best_tokens": F.col("_b.tokens")}).drop("_b")


def decision(change: Column, tokens: Column, previous_tokens: Column, current: Column, best: Column, best_tokens: Column, throughput: Column, most: int) -> Column:
    """One step: struct(action, tokens).  Explores while a new token helps, freezes on a drop, else asks for more than the best."""
    act = lambda name, n: F.struct(F.lit(name).alias("action"), n.cast("int").alias("tokens"))
    more = F.when(current >= most, act("hold", current)).otherwise(act("increase", current + 1))
    above = (throughput - best) / best * 100
    return F.when(change.isNull(), more).when((tokens > previous_tokens) & (change > EXPLORE), more).when(change < DROP, act("freeze", best_tokens)).when(above > HYSTERESIS, more).otherwise(act("hold", current))


def simple_decision(change: Column, current: Column, best_tokens: Column, most: int) -> Column:
    """One step: up on more than +1 %, freeze below -1 %, else hold."""
    act = lambda name, n: F.struct(F.lit(name).alias("action"), n.cast("int").alias("tokens"))
    more = F.when(current >= most, act("hold", current)).otherwise(act("increase", current + 1))
    return F.when(change.isNull(), more).when(change > 1, more).when(change < -1, act("freeze", best_tokens)).otherwise(act("hold", current))


def step(history: list[tuple[int, float]], current: int, last: int, best: float, best_tokens: int, most: int, frozen: bool) -> tuple[str, int]:
    """The decision of :func:`decision` for plain numbers; history: (tokens, throughput)."""
    more = ("hold", current) if current >= most else ("increase", current + 1)
    if frozen:
        return "hold", current
    if len(history) < 2:
        return more
    (_, before), (tokens, now) = history[-2:]
    change = (now - before) / before * 100
    if tokens > last and change > EXPLORE:
        return more
    if change < DROP:
        return "freeze", best_tokens
    return more if (now - best) / best * 100 > HYSTERESIS else ("hold", current)


def _decide(state: tuple, tokens: int, value: float, most: int) -> tuple[tuple, str, int]:
    """The next state (current, last, best, best_tokens, frozen, tokens and throughput before), action and tokens."""
    current, last, best, best_tokens, frozen, *before = state
    if value > best:
        best, best_tokens = value, tokens
    history = [(int(before[0]), before[1]), (tokens, value)] if before[0] else [(tokens, value)]
    action, now = step(history, current, last, best, best_tokens, most, frozen)
    return (now, tokens, best, best_tokens, frozen or action == "freeze", tokens, value), action, now


class Tuner:
    """The loop of :func:`feedback` for one run that is under way: how many tokens (copies at a time) the next stretch of it has.

    Throughput is bytes a second; a stretch without bytes or without duration
    teaches nothing.  Once a drop has frozen it, the number stays.
    """

    def __init__(self, start: int = 1, most: int = 16):
        self.most = max(1, most)
        self._state = (min(start, self.most), 0, 0.0, min(start, self.most), False, 0, 0.0)
        self.decisions: list[tuple[int, float, str, int]] = []

    @property
    def tokens(self) -> int:
        return self._state[0]

    def hear(self, size: int, seconds: float) -> str:
        """The decision after a stretch: increase, hold or freeze."""
        if size <= 0 or seconds <= 0:
            return "hold"
        used, value = self.tokens, size / seconds
        self._state, action, now = _decide(self._state, used, value, self.most)
        self.decisions.append((used, value, action, now))
        return action


def feedback(series: DataFrame, by: str, start: int = 1, most: int = 16) -> DataFrame:
    """The tuner run over each series of (by, seq, tokens, throughput): every decision depends on the ones before, so a series passes one task, sorted; seven numbers are held."""
    kind = series.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ()
        for batch in batches:
            out = []
            for k, seq, tokens, value in batch[[by, "seq", "tokens", "throughput"]].itertuples(index=False):
                if not state or k != key:
                    key, state = k, (start, 0, 0.0, start, False, 0, 0.0)
                state, action, now = _decide(state, tokens, value, most)
                out.append((k, seq, action, now))
            yield pd.DataFrame(out, columns=[by, "seq", "action", "tokens"])

    sorted_ = series.select(by, "seq", "tokens", "throughput").repartition(by).sortWithinPartitions(by, "seq")
    return sorted_.mapInPandas(run, f"{by} {kind}, seq long, action string, tokens int")


def stream_feedback(samples: DataFrame, by: str, start: int = 1, most: int = 16) -> DataFrame:
    """The tuner as a stream of (by, seq, tokens, throughput): a decision for each sample; the state of a series is seven numbers.

    Samples of a batch are taken in the order of ``seq``; batches must come in
    that order: one that is late is decided when it comes, as the latest.
    """
    kind = samples.schema[by].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = kept.get if kept.exists else (start, 0, 0.0, start, False, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("seq")  # the new samples of one series
        out = []
        for seq, tokens, value in rows[["seq", "tokens", "throughput"]].itertuples(index=False):
            state, action, now = _decide(state, int(tokens), float(value), most)
            out.append((key[0], seq, action, now))
        kept.update(tuple(x.item() if hasattr(x, "item") else x for x in state))
        yield pd.DataFrame(out, columns=[by, "seq", "action", "tokens"])

    state = "now int, last int, best double, best_tokens int, frozen boolean, tokens int, throughput double"
    return samples.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, seq long, action string, tokens int", state, "append", "NoTimeout")
