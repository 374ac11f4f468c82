"""The rules over a stream: keyed state, event-time timers, late rows aside.

A rule that looks ahead can only speak when the time it looks at has passed. Each key
(user or address) keeps what the rule needs, one entry per second, until the watermark is
one window beyond it; then the rule speaks once and for all, with the verdicts that the
batch rules give for all rows that came in time. What is older than any later verdict
can look back to is dropped, so state holds a few windows of seconds for each key.

Findings name (rule, key, second), because rows of one second are claimed together;
``claimed_lines`` gives them back to the lines. A row older than the watermark is not
used; it becomes a finding of kind ``late`` with its line number. Pending logins of the
travel check are kept row by row, for the time of the watermark's delay only.

A silent log stands still, and so does its watermark: send a heartbeat (a row with a
timestamp that no rule looks at) to make the rules speak about the last rows.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.joins import attach
from logwarden.operators.rules import RULES, privileged_command_lines

# the processors travel to the executors themselves; no package is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELAY = "10 minutes"
FINDINGS = "rule STRING, kind STRING, key STRING, at BIGINT, line_number BIGINT"
_NAMES = [f.split()[0] for f in FINDINGS.split(", ")]
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def burst_verdicts(at: np.ndarray, fails: np.ndarray, oks: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the ascending seconds lies in a burst, and whether its successes follow one."""
    beyond = np.searchsorted(at, at + window, "right")
    sums = np.concatenate([[0], np.cumsum(fails)])
    opens = (fails > 0) & (sums[beyond] - sums[:-1] >= least)
    order = np.arange(len(at))
    last_fail = np.maximum.accumulate(np.where(fails > 0, order, -1))
    last_open = np.maximum.accumulate(np.where(opens, order, -1))
    burst = (fails > 0) & (last_open >= 0) & (at - at[last_open] <= window)
    ends = at[last_fail[beyond - 1]][opens]  # ascending, as the openings are
    nearest = np.searchsorted(ends, at, "right") - 1
    ended = np.append(ends, 0)[nearest]
    return burst, (oks > 0) & (nearest >= 0) & (at - ended <= window)


def fan_out_verdicts(at: list[int], names: list[set], window: int, least: int) -> list[bool]:
    """Whether each of the ascending seconds lies in a span of ``least`` names."""
    inside: Counter = Counter()
    opened, stop, out = None, 0, []
    for i, begin in enumerate(at):
        while stop < len(at) and at[stop] <= begin + window:
            inside.update(names[stop])
            stop += 1
        if len(inside) >= least:
            opened = begin
        out.append(opened is not None and begin - opened <= window)
        for name in names[i]:
            inside[name] -= 1
            if not inside[name]:
                del inside[name]
    return out


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"at": "Int64", "line_number": "Int64"})


class _Rule(StatefulProcessor):
    """State and timers that the rules share; ``window`` and all times in microseconds."""

    name: str
    schema: str
    #: windows that a verdict looks ahead and back
    ahead, back = 1, 2

    def __init__(self, window: int, least: int) -> None:
        self.window, self.least = window, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seconds", self.schema)

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """Ask to be called when the watermark is beyond ``at``."""
        self.handle.registerTimer(int(at) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.load()
        first = None
        for batch in rows:
            late = batch["at"] < mark
            if late.any():
                yield _found([(self.name, "late", key[0], int(a), int(n)) for a, n in batch.loc[late, ["at", "line_number"]].to_numpy()])
            batch = batch[~late]
            if len(batch):
                low = int(batch["at"].min())
                first = low if first is None else min(first, low)
                self.add(kept, batch)
        if first is not None:
            self.save(kept)
            self._wake(first + self.ahead * self.window)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.load()
        done = mark - self.ahead * self.window - 1  # what a verdict looks at has passed
        found = self.decide(kept, done)
        pending, last = self.prune(kept, done - self.back * self.window, done)
        if last is None:
            self.state.clear()
        else:
            self.save(kept)
            self._wake((pending if pending is not None else last + self.back * self.window) + self.ahead * self.window)
        if found:
            yield _found([(self.name, kind, key[0], int(at), line) for kind, at, line in found])


class _Seconds(_Rule):
    """Rules whose state is one entry per second: ``{second: entry}`` and the last second spoken about."""

    def prune(self, kept: dict, oldest: int, done: int) -> tuple[int | None, int | None]:
        for at in [a for a in kept if a != "done" and a < oldest]:
            del kept[at]
        kept["done"] = max(done, kept["done"])
        seconds = [a for a in kept if a != "done"]
        return min((a for a in seconds if a > kept["done"]), default=None), max(seconds, default=None)

    def _ready(self, kept: dict, done: int) -> tuple[list[int], list[bool]]:
        at = sorted(a for a in kept if a != "done")
        return at, [kept["done"] < a <= done for a in at]


class BruteForce(_Seconds):
    name, schema = "brute_force", "at ARRAY<BIGINT>, fails ARRAY<BIGINT>, oks ARRAY<BIGINT>, done BIGINT"

    def load(self) -> dict:
        if not self.state.exists():
            return {"done": -(1 << 62)}
        at, fails, oks, done = self.state.get()
        return {a: [f, o] for a, f, o in zip(at, fails, oks)} | {"done": done}

    def save(self, kept: dict) -> None:
        at = sorted(a for a in kept if a != "done")
        self.state.update((at, [kept[a][0] for a in at], [kept[a][1] for a in at], int(kept["done"])))

    def add(self, kept: dict, batch: pd.DataFrame) -> None:
        for at, (fails, oks) in batch.groupby("at")[["failed", "accepted"]].sum().iterrows():
            entry = kept.setdefault(int(at), [0, 0])
            entry[0] += int(fails)
            entry[1] += int(oks)

    def decide(self, kept: dict, done: int) -> list[tuple]:
        at, ready = self._ready(kept, done)
        if not at:
            return []
        fails, oks = (np.array([kept[a][k] for a in at]) for k in (0, 1))
        burst, follows = burst_verdicts(np.array(at), fails, oks, self.window, self.least)
        return [(kind, a, None) for kind, hit in (("burst", burst), ("follow", follows)) for a, h, r in zip(at, hit, ready) if h and r]


class Enumeration(_Seconds):
    name, schema = "enumeration", "at ARRAY<BIGINT>, users ARRAY<ARRAY<STRING>>, done BIGINT"

    def load(self) -> dict:
        if not self.state.exists():
            return {"done": -(1 << 62)}
        at, users, done = self.state.get()
        return {a: set(u) for a, u in zip(at, users)} | {"done": done}

    def save(self, kept: dict) -> None:
        at = sorted(a for a in kept if a != "done")
        self.state.update((at, [sorted(kept[a]) for a in at], int(kept["done"])))

    def add(self, kept: dict, batch: pd.DataFrame) -> None:
        for at, user in batch[["at", "user"]].drop_duplicates().itertuples(index=False):
            names = kept.setdefault(int(at), set())
            # so many names of one second answer the question whether a span has them
            if user is not None and len(names) < self.least:
                names.add(user)

    def decide(self, kept: dict, done: int) -> list[tuple]:
        at, ready = self._ready(kept, done)
        hits = fan_out_verdicts(at, [kept[a] for a in at], self.window, self.least)
        return [("span", a, None) for a, h, r in zip(at, hits, ready) if h and r]


class Travel(_Rule):
    """Logins wait until no earlier one can come; then only the last one is kept."""

    name, schema = "impossible_travel", "at ARRAY<BIGINT>, line ARRAY<BIGINT>, net ARRAY<STRING>, last_at BIGINT, last_net STRING"
    ahead, back = 0, 1

    def load(self) -> dict:
        if not self.state.exists():
            return {"wait": [], "last": None}
        at, line, net, last_at, last_net = self.state.get()
        return {"wait": list(zip(at, line, net)), "last": None if last_net is None else (last_at, last_net)}

    def save(self, kept: dict) -> None:
        at, line, net = (list(c) for c in zip(*kept["wait"])) if kept["wait"] else ([], [], [])
        self.state.update((at, line, net, *(kept["last"] or (None, None))))

    def add(self, kept: dict, batch: pd.DataFrame) -> None:
        kept["wait"] += [(int(a), int(n), net) for a, n, net in batch[["at", "line_number", "net"]].itertuples(index=False)]

    def decide(self, kept: dict, done: int) -> list[tuple]:
        out = []
        for at, line, net in sorted(w for w in kept["wait"] if w[0] <= done):
            last = kept["last"]
            if last and last[1] != net and at - last[0] <= self.window:
                out.append(("arrival", at, line))
            kept["last"] = (at, net)
        return out

    def prune(self, kept: dict, oldest: int, done: int) -> tuple[int | None, int | None]:
        kept["wait"] = [w for w in kept["wait"] if w[0] > done]
        if kept["last"] and kept["last"][0] < oldest:
            kept["last"] = None
        pending = min((w[0] for w in kept["wait"]), default=None)
        return pending, pending if pending is not None else kept["last"] and kept["last"][0]


def streaming_rules(events: DataFrame, settings: Settings = DEFAULTS, delay: str = DELAY) -> DataFrame:
    """Findings of all rules and of the travel check on a stream of parsed ``events``.

    Rows may be up to ``delay`` older than the newest row seen before.
    """
    failed, accepted = text.is_failed_login(F.col("message")), text.is_accepted_login(F.col("message"))
    timed = events.filter(F.col("timestamp").isNotNull()).withColumn("at", micros(F.col("timestamp")))
    # a copy of the time carries the watermark, so late rows reach the rules instead of vanishing before them
    marked = timed.withColumn("_event_time", F.timestamp_micros("at")).withWatermark("_event_time", delay)
    logins = marked.select(
        "_event_time", "at", "line_number", "user", "source_ip", failed.alias("failed"), accepted.alias("accepted"),
        text.subnet(F.col("source_ip"), settings.travel_prefix_octets).alias("net"))

    def run(wanted: Column, key: str, columns: list[str], processor: _Rule) -> DataFrame:
        # a filter that names the event time is not moved below the watermark, which thus sees heartbeats too
        rows = logins.filter(F.when(F.col("_event_time").isNotNull(), wanted)).select(key, "at", "line_number", *columns)
        return rows.groupBy(key).transformWithStateInPandas(processor, FINDINGS, "Append", "EventTime")

    known, has_ip = F.col("user").isNotNull(), F.col("source_ip").isNotNull()
    burst = run(known & (F.col("failed") | F.col("accepted")), "user", ["failed", "accepted"],
                BruteForce(settings.brute_force_window_minutes * MINUTE, settings.brute_force_min_failures))
    fan_out = run(has_ip & F.col("failed"), "source_ip", ["user"],
                  Enumeration(settings.enumeration_window_minutes * MINUTE, settings.enumeration_min_users))
    travel = run(known & has_ip & F.col("accepted"), "user", ["net"], Travel(settings.travel_window_minutes * MINUTE, 0))
    return burst.unionByName(fan_out).unionByName(travel)


def start_rules(findings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``findings`` to the table at ``path``; a restart with the same checkpoint goes on where the last run ended.

    The state has as many partitions as the session shuffles to when the checkpoint is new.
    """
    findings.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)
    writer = findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def late_lines(findings: DataFrame) -> DataFrame:
    """The side table: ``rule, line_number`` of the rows that came too late for a rule."""
    return findings.filter(F.col("kind") == "late").select("rule", "line_number")


def claimed_lines(events: DataFrame, findings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``rule, line_number`` of the events that the findings claim, the travel check and the stateless rule included."""
    at = micros(F.col("timestamp"))
    rows = events.filter(F.col("timestamp").isNotNull()).select(
        "line_number", "user", "source_ip", at.alias("at"), text.is_failed_login(F.col("message")).alias("failed"),
        text.is_accepted_login(F.col("message")).alias("accepted"))

    def claims(rule: str, key: str, side: DataFrame, kinds: dict[str, str]) -> DataFrame:
        """Lines of ``side`` (one row per line) whose key and second were claimed with the kind that concerns them."""
        seconds = findings.filter((F.col("rule") == rule) & F.col("kind").isin(list(kinds)))
        seconds = seconds.select(F.col("key").alias(key), "at", "kind").distinct()
        sizes = side.groupBy(key, "at").agg(F.count("*").alias("_rows"))
        held = seconds.join(sizes, [key, "at"]).groupBy(key, "at").agg(
            F.collect_set("kind").alias("_kinds"), F.first("_rows").alias("_rows"))
        met = attach(side, held, [key, "at"], how="inner", rows="_rows", settings=settings)
        concerns = F.lit(False)
        for kind, column in kinds.items():
            concerns = concerns | (F.array_contains("_kinds", kind) & F.col(column))
        late = late_lines(findings.filter(F.col("rule") == rule)).select("line_number")
        return met.filter(concerns).select("line_number").join(late, "line_number", "left_anti").select(
            F.lit(rule).alias("rule"), "line_number")

    burst = claims("brute_force", "user", rows.filter(F.col("user").isNotNull() & (F.col("failed") | F.col("accepted"))),
                   {"burst": "failed", "follow": "accepted"})
    fan_out = claims("enumeration", "source_ip", rows.filter(F.col("source_ip").isNotNull() & F.col("failed")), {"span": "failed"})
    travel = findings.filter((F.col("rule") == Travel.name) & (F.col("kind") == "arrival")).select("rule", "line_number")
    privileged = privileged_command_lines(events, settings).select(F.lit("privileged_command").alias("rule"), "line_number")
    assert {"brute_force", "enumeration", "privileged_command"} == set(RULES)
    return burst.unionByName(fan_out).unionByName(travel).unionByName(privileged)
