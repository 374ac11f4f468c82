"""Runs that share one background, kept as one copy of it and the rows of each run's own.

A run (seed, condition) is the whole background with its own attack and noise rows
merged in. The background is sorted, numbered, parsed and judged once; what a run
adds moves its line numbers by a step function and can change verdicts only near
its own rows: a rule looks at rows of one key within a fixed time. So each rule is
evaluated on the background and, for every run, on the rows around its own ones
again. ``expand`` gives the plain table of all lines of all runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.injection import LABELLED, corpus_order
from logwarden.operators.joins import attach
from logwarden.operators.ordering import number_rows
from logwarden.operators.rules import RULES, fired_rules
from logwarden.operators.spans import AT
from logwarden.operators.travel import travel_lines
from logwarden.plans.detection import flag_lines
from logwarden.session import settle

RUN = ("seed", "condition")
TRAVEL = "impossible_travel"
_AT_RUN, _SEGMENT, _SHIFT, _BITS, _FLIPS, _SLOT = "_run", "_segment", "_shift", "_bits", "_flips", "_slot"
_PART = "_part"


@dataclass(frozen=True)
class RunMatrix:
    """``shared``: ``rank, _segment`` and columns of the background; ``own``: run, ``_run, line_number`` and the same columns.

    A background row stands in run number r at line ``rank + shifts[r]`` of its segment,
    the rows between two neighbouring rows that any run adds.
    """

    runs: tuple[tuple[int, str], ...]
    shared: DataFrame
    own: DataFrame
    shifts: DataFrame

    def each(self, change: Callable[[DataFrame], DataFrame]) -> RunMatrix:
        """``change`` works on single rows and keeps the columns it does not know."""
        return replace(self, shared=settle(change(self.shared)), own=settle(change(self.own)))

    def only(self, conditions: Sequence[str]) -> list[int]:
        return [at for at, (_, condition) in enumerate(self.runs) if condition in conditions]

    def expand(self, columns: Sequence[str], own: DataFrame | None = None, conditions: Sequence[str] | None = None) -> DataFrame:
        """All lines of all runs, or of those under ``conditions``: run, ``line_number`` and ``columns``."""
        own = self.own if own is None else own
        placed = attach(self.shared, self.shifts, [_SEGMENT], how="inner")
        kept = [c for c in (_BITS, _FLIPS) if c in self.shared.columns]
        lines = placed.select("rank", *[c for c in columns if c in self.shared.columns], *[c for c in kept if c not in columns],
                              F.posexplode("shifts").alias(_AT_RUN, _SHIFT))
        if conditions is not None:
            lines = lines.filter(F.col(_AT_RUN).isin(self.only(conditions)))
            own = own.filter(F.col("condition").isin(list(conditions)))
        if _FLIPS in kept:
            lines = lines.withColumn(_BITS, _flipped(F.col(_BITS), F.col(_FLIPS), F.col(_AT_RUN)))
        line = (F.col("rank") + F.col(_SHIFT)).alias("line_number")
        wanted = [*columns, *([_BITS] if _BITS in kept else [])]
        return lines.select(*self.run_of(F.col(_AT_RUN)), line, *wanted).unionByName(own.select(*RUN, "line_number", *wanted))

    def tally(self, columns: Sequence[str], conditions: Sequence[str] | None = None) -> DataFrame:
        """Lines of all runs, or of those under ``conditions``, counted: run, ``columns`` and ``n``.

        Equal to grouping ``expand``, but the background is counted once, not once a run:
        every run gets its counts, then moves the rows whose verdicts differ there.
        """
        kept = [c for c in (_BITS,) if c in self.shared.columns and c not in columns]
        by = [*columns, *kept]
        runs = self.shared.sparkSession.range(len(self.runs)).select(F.col("id").cast("int").alias(_AT_RUN))
        own = self.own
        if conditions is not None:
            runs = runs.filter(F.col(_AT_RUN).isin(self.only(conditions)))
            own = own.filter(F.col("condition").isin(list(conditions)))
        names = [f"_by{at}" for at in range(len(by))]
        renamed = [F.col(c).alias(n) for c, n in zip(by, names)]
        once = settle(self.shared.groupBy(*renamed).agg(F.count("*").alias("n")))
        counts = once.crossJoin(F.broadcast(runs)).select(_AT_RUN, *names, "n")  # one row per run
        if _FLIPS in self.shared.columns:
            flipped = self.shared.filter(F.col(_FLIPS).isNotNull()).select(*by, F.explode(_FLIPS).alias("_flip"))
            moved = [F.col("_flip.run").alias(_AT_RUN)]
            before = flipped.select(*moved, *renamed, F.lit(-1).cast("bigint").alias("n"))
            after = flipped.withColumn(_BITS, F.col(_BITS).bitwiseXOR(F.col("_flip.bits"))).select(
                *moved, *renamed, F.lit(1).cast("bigint").alias("n"))
            counts = counts.unionByName(before.unionByName(after).join(F.broadcast(runs), _AT_RUN, "left_semi"))
        named = counts.select(*self.run_of(F.col(_AT_RUN)), *names, "n")
        every = named.unionByName(own.select(*RUN, *renamed, F.lit(1).cast("bigint").alias("n")))
        summed = every.groupBy(*RUN, *names).agg(F.sum("n").alias("n")).filter("n != 0")
        return summed.select(*RUN, *[F.col(n).alias(c) for c, n in zip(by, names)], "n")

    def by_verdicts(self) -> tuple[RunMatrix, RunMatrix]:
        """Rows of the background that are judged alike in every run; those that are not, and the rows that runs add."""
        alike = F.col(_FLIPS).isNull()
        return (replace(self, shared=self.shared.filter(alike), own=self.own.limit(0)),
                replace(self, shared=self.shared.filter(~alike)))

    def place(self) -> Column:
        """Where a row of the background stands; places sort as lines do in every run."""
        return F.struct("rank", _SEGMENT)

    def in_runs(self, rows: DataFrame, place: Column, name: str) -> DataFrame:
        """Add ``name``: the lines of ``place`` in all runs, in their order."""
        placed = rows.withColumns({"_rank": place["rank"], _SEGMENT: place[_SEGMENT]})
        found = attach(placed, self.shifts, [_SEGMENT], how="inner")
        return found.withColumn(name, F.transform("shifts", lambda by: F.col("_rank") + by)).drop("_rank", _SEGMENT, "shifts")

    def run_of(self, at: Column) -> list[Column]:
        seeds = F.array(*[F.lit(int(s)).cast("bigint") for s, _ in self.runs])
        names = F.array(*[F.lit(c) for _, c in self.runs])
        return [F.get(seeds, at).alias("seed"), F.get(names, at).alias("condition")]


def _flipped(bits: Column, flips: Column, at: Column) -> Column:
    """``bits`` of a run; ``flips`` are (run, bits that differ), null for nearly all rows."""
    mine = F.aggregate(flips, F.lit(0), lambda total, f: F.when(f["run"] == at, f["bits"]).otherwise(total))
    return F.when(flips.isNull(), bits).otherwise(bits.bitwiseXOR(mine))


def lay_out(background: DataFrame, attacks: DataFrame, runs: Sequence[tuple[int, str]]) -> RunMatrix:
    """Merge ``attacks`` (with their run) into ``background`` (without): one sort for all runs."""
    runs = tuple(runs)
    at = reduce(lambda found, n: F.when((F.col("seed") == runs[n][0]) & (F.col("condition") == runs[n][1]), n).otherwise(found),
                range(len(runs)), F.lit(None).cast("int"))
    columns = [c for c in LABELLED if c not in RUN]
    absent = [F.lit(None).cast(attacks.schema[c].dataType).alias(c) for c in columns if c not in background.columns]
    plain = background.select("*", *absent).select(
        F.lit(None).cast("bigint").alias("seed"), F.lit(None).cast("string").alias("condition"), *columns,
        F.lit(None).cast("int").alias(_AT_RUN), F.lit(False).alias("_own"))
    every = plain.unionByName(attacks.select(*RUN, *columns, at.alias(_AT_RUN), F.lit(True).alias("_own")))
    placed = settle(_counted(every, corpus_order()))

    # rows of a run that is not among runs have no background before them
    own = placed.filter("_own").withColumn("_background", F.when(F.col(_AT_RUN).isNull(), 0).otherwise(F.col("rank")))
    nth = F.row_number().over(Window.partitionBy(*RUN).orderBy(_SEGMENT))
    own = settle(own.withColumn("line_number", F.col("_background") + nth).drop("_own", "_background", "rank"))
    steps = own.filter(F.col(_AT_RUN).isNotNull()).select(_AT_RUN, F.col(_SEGMENT).alias("_from"))
    spark = background.sparkSession
    first = spark.range(len(runs)).select(F.col("id").cast("int").alias(_AT_RUN), F.lit(0).cast("bigint").alias("_from"))
    last = own.agg(F.coalesce(F.max(_SEGMENT), F.lit(0))).first()[0]
    order = Window.partitionBy(_AT_RUN).orderBy("_from")  # the rows that one run adds
    spans = steps.unionByName(first).select(
        _AT_RUN, "_from", (F.row_number().over(order) - 1).cast("bigint").alias(_SHIFT),
        F.coalesce(F.lead("_from").over(order) - 1, F.lit(last)).alias("_to"))
    segments = spans.select(_AT_RUN, _SHIFT, F.explode(F.sequence("_from", "_to")).alias(_SEGMENT))
    shifts = segments.groupBy(_SEGMENT).agg(F.array_sort(F.collect_list(F.struct(_AT_RUN, _SHIFT))).alias("_all"))
    shared = placed.filter("not _own").drop(*RUN, _AT_RUN, "_own")
    return RunMatrix(runs, shared, own.drop(_SEGMENT), settle(shifts.select(_SEGMENT, F.col(f"_all.{_SHIFT}").alias("shifts"))))


def _counted(every: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rank``: rows of the background up to this one; ``_segment``: rows of any run up to this one."""
    numbered = number_rows(every, order, "_place")
    own = settle(numbered.filter("_own").select("_place"))
    # rows that runs add are few beside the background: numbered apart, then handed down the order
    nth = number_rows(own, ["_place"], "_nth")
    width = 1 << 16
    marks = nth.groupBy(F.floor((F.col("_place") - 1) / width).alias(_PART)).agg(
        F.array_sort(F.collect_list("_place")).alias("_places"), F.min("_nth").alias("_first"))
    parts = numbered.select(F.floor((F.col("_place") - 1) / width).alias(_PART)).distinct().join(marks, _PART, "left")
    before = F.last(F.col("_first") + F.size("_places") - 1, ignorenulls=True).over(
        Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))  # one row per 65,536 rows
    known = parts.select(_PART, F.coalesce("_places", F.array().cast("array<bigint>")).alias("_places"),
                         F.coalesce(before, F.lit(0)).alias("_before"))
    dealt = attach(numbered.withColumn(_PART, F.floor((F.col("_place") - 1) / width)), known, [_PART], how="inner")
    place = F.col("_place")
    upto = F.when(F.size("_places") == 0, 0).otherwise(F.size(F.filter("_places", lambda p: p <= place)))
    return dealt.withColumn(_SEGMENT, F.col("_before") + upto).withColumn("rank", place - F.col(_SEGMENT)).drop(
        _PART, "_places", "_before", "_place")


# --- verdicts

def _near(matrix: RunMatrix, rows: Callable[[DataFrame], DataFrame], key: str, reach: int) -> DataFrame:
    """Rows of the background that a run's own rows of the same key may touch, with what surrounds them, and those rows.

    Time is cut into slots of ``reach``: a row touches its slot and both neighbours, and
    two slots on either side hold all that verdicts there depend on.
    """
    slot = F.floor(micros(F.col("timestamp")) / reach)
    known = F.col("timestamp").isNotNull() & F.col(key).isNotNull()
    own = rows(matrix.own).filter(known)
    around = own.filter(F.col(_AT_RUN).isNotNull()).select(
        _AT_RUN, key, slot.alias("_at_slot"), F.explode(F.sequence(slot - 2, slot + 2)).alias(_SLOT))
    stops = around.groupBy(_AT_RUN, key, _SLOT).agg(F.min(F.abs(F.col("_at_slot") - F.col(_SLOT))).alias("_away"))
    # an entry for every run
    stops = stops.groupBy(key, _SLOT).agg(F.collect_list(F.struct(_AT_RUN, (F.col("_away") <= 1).alias("touched"))).alias("_stops"))
    met = attach(rows(matrix.shared).filter(known).withColumn(_SLOT, slot), stops, [key, _SLOT], how="inner")
    columns = ["timestamp", "user", "source_ip", "message"]
    placed = attach(met.drop(_SLOT), matrix.shifts, [_SEGMENT], how="inner").select(
        "rank", _BITS, *columns, "shifts", F.explode("_stops").alias("_stop"))
    run = F.col(f"_stop.{_AT_RUN}")
    near = placed.select(*matrix.run_of(run), run.alias(_AT_RUN), (F.col("rank") + F.get("shifts", run)).alias("line_number"),
                         "rank", _BITS, F.col("_stop.touched").alias("touched"), *columns)
    mine = own.select(*RUN, _AT_RUN, "line_number", F.lit(None).cast("bigint").alias("rank"), F.lit(0).alias(_BITS),
                      F.lit(True).alias("touched"), *columns)
    return settle(near.unionByName(mine))


def _bit(name: str) -> int:
    return 1 << [*RULES, TRAVEL].index(name)


def _bits(rules_fired: Column, travel: Column) -> Column:
    named = F.split(rules_fired, ",")
    bits = [F.when(F.array_contains(named, name), _bit(name)).otherwise(0) for name in RULES]
    return reduce(lambda a, b: a + b, bits) + F.when(travel, _bit(TRAVEL)).otherwise(0)


def with_verdicts(lines: DataFrame) -> DataFrame:
    """``rules_fired`` and ``impossible_travel`` in place of ``_bits``."""
    names = [",".join(n for n in RULES if bits & _bit(n)) for bits in range(1 << len(RULES))]
    rules = F.get(F.array(*map(F.lit, names)), F.col(_BITS).bitwiseAND(F.lit(len(names) - 1)))
    return lines.withColumns({"rules_fired": rules, TRAVEL: F.col(_BITS).bitwiseAND(F.lit(_bit(TRAVEL))) > 0}).drop(_BITS)


def judge(matrix: RunMatrix, settings: Settings = DEFAULTS) -> RunMatrix:
    """Rules and the travel check on every run: ``expand`` gives ``_bits``, see ``with_verdicts``.

    ``matrix`` holds parsed lines. The verdicts equal those of ``flag_lines`` over all lines of all runs.
    """
    base = matrix.shared.withColumnRenamed("rank", "line_number")
    marked = flag_lines(base, base, settings).withColumn(_BITS, _bits(F.col("rules_fired"), F.col(TRAVEL)))
    shared = settle(marked.drop("rules_fired", TRAVEL).withColumnRenamed("line_number", "rank"))
    judged = replace(matrix, shared=shared)

    def logins(rows: DataFrame) -> DataFrame:
        return rows.filter(text.is_failed_login(F.col("message")) | text.is_accepted_login(F.col("message")))

    window = {"brute_force": 2 * settings.brute_force_window_minutes, "enumeration": settings.enumeration_window_minutes,
              TRAVEL: settings.travel_window_minutes}
    by_user = _near(judged, logins, "user", max(window["brute_force"], window[TRAVEL], 1) * MINUTE)
    by_ip = _near(judged, logins, "source_ip", max(window["enumeration"], 1) * MINUTE)
    claims = [
        (by_user, "brute_force", RULES["brute_force"](by_user, settings, RUN)),
        (by_user, TRAVEL, travel_lines(by_user, settings, RUN)),
        (by_ip, "enumeration", RULES["enumeration"](by_ip, settings, RUN)),
    ]
    key, flips, hits = [*RUN, "line_number"], [], []
    for near, name, lines in claims:
        found = settle(lines.distinct().withColumn("_claimed", F.lit(True)))
        seen = attach(near.filter("touched"), found, key).withColumn("_claimed", F.col("_claimed").isNotNull())
        was = F.col(_BITS).bitwiseAND(F.lit(_bit(name))) > 0
        flips.append(seen.filter(F.col("rank").isNotNull() & (was != F.col("_claimed"))).select(
            "rank", _AT_RUN, F.lit(_bit(name)).alias("bits")))
        hits.append(seen.filter(F.col("rank").isNull() & F.col("_claimed")).select(*key, F.lit(_bit(name)).alias("bits")))
    single = {n: r for n, r in RULES.items() if n not in window}
    alone = fired_rules(matrix.own, settings, RUN, single)
    hits.append(alone.select(*key, _bits(F.col("rules_fired"), F.lit(False)).alias("bits")))

    per_run = reduce(DataFrame.unionByName, flips).groupBy("rank", _AT_RUN).agg(F.sum("bits").cast("int").alias("bits"))
    # an entry for every run
    per_row = per_run.groupBy("rank").agg(F.collect_list(F.struct(F.col(_AT_RUN).alias("run"), "bits")).alias(_FLIPS))
    own_bits = reduce(DataFrame.unionByName, hits).groupBy(*key).agg(F.sum("bits").cast("int").alias(_BITS))
    own = attach(matrix.own, own_bits, key).fillna(0, [_BITS])
    return replace(judged, shared=settle(attach(shared, per_row, ["rank"])), own=settle(own))
