"""Rounds from events, and samples placed in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of a round without an end.
DEFAULT_LENGTH = 12800


def round_windows(starts: DataFrame, ends: DataFrame, freezes: DataFrame, default_length: int = DEFAULT_LENGTH, span: int = 10_080) -> DataFrame:
    """[start, end) of each start: up to the first end or start after it; the freeze end is the first one after the start, wherever it is.

    The next marks are running minima from the last tick back, within spans of `span` ticks; what lies beyond a span comes from one
    row per (demo, span), so a long recording is many tasks. Rows without a tick are left out.
    """
    marks = starts.select("demo", "tick", "event_id", F.lit("s").alias("kind"))
    for df, kind in ((ends, "e"), (freezes, "f")):
        marks = marks.unionByName(df.select("demo", "tick", F.lit(kind).alias("kind")), allowMissingColumns=True)
    at = lambda kind: F.when(F.col("kind") == kind, F.col("tick"))
    marks = marks.where("tick is not null").withColumn("span", F.floor(F.col("tick") / span))

    totals = marks.groupBy("demo", "span").agg(F.min(at("s")).alias("s"), F.min(at("e")).alias("e"), F.min(at("f")).alias("f"), F.count(at("s")).alias("n"))
    beyond = Window.partitionBy("demo").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("demo").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("demo", "span", *(F.min(c).over(beyond).alias(f"later_{c}") for c in "sef"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    own = Window.partitionBy("demo", "span")
    later = own.orderBy(F.desc("tick")).rangeBetween(Window.unboundedPreceding, -1)
    order = own.orderBy("tick", "event_id")
    marks = marks.withColumns({"next_e": F.min(at("e")).over(later), "next_f": F.min(at("f")).over(later)}).where("kind = 's'")
    marks = marks.withColumns({"next_s": F.lead("tick").over(order), "place": F.row_number().over(order)}).join(totals, ["demo", "span"])
    first = lambda c: F.coalesce(f"next_{c}", f"later_{c}")
    stop = F.coalesce(F.least(first("e"), first("s")), F.col("tick") + default_length)
    return marks.select("demo", (F.col("before") + F.col("place") - 1).alias("round"), F.col("tick").alias("start"), stop.alias("stop"), first("f").alias("freeze_tick"))


def assign_rounds(ticks: DataFrame, rounds: DataFrame, bucket: int = 480, rate: float = 1.0) -> DataFrame:
    """Adds round, seconds_into_round and seconds_after_freeze (-1 and nulls outside of rounds).

    An equi-join on (demo, time bucket), so a long recording is many keys; only rounds are repeated, once per bucket that they touch.
    """
    spread = rounds.where("start < stop").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    t, r = ticks.withColumn("bucket", F.floor(F.col("tick") / bucket)).alias("t"), spread.alias("r")
    on = (F.col("t.demo") == F.col("r.demo")) & (F.col("t.bucket") == F.col("r.bucket")) & (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("stop"))
    joined = t.join(r, on, "left")
    return joined.select(
        *(F.col(f"t.{c}") for c in ticks.columns),
        F.coalesce("r.round", F.lit(-1)).alias("round"),
        ((F.col("tick") - F.col("start")) / rate).alias("seconds_into_round"),
        ((F.col("tick") - F.col("freeze_tick")) / rate).alias("seconds_after_freeze"),
    )


def global_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds numbered through all recordings of a map, in order of recordings."""
    sizes = rounds.groupBy("demo").agg(F.count("*").alias("n")).withColumn("map_id", F.col("demo") % 2)
    before = Window.partitionBy("map_id").orderBy("demo").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("demo", "map_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rounds.join(offsets, "demo").select("map_id", "demo", "round", (F.col("offset") + F.col("round")).alias("round_index"))


def sample_ticks(placed: DataFrame, starts: DataFrame, step: int) -> DataFrame:
    """The samples on the lattice start, start + step, .. of their round. placed has demo, round and tick; starts has demo, round and start."""
    own = starts.select("demo", "round", F.col("start").alias("lattice"))
    return placed.join(own, ["demo", "round"]).where((F.col("tick") - F.col("lattice")) % step == 0).drop("lattice")


def post_freeze_ticks(rounds: DataFrame, window: int = 15, step: int = 32, rate: int = 64) -> DataFrame:
    """(demo, round, tick): each step from the first one after the freeze end, before window * rate ticks from there; rounds without a freeze end have none."""
    first = F.col("freeze_tick") + step
    return rounds.where("freeze_tick is not null").select("demo", "round", F.explode(F.sequence(first, first + window * rate - 1, F.lit(step))).alias("tick"))


def sample_at_offset(ticks: DataFrame, rounds: DataFrame, offset: int = 64) -> DataFrame:
    """The samples at offset ticks after the freeze end of a round, with its number."""
    at = rounds.where("freeze_tick is not null").select("demo", F.col("round").alias("of_round"), (F.col("freeze_tick") + offset).alias("tick"))
    return ticks.join(at, ["demo", "tick"])


def early_samples(placed: DataFrame, window: float) -> DataFrame:
    """Samples from the freeze end to window seconds after it, both included."""
    return placed.where(F.col("seconds_after_freeze").between(0, window))
