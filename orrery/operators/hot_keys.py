"""Exact per-key counts, ranks and quantiles where a handful of keys hold most records.

Method: distributed exact selection. For each key a histogram of its values over an interval is counted with
mergeable counts (partial aggregation before the shuffle, by key and bin); the bin that holds a wanted rank
becomes the next interval, until it is a single value. No task ever gathers a key's values: what is shuffled per
round are at most ``bins`` counts for each interval and input partition, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut


@dataclass(frozen=True)
class Selection:
    """bins: of a histogram. salts: copies of the intervals, among which rows of a hot key spread when intervals are
    too many to broadcast. broadcast_rows: intervals up to which they are broadcast, their number being counted."""

    bins: int = 256
    salts: int = 32
    broadcast_rows: int = 100_000


def distinct_members(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Each (keys, member) once, without null members; spread by all of them together, so no key is hot."""
    return df.where(F.col(member).isNotNull()).select(*keys, member).distinct()


def distinct_per_key(df: DataFrame, keys: Sequence[str], member: str, name: str = "n") -> DataFrame:
    """The number of distinct non-null members of each key; null is a key like others; keys without members are missing.

    Repeated rows count once; an empty table gives an empty result; other columns are ignored.
    """
    return distinct_members(df, keys, member).groupBy(*keys).agg(F.count("*").alias(name))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, s: Selection = Selection()) -> DataFrame:
    """The value at wanted ranks of each key, and how many rows of the key have that value.

    ``df`` holds one row per counted entry; ``ranks`` holds the keys and a bigint column ``rank``, from 1. Result:
    keys, ``rank``, ``value`` (bigint), ``below`` (rows with smaller values), ``at`` (rows with this value). Rows with
    a null value are left out; null keys count as keys; ranks beyond a key's rows give no row; repeated ranks give
    one; ties share one value. ``value`` must be of an integer type and lie within 62 bits. ``df`` is read once per round, and rounds are
    few: the logarithm of the value range to the base ``bins``.
    """
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(value).cast("long").alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    wanted = ranks.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col("rank").cast("long").alias("rank")).where("rank >= 1").distinct()
    spans = rows.groupBy(*names).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    on = _same(wanted, spans, names)
    current = wanted.join(spans, on).where("rank <= n").select(*[wanted[c] for c in names], "rank", "low", "high", F.lit(0).cast("long").alias("below"), "n")
    current = cut(current)
    while True:
        open_ = current.where("low < high")
        intervals = open_.select(*names, "low", "high").distinct()
        count = intervals.count()
        if not count:
            break
        counts = _histogram(rows, intervals, names, count, s)
        order = Window.partitionBy(*names, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
        found = open_.alias("o").join(counts.alias("h"), _same_alias("o", "h", [*names, "low", "high"]) & (F.col("o.rank") > F.col("o.below") + F.col("h.before")) & (F.col("o.rank") <= F.col("o.below") + F.col("h.before") + F.col("h.c")))
        width = _width(F.col("o.low"), F.col("o.high"), s.bins)
        low = F.col("o.low") + F.col("h.bin") * width
        found = found.select(
            *[F.col(f"o.{c}").alias(c) for c in names], F.col("o.rank").alias("rank"), low.alias("low"), F.least(low + width - 1, F.col("o.high")).alias("high"),
            (F.col("o.below") + F.col("h.before")).alias("below"), F.col("h.c").alias("n"),
        )
        current = cut(current.where("low = high").unionByName(found))
    return current.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "rank", F.col("low").alias("value"), "below", F.col("n").alias("at"))


def _same_alias(a: str, b: str, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def _width(low: Column, high: Column, bins: int) -> Column:
    """Values per bin, so that ``bins`` bins reach from low to high; 1 once they are no more than the bins."""
    return F.ceil((high - low + 1) / bins).cast("long")


def _histogram(rows: DataFrame, intervals: DataFrame, names: Sequence[str], count: int, s: Selection) -> DataFrame:
    """(names, low, high, bin, c): counts of the rows in each interval, by bin."""
    if count <= s.broadcast_rows:
        on = _same_alias("r", "i", names)
        joined = rows.alias("r").join(F.broadcast(intervals.alias("i")), on & F.col("r.v").between(F.col("i.low"), F.col("i.high")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(s.salts)))
        copies = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1)).cast("array<bigint>")))
        joined = salted.alias("r").join(copies.alias("i"), _same_alias("r", "i", [*names, "salt"]) & F.col("r.v").between(F.col("i.low"), F.col("i.high")))
    at = F.floor((F.col("r.v") - F.col("i.low")) / _width(F.col("i.low"), F.col("i.high"), s.bins)).cast("long")
    named = joined.select(*[F.col(f"i.{c}").alias(c) for c in names], F.col("i.low").alias("low"), F.col("i.high").alias("high"), at.alias("bin"))
    return named.groupBy(*names, "low", "high", "bin").agg(F.count("*").alias("c"))


def quantiles_per_key(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], s: Selection = Selection()) -> DataFrame:
    """Exact discrete quantiles of each key: keys, ``share``, ``value``, the smallest value with at least that share of
    the key's non-null values at or below it; share 0 gives the smallest. Keys without a value are missing."""
    if not all(0 <= x <= 1 for x in shares):
        raise ValueError("shares must lie between 0 and 1")
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    asked = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    asked = cut(asked.select(*keys, "share", F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("n"), 6))).cast("long").alias("rank")))
    found = select_ranks(df, keys, value, asked, s)
    return asked.alias("a").join(found.alias("f"), _same_alias("a", "f", [*keys, "rank"])).select(*[F.col(f"a.{c}").alias(c) for c in keys], "share", "value")


def heavy_values(df: DataFrame, keys: Sequence[str], value: str, member: str, share: float, s: Selection = Selection()) -> DataFrame:
    """The values that hold more than ``share`` of a key's distinct members: keys, ``value``, ``members``, ``of``.

    With d distinct members of a key, a value holding more than share * d of them covers, in the order of values, a
    run of more than share * d ranks, hence one of the ranks at that distance from each other; these ranks are
    selected exactly. A null value holds members of its key (they count in ``of``) but isn't reported.
    Members that are null count nowhere; repeated rows count once; an empty table gives an empty result.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    entries = cut(distinct_members(df, [*keys, value], member))
    of = entries.select(*keys, member).distinct().groupBy(*keys).agg(F.count("*").alias("of"))
    held = entries.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("held"))
    step = F.floor(F.round(F.lit(share) * F.col("of"), 6)) + 1
    steps = of.alias("a").join(held.alias("b"), _same_alias("a", "b", keys)).select(*[F.col(f"a.{c}").alias(c) for c in keys], "of", "held", step.alias("step"))
    steps = cut(steps)
    ranks = steps.where("held >= step").select(*keys, F.explode(F.sequence(F.col("step"), F.col("held"), F.col("step"))).alias("rank"))
    found = select_ranks(entries, keys, value, ranks, s).select(*keys, "value", "at").distinct()
    both = found.alias("f").join(steps.alias("s"), _same_alias("f", "s", keys)).where(F.col("f.at") >= F.col("s.step"))
    return both.select(*[F.col(f"f.{c}").alias(c) for c in keys], F.col("f.value").alias("value"), F.col("f.at").alias("members"), F.col("s.of").alias("of"))
