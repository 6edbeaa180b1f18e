"""Mixing sources to target shares of the tokens by systematic sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.tokens import Tokenizer, counted
from orrery.session import cut


@dataclass(frozen=True)
class Mixing:
    """size: tokens aimed at, as a share of those of all documents of the target sources; None for as many as leave every
    source that has any tokens its share. least: the share that the mix has at least if ``size`` is None, should one source be tiny.
    offsets: random offsets of a source tried, of which the one that comes nearest to its goal is taken. bin_rows:
    documents of one source and length that are ranked in a task."""

    size: float | None = None
    least: float = 0.1
    offsets: int = 32
    bin_rows: int = 200_000
    salt: int = 5


def source_key(source: Column) -> Column:
    """A source as compared: trimmed and in lower case."""
    return F.lower(F.trim(source))


def goals(targets: DataFrame) -> DataFrame:
    """One row per source of the targets; of repeated rows the largest share and repeats count.

    Rows without source are left out; a null share or repeats counts as 0.
    """
    rows = targets.select(source_key(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"))
    return rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(sized: DataFrame, targets: DataFrame, m: Mixing = Mixing()) -> DataFrame:
    """Per target source its tokens, what it shall give, its copies per document, and whether it must fall short.

    A source falls short that has fewer tokens than its share of those of all documents, each counted once, even
    with every document used ``max_repeats`` times. Where the mix had that size the others would make up for
    it; so it is cut back to the size at which the scarcest source that has any just reaches its share.
    """
    wanted = goals(targets)
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    both = wanted.join(have, "source", "left").na.fill(0, ["tokens", "documents"])
    most = (F.col("max_repeats") * F.col("tokens")).cast("double")
    reached = F.min(F.when((most > 0) & (F.col("target_share") > 0), most / F.col("target_share")))
    size = F.lit(m.size) * F.sum("tokens") if m.size is not None else F.greatest(F.lit(m.least) * F.sum("tokens"), F.least(F.sum("tokens").cast("double"), reached))
    total = both.agg(F.sum("tokens").alias("total"), F.coalesce(size.cast("double"), F.lit(0.0)).alias("size"))  # one row
    both = both.crossJoin(F.broadcast(total)).withColumn("given", F.least(F.col("target_share") * F.col("size"), most))
    return both.select(
        "source", "target_share", "max_repeats", "tokens", "documents", F.round("given").cast("long").alias("goal_tokens"), (most < F.col("target_share") * F.col("total")).alias("falls_short"),
        F.when(F.col("tokens") > 0, F.col("given") / F.col("tokens")).otherwise(0.0).alias("copies"),
    )


def emitted(sized: DataFrame, planned: DataFrame, m: Mixing) -> DataFrame:
    """(``doc_id``, ``source``, ``tokens``, ``copies``) of the documents used at least once.

    Within a source documents stand in order of length, then of hash. With expected copies e each, the prefix sum
    at the i-th is i * e; with one random offset u for the source, floor(i * e + u) - floor((i - 1) * e + u)
    copies are emitted. Ordering by length lets every length have its share, so that tokens follow closely; what
    single long documents add or leave over is made up by choosing among several offsets, and once more with the expected
    copies raised or lowered by what the first choice missed.

    Prefixes are taken over counts of (source, length), then over hash bins within one, as many as its documents need;
    only rows of one bin are ranked in a task.
    """
    lengths = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    shorter = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("source", "tokens", F.ceil(F.col("n") / m.bin_rows).alias("bins"), F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("shorter"))
    goal = planned.where("copies > 0").select("source", F.col("copies").alias("each"), "goal_tokens", "max_repeats")
    keyed = sized.withColumn("hash", F.xxhash64(F.lit(m.salt), "doc_id")).join(lengths.join(goal, "source"), ["source", "tokens"]).withColumn("bin", F.pmod("hash", F.col("bins")))
    bins = keyed.groupBy("source", "tokens", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "tokens").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "tokens", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "tokens", "bin").orderBy("hash", "doc_id"))
    placed = keyed.join(bins, ["source", "tokens", "bin"]).withColumn("i", F.col("shorter") + F.col("before") + place).select("doc_id", "source", "tokens", "i")
    placed = cut(placed)
    first = F.pmod(F.xxhash64(F.lit(m.salt), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = lambda u: (F.floor(F.col("i") * F.col("each") + u) - F.floor((F.col("i") - 1) * F.col("each") + u)).cast("long")
    offset = lambda k: F.pmod(first + F.lit(k / m.offsets), F.lit(1.0))
    keys = ["source", "each", "goal_tokens", "max_repeats"]

    def tried(goal: DataFrame) -> DataFrame:
        """Each source's offset that comes nearest to its goal, and by how much it misses."""
        sums = placed.join(F.broadcast(goal), "source").groupBy(*keys).agg(*(F.sum(F.col("tokens") * copies(offset(k))).alias(f"u{k}") for k in range(m.offsets)))
        best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"u{k}") - F.col("goal_tokens")).alias("off"), F.col(f"u{k}").alias("used"), offset(k).alias("u")) for k in range(m.offsets))))
        return cut(sums.select(*keys, best.alias("best")))  # a row per target source

    once = tried(goal)
    more = F.least(F.col("each") * F.col("goal_tokens") / F.greatest("best.used", F.lit(1)), F.col("max_repeats").cast("double"))
    twice = tried(once.select("source", more.alias("each"), "goal_tokens", "max_repeats"))
    chosen = once.unionByName(twice).groupBy("source").agg(F.min(F.struct("best.off", "each", "best.u")).alias("m")).select("source", F.col("m.each").alias("each"), F.col("m.u").alias("u"))
    crossed = placed.join(F.broadcast(chosen), "source").withColumn("copies", copies(F.col("u")))
    return crossed.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def sized_documents(documents: DataFrame, targets: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(``doc_id``, ``source``, ``tokens``) of the documents whose source has a target."""
    keyed = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").join(goals(targets).select("source"), "source", "left_semi")
    return counted(keyed, "text", tokenizer)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: Tokenizer = Tokenizer(), m: Mixing = Mixing()) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix, (``doc_id``, ``copy``, ``source``, ``tokens``), has one row per use of a document, copies numbered
    from 1. The report, one row per target source: ``source``, ``target_share``, ``max_repeats``, ``tokens`` (each
    document once), ``documents``, ``goal_tokens`` (its target share of the size aimed at, see :func:`plan`, or all it can
    give), ``falls_short``, ``used_tokens``, ``used_most`` (uses of the most used document), ``actual_share`` (of the
    tokens of the mix; 0 where the mix is empty) and ``reachable_share`` (the same if every goal were met exactly).

    Documents with a null source or one without target take no part; null and empty texts have no tokens and are
    used like others of their source. ``doc_id`` must not be null. Sources are compared trimmed and in lower case.
    Tokens are counted over whole texts. Empty tables give an empty mix. Other columns are ignored.
    """
    sized = cut(sized_documents(documents, targets, tokenizer))
    planned = cut(plan(sized, targets, m))
    used = cut(emitted(sized, planned, m))
    mixed = used.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "tokens")
    totals = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("used_most"))
    report = planned.drop("copies").join(totals, "source", "left").na.fill(0, ["used_tokens", "used_most"])
    every = report.agg(F.sum("used_tokens").alias("every"), F.sum("goal_tokens").alias("goals"))  # one row
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    report = report.crossJoin(F.broadcast(every)).withColumn("actual_share", share("used_tokens", "every")).withColumn("reachable_share", share("goal_tokens", "goals")).drop("every", "goals")
    return mixed, report
