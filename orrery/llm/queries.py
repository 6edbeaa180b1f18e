"""Queries of the subpackage over the test tables, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import is_valid_vector
from orrery.llm import clusters, mixing, neighbours, packing, quality, sample, subset
from orrery.session import cut


#: Share of the records that the sample holds.
SAMPLE_RATE = 0.05


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.most_similar(_table(spark, sf_dir, "vectors"), _table(spark, sf_dir, "queries")))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and distances of the nearest stored vectors of every stored vector and request, as far as the limit."""
    return neighbours.most_similar(_table(spark, sf_dir, "vectors"), _table(spark, sf_dir, "queries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = neighbours.Similar(k=6)
    tables = [(_table(spark, sf_dir, "vectors"), "id", "data", 0), (_table(spark, sf_dir, "centroids"), "centroid_id", "vector", 1)]
    named, _ = clusters.clustered(tables, p)
    members = [neighbours.members(df, id_col, vector_col, p, bit) for df, id_col, vector_col, bit in tables]
    found = clusters.cluster_members(named, members[0].unionByName(members[1]))
    return found.select(F.when(F.col("bit") == 1, "centroid").otherwise("stored").alias("origin"), "cluster_key", "member_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, typical members and nearest centroid of every cluster of stored vectors."""
    p, stored = neighbours.Similar(k=6), _table(spark, sf_dir, "vectors")
    named, _ = clusters.clustered([(stored, "id", "data", 0)], p)
    return clusters.described(named, neighbours.members(stored, "id", "data", p), stored, _table(spark, sf_dir, "centroids"), p)


def p3_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attractor, size and members of strongest flow of every flow cluster of stored vectors."""
    p, stored = neighbours.Similar(k=6), _table(spark, sf_dir, "vectors")
    named, _ = clusters.clustered([(stored, "id", "data", 0)], p)
    return clusters.flow_clusters(named, neighbours.members(stored, "id", "data", p))


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.varied_subset(_table(spark, sf_dir, "vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = sample.batch_records(_table(spark, sf_dir, "vectors"), SAMPLE_RATE)
    return records.where("versions >= 2").select(F.col("record").alias("external_id"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.frozen_sample(_table(spark, sf_dir, "vectors"), SAMPLE_RATE).select(F.col("record").alias("external_id"), F.col("batch").alias("load_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = packing.packed(_table(spark, sf_dir, "documents"))
    return filled.where("pieces > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(packing.packed(_table(spark, sf_dir, "documents")))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts and pieces in every container."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).where("falls_short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself, a row per use of a document."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = quality.assessed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))
    return assessed.where(~F.col("is_prose")).select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.statistics(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))
    return found.select("doc_id", F.col("word_count").cast("long").alias("word_count"), *(F.round(c, 6).alias(c) for c in quality.STATISTICS[1:]))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics with the kind of each text and the verdict whether it is prose."""
    return quality.assessed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def p4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors the subset has, and of these repeated ids, repeated vectors and such as aren't stored or valid."""
    stored = _table(spark, sf_dir, "vectors")
    chosen = subset.varied_subset(stored)
    valid = stored.where(is_valid_vector(F.col("data"), 64)).select("id", F.xxhash64("data").alias("h")).distinct()
    known = chosen.join(valid, "id", "left")
    return known.agg(F.count("*").alias("selected"), (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), (F.count("h") - F.count_distinct("h")).alias("repeated_vectors"), (F.count("*") - F.count("h")).alias("unknown"))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers over capacity, texts that their pieces don't make up in order, and whether 95 % of the space is used."""
    texts, capacity = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("whole")), packing.Packing().capacity
    filled = cut(packing.packed(_table(spark, sf_dir, "documents")))
    held = packing.containers(filled).agg(F.count_if(F.col("tokens") > capacity).alias("overfull"), (F.sum("tokens") >= 0.95 * capacity * F.count("*")).alias("well_filled"))
    along = Window.partitionBy("doc_id").orderBy("piece")
    placed = filled.withColumn("due", F.coalesce(F.sum("chars").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(along) - 1)
    pieces = placed.groupBy("doc_id").agg(F.sum("chars").alias("held"), F.count_if((F.col("start") != F.col("due")) | (F.col("nth") != F.col("piece"))).alias("off"), (F.max("pieces") != F.count("*")).alias("short"))
    wrong = texts.where("whole > 0").join(pieces, "doc_id", "full").where("held is null or whole is null or held != whole or off > 0 or short").agg(F.count("*").alias("broken"))
    return held.crossJoin(wrong)  # a row each


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that miss their goal by over 2 % and over a mean document, that repeat a document too often, whose tokens
    aren't those of the mix, or whose share is off the target by over a hundredth (what no document can give left out)."""
    mixed, report = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("sum_tokens"), F.max("copy").alias("max_copy"))
    both = report.join(used, "source", "left").na.fill(0, ["sum_tokens", "max_copy"])
    return both.agg(
        F.count("*").alias("sources"), F.count_if(F.abs(F.col("used_tokens") - F.col("goal_tokens")) > F.greatest(0.02 * F.col("goal_tokens"), F.col("tokens") / F.greatest("documents", F.lit(1)))).alias("off_goal"),
        F.count_if(F.col("max_copy") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("sum_tokens") != F.col("used_tokens")).alias("miscounted"),
        F.count_if((F.col("tokens") > 0) & (F.abs(F.col("actual_share") - F.col("target_share") / 0.97) > 0.01)).alias("off_share"),
    )


QUERIES = [
    p1_found, p1_nearest, p3_found, p3_clusters, p3_flows, p4_subset, p4_violations, p5_found, p5_sample, p6_found, p6_containers, p6_packed, p6_violations,
    p7_found, p7_report, p7_mix, p7_violations, p8_found, p8_statistics, p8_kinds,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


P5_SAMPLE = """
WITH records AS (
  SELECT external_id, min(load_no) AS load_no FROM vectors WHERE external_id IS NOT NULL GROUP BY external_id
), placed AS (
  SELECT external_id, load_no, count(*) OVER (PARTITION BY load_no) AS n,
         row_number() OVER (PARTITION BY load_no ORDER BY md5('orrery:' || external_id), external_id) AS place
  FROM records WHERE load_no IS NOT NULL
)
SELECT external_id, CAST(load_no AS BIGINT) AS load_no FROM placed WHERE place <= ceil(round(0.05 * n, 6))
"""

P5_FOUND = """
SELECT external_id FROM vectors WHERE external_id IS NOT NULL GROUP BY external_id HAVING count(DISTINCT id) >= 2
"""


# The answers of the next two are the same for every tokenizer with at least one token per run of non-blanks and at
# most one per byte, so these runs stand for tokens.
P6_FOUND = r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 2048"

P7_FOUND = r"""
WITH sized AS (
  SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(coalesce(text, ''), '\S+'))) AS tokens FROM documents GROUP BY 1
), goals AS (
  SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1
), both_ AS (
  SELECT g.source, target_share, max_repeats, coalesce(tokens, 0) AS tokens FROM goals g LEFT JOIN sized s ON s.source = g.source
)
SELECT source FROM both_ WHERE max_repeats * tokens < target_share * (SELECT sum(tokens) FROM both_)
"""


#: Valid vectors, once per id, as the tables of TESTDATA define them; k is the number of the origin.
VALID = """
  SELECT 'stored' AS origin, CAST(id AS BIGINT) AS id, any_value(data)::DOUBLE[64] AS x FROM vectors
  WHERE id IS NOT NULL AND len(data) = 64 AND list_bool_and(list_transform(data, lambda v: v IS NOT NULL AND isfinite(v))) GROUP BY id
"""
OTHERS = """
  SELECT '{origin}' AS origin, CAST({id} AS BIGINT) AS id, any_value({data})::DOUBLE[64] AS x FROM {table}
  WHERE {id} IS NOT NULL AND len({data}) = 64 AND list_bool_and(list_transform({data}, lambda v: v IS NOT NULL AND isfinite(v))) GROUP BY {id}
"""
REQUESTS = OTHERS.format(origin="request", id="query_id", data="query", table="queries")
CENTROIDS = OTHERS.format(origin="centroid", id="centroid_id", data="vector", table="centroids")

#: All pairs within the limit, of which each vector and request keeps the ten nearest.
P1_NEAREST = f"""
WITH s AS MATERIALIZED ({VALID}), r AS MATERIALIZED ({REQUESTS}), pairs AS (
  SELECT 'stored' AS origin, a.id AS query_id, b.id AS neighbour_id, pow(array_distance(a.x, b.x), 2) AS d FROM s a, s b WHERE a.id <> b.id AND array_distance(a.x, b.x) <= 2.8285
  UNION ALL SELECT 'request', a.id, b.id, pow(array_distance(a.x, b.x), 2) FROM r a, s b WHERE array_distance(a.x, b.x) <= 2.8285
), listed AS (
  SELECT *, row_number() OVER (PARTITION BY origin, query_id ORDER BY round(d, 9), neighbour_id) AS rank FROM pairs WHERE d <= 8.0 + 1e-12
)"""
P1_FOUND = P1_NEAREST + """
SELECT DISTINCT origin, CASE WHEN origin = 'stored' THEN least(query_id, neighbour_id) ELSE query_id END AS left_id,
  CASE WHEN origin = 'stored' THEN greatest(query_id, neighbour_id) ELSE neighbour_id END AS right_id FROM listed WHERE rank <= 10
"""


def _p3_sql(rounds: int = 12) -> str:
    """Components of all pairs within the limit: each round takes the neighbours' smallest label, then that label's own."""
    sql = f"WITH v AS MATERIALIZED ({VALID} UNION ALL {CENTROIDS}), e AS MATERIALIZED (SELECT a.origin, a.id AS a, b.id AS b FROM v a JOIN v b ON a.origin = b.origin WHERE array_distance(a.x, b.x) <= sqrt(8.0)), l0 AS MATERIALIZED (SELECT origin, id, id AS label FROM v)"
    for r in range(rounds):
        sql += f", m{r} AS MATERIALIZED (SELECT e.origin, e.a AS id, min(l.label) AS label FROM e JOIN l{r} l ON l.origin = e.origin AND l.id = e.b GROUP BY 1, 2)"
        sql += f", l{r + 1} AS MATERIALIZED (SELECT m.origin, m.id, n.label FROM m{r} m JOIN m{r} n ON n.origin = m.origin AND n.id = m.label)"
    return sql + f" SELECT origin, label AS cluster_key, id AS member_id FROM l{rounds} QUALIFY count(*) OVER (PARTITION BY origin, label) >= 3"


P4_VIOLATIONS = f"SELECT CAST(round(0.02 * count(DISTINCT x)) AS BIGINT) AS selected, 0::BIGINT AS repeated_ids, 0::BIGINT AS repeated_vectors, 0::BIGINT AS unknown FROM ({VALID})"
P6_VIOLATIONS = "SELECT 0::BIGINT AS overfull, true AS well_filled, 0::BIGINT AS broken"
P7_VIOLATIONS = "SELECT count(DISTINCT lower(trim(source))) AS sources, 0::BIGINT AS off_goal, 0::BIGINT AS too_often, 0::BIGINT AS miscounted, 0::BIGINT AS off_share FROM mix_targets"

P8_STATISTICS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (
  SELECT doc_id, len(regexp_extract_all(t, '[^\s\x0b\pZ]+')) AS n, regexp_extract_all(lower(t), '\pL+') AS letters, length(regexp_replace(t, '[\s\x0b\pZ]+', '', 'g')) AS solid,
    length(regexp_replace(t, '[^\pL\pN]+', '', 'g')) AS alnum, len(regexp_extract_all(t, '(?:^|\n)[ \t\x0b\f\r\pZ]*[^\s\x0b\pZ]')) AS lines,
    len(regexp_extract_all(t, '[.!?…]["''”»)’\]]*[ \t\x0b\f\r\pZ]*(?:\n|\z)')) AS ended FROM d
), s AS (SELECT DISTINCT lang, lower(word) AS word FROM common_words WHERE word IS NOT NULL),
m AS (
  SELECT doc_id, max(k) AS common FROM (SELECT doc_id, lang, count(*) AS k FROM (SELECT doc_id, unnest(letters) AS word FROM c) JOIN s USING (word) GROUP BY 1, 2) GROUP BY 1
)
SELECT doc_id, n AS word_count, round(CASE WHEN n > 0 THEN solid / n ELSE 0 END, 6) AS mean_word_length, round(CASE WHEN solid > 0 THEN (solid - alnum) / solid ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN lines > 0 THEN ended / lines ELSE 0 END, 6) AS punctuated_lines, round(CASE WHEN len(letters) > 0 THEN coalesce(common, 0) / len(letters) ELSE 0 END, 6) AS common_share
FROM c LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p3_found": _p3_sql(), "p4_violations": P4_VIOLATIONS, "p5_found": P5_FOUND, "p5_sample": P5_SAMPLE, "p6_found": P6_FOUND, "p6_violations": P6_VIOLATIONS,
        "p7_found": P7_FOUND, "p7_violations": P7_VIOLATIONS, "p8_statistics": P8_STATISTICS,
    }
