"""Mixing sources to target weights.

Sizes are summed per source (before the shuffle, so a hot source costs one row
per task), targets are filled by weight up to a cap of MAX_RATE times the
source, and each document is emitted floor(rate) times plus once more with a
probability equal to the fraction.  That last choice hashes the seed and the
id: reruns and retries agree.

The targets follow from sums over the sources: each round the sources whose cap
is below the level of the rest are filled up, and the level is what is left /
weights that are left, until no further source is over.  Sources are never in
one task: their order (for the weights) is found by ranges, and rounds only sum.

Results for odd input: a null text has size 0; null is a source of its own,
last; sources without words have target 0 and rate 0; a null id draws by
its text; rows that share an id draw alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, documents, durable, named

MAX_RATE = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Up to so many sources their targets (under 100 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def ranked(by_source: DataFrame) -> DataFrame:
    """by_source with the rank of each source, by code point with null last, from 0: ranks within ranges, after the rows of earlier ranges."""
    order = F.col("source").asc_nulls_last()
    parts = durable(by_source.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("first")
    return parts.join(F.broadcast(offsets), F.col("part") == F.col("of")).select(*by_source.columns, rank.alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    plan = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_rate)
    plan = durable(plan.withColumn("ratio", F.col("cap") / F.col("weight")))
    total, left = plan.agg(F.sum("source_size"), F.sum("weight")).first()
    level, over = float(total) / float(left) if left else 0.0, 0
    while True:
        full = F.col("ratio") < level
        spent, left, now = plan.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == over:
            break
        over, level = now, float(total - spent) / float(left) if left else float("inf")
    return plan.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The rows of df as struct `row`, with size, source_size, target, copies and taken (size * copies)."""
    source = named(source_col).cast("string")
    plan = targets(df.select(source.alias("source"), words(named(text_col)).alias("size")), weights, max_rate)
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.select(F.col("source").alias("of"), "source_size", "target")
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), source.alias("source"), words(named(text_col)).alias("size"), F.coalesce(named(id_col).cast("string"), F.concat(F.lit("text:"), named(text_col)), F.lit("")).alias("key"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate") + (draw(F.col("key"), seed) < F.col("rate") - F.floor("rate")).cast("long"))
        .select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy", **options) -> DataFrame:
    """df with each row as often as the mix takes it; copy_col counts the copies of a row from 1."""
    taken = mix(df, id_col, text_col, source_col, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*", F.col("copy").alias(copy_col))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM by_source
), ordered AS (
  SELECT *, cap::DOUBLE / weight AS ratio FROM weighted
), filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ordered
), stop AS (
  SELECT arg_min(level, ratio) AS level FROM (SELECT ratio, min(level) AS level FROM filled WHERE ratio >= level GROUP BY ratio)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM stop), 0.0) * weight) AS target FROM filled
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'text:' || d.text, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken,
       (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT)::BIGINT AS copies
FROM rated
"""
