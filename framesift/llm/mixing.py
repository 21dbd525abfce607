"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.llm.tables import WORD, read, uniform, written

SHARE, LIMIT, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), 17


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `size`: words of the text, 0 for a null or empty one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_rates(docs: DataFrame, source: str = "source", share: float = SHARE, limit: float = LIMIT,
                 weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): how many words each source gives to the mix.

    Sources ordered by code point (null last) take the weights in turn and share `share` times all
    sizes. No target exceeds `limit` times its source; the excess is shared out again by weight until
    none is above. A source without words gets 0. `docs` needs `size`, see `sized`.

    Sizes are added up per source before the shuffle, so a hot source is one row per task. Ranks come
    from sorted ranges and their row counts; each round of resharing brings three numbers to the driver.
    """
    spark = docs.sparkSession
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranged = written(totals.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
                     .withColumn("_range", F.spark_partition_id()), "mix_ranges")
    before = ranged.groupBy("_range").count().select(
        "_range", (F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    table = written(ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
                    .join(F.broadcast(before), "_range")  # a row per range, as many as shuffle partitions
                    .withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))
                    .select("source", "source_size", (F.col("source_size") * limit).alias("_cap"),
                            F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int")).alias("_weight")), "mix_sources")
    level = water_level(table, share)
    return table.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def water_level(table: DataFrame, share: float) -> float:
    """Words per unit of weight at which the capped targets add up to the wanted total."""
    total, weight = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    if not total:
        return 0.0
    level, capped = total * share / weight, -1
    while True:
        over = F.col("_cap") < level * F.col("_weight")
        full, free, now = table.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))),
                                    F.count_if(over)).first()
        if now == capped or not free:
            return level
        level, capped = (total * share - full) / free, now


def copies(docs: DataFrame, rates: DataFrame, source: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add source_size, target and `copies` to every document: floor(rate) copies and one more with
    probability rate - floor(rate), drawn from a hash of seed and key, so that reruns agree.

    Repeated rows of one key share their draw. Null keys, sources and texts are allowed.
    """
    joined = docs.join(rates.withColumnRenamed("source", "_source"), F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", (F.floor(rate) + (uniform(F.lit(seed), F.col(key)) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed documents with their own columns; a document stands as often as it has copies.

    Columns of `docs` that clash with the helper names (size, source_size, target, copies) survive:
    the helpers are worked out on a packed copy of the row.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_mix_source"),
                         F.col(key).alias("_mix_key"), F.col(text).alias("_mix_text"))
    rows = sized(packed, "_mix_text").drop("_mix_text")
    rates = source_rates(rows, "_mix_source")
    kept = copies(rows, rates, "_mix_source", "_mix_key", seed).where("copies > 0")
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = written(sized(read(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "mix_sizes")
    return copies(docs, source_rates(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size::DOUBLE * 2 AS cap FROM s),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5 * sum(source_size) OVER () AS goal, row_number() OVER (ORDER BY cap / w, r) AS i FROM w),
l AS (SELECT coalesce(arg_min((goal - below) / rest, i) FILTER ((goal - below) / rest <= cap / w), 0) AS level FROM k),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM w, l),
m AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS taken FROM m"""
