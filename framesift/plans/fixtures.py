"""Stand-ins built from the given tables, once as DataFrames and once as SQL text.

clip / video → orders, timed spans → lineitem, frame series → events per user, scored samples →
documents with labels, embeddings → embeddings, sync curves → two 31-value slices of an embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.hashing import split_of
from framesift.functions.vectors import doubles
from framesift.operators.ordered import HOT_ROWS, dealt, positions, settle
from framesift.session import table

DIMENSIONS = 64


def hash_sql(text: str) -> str:
    return f"('0x' || substr(sha256(CAST({text} AS VARCHAR)), 1, 8))::BIGINT"


def split_sql(key: str) -> str:
    h = f"{hash_sql(key)} % 20"
    return f"(CASE WHEN {h} < 12 THEN 'train' WHEN {h} < 15 THEN 'validation' ELSE 'test' END)"


def event_limit(spark: SparkSession, sf: str, hot_rows: int = HOT_ROWS) -> int | None:
    """None when no user is heavy, so the ordered steps of a query over events need no ranges."""
    return settle(table(spark, sf, "events"), ["user_id"], hot_rows)


def series(spark: SparkSession, sf: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(clip_id, t, value, x, valid, event_type, event_id, ts): one frame row per event."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", "ts", "event_type", "value",
        (F.col("event_type") != "error").alias("valid"), F.sqrt("value").alias("x"),
    )
    if hot_rows is None:
        events = dealt(events, ["clip_id"])
    return positions(events, ["clip_id"], ["ts", "event_id"], hot_rows=hot_rows)


SERIES = """series AS (
  SELECT user_id AS clip_id, event_id, ts, event_type, value, event_type <> 'error' AS valid, sqrt(value) AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t
  FROM events)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, speaker_id, cell, score, y, y2, split)."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker_id"),
        F.col("lang").alias("cell"), F.col("n_chars").cast("double").alias("score"),
        F.col("quality").cast("long").alias("y"), F.col("toxic").cast("long").alias("y2"),
        split_of(F.col("doc_id")).alias("split"),
    )


SAMPLES = f"""samples AS (
  SELECT doc_id AS sample_id, source AS speaker_id, lang AS cell, n_chars::DOUBLE AS score,
         quality::BIGINT AS y, toxic::BIGINT AS y2, {split_sql('doc_id')} AS split
  FROM documents JOIN labels USING (doc_id))"""


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """(clip_id, speaker_id, source_id, start_s, end_s, duration_s, split, status, priority, added)."""
    start = (F.col("o_orderkey") * 60).cast("double")  # clips last at most 50 s, so none overlap
    duration = F.col("o_totalprice") / F.lit(1e4)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("speaker_id"),
        F.concat_ws(":", F.col("o_custkey"), F.year("o_orderdate")).alias("source_id"),
        start.alias("start_s"), (start + duration).alias("end_s"), duration.alias("duration_s"),
        split_of(F.col("o_custkey")).alias("split"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("added"),
    )


CLIPS = f"""clips AS (
  SELECT o_orderkey AS clip_id, o_custkey AS speaker_id,
         o_custkey::VARCHAR || ':' || year(o_orderdate)::VARCHAR AS source_id,
         (o_orderkey * 60)::DOUBLE AS start_s, (o_orderkey * 60)::DOUBLE + o_totalprice / 1e4 AS end_s,
         o_totalprice / 1e4 AS duration_s, {split_sql('o_custkey')} AS split,
         o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS added
  FROM orders)"""


def crossing_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clips whose spans within a source often overlap."""
    start = (F.col("clip_id") % 50 * 8).cast("double")
    return clips(spark, sf).withColumns({"start_s": start, "end_s": start + F.col("duration_s")})


CROSSING = CLIPS + """, crossing AS (
  SELECT * REPLACE ((clip_id % 50 * 8)::DOUBLE AS start_s, (clip_id % 50 * 8)::DOUBLE + duration_s AS end_s) FROM clips),
apart AS (SELECT c.clip_id, c.split, d.clip_id AS other, c.duration_s, d.duration_s AS size FROM crossing c JOIN crossing d
  ON d.speaker_id = c.speaker_id AND d.split = c.split AND d.clip_id <> c.clip_id AND (d.source_id <> c.source_id OR d.end_s <= c.start_s OR c.end_s <= d.start_s))"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """(clip_id, a, b, kind): a = days since the first ship date of the order, b = a + quantity/10."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_returnflag"
    )
    lines = dealt(lines, ["l_orderkey"])
    first = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    day = F.datediff("l_shipdate", "first").cast("double")
    return lines.join(first, "l_orderkey").select(
        F.col("l_orderkey").alias("clip_id"), day.alias("a"),
        (day + F.col("l_quantity") / 10).alias("b"), F.col("l_returnflag").alias("kind"),
    )


SPANS = """spans AS (
  SELECT l_orderkey AS clip_id, d AS a, d + l_quantity / 10 AS b, l_returnflag AS kind
  FROM (SELECT *, date_diff('day', (min(l_shipdate) OVER (PARTITION BY l_orderkey))::DATE,
                            l_shipdate::DATE)::DOUBLE AS d FROM lineitem))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, v array<double>)."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), doubles(F.col("embedding")).alias("v")
    )


VECTORS = "vectors AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings)"


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of five per source clip with two 31-value curves (cos and dist)."""
    k = F.col("vec_id") % 5
    cell = F.element_at(
        F.array(*[F.lit(c) for c in ("real", "sham", "source", "source", "both")]),
        (k + 1).cast("int"),
    )
    kind = F.when(k == 3, F.lit("partial")).otherwise(F.lit("full"))
    source = F.floor(F.col("vec_id") / 5).cast("long")
    return vectors(spark, sf).select(
        F.col("vec_id").alias("sample_id"), source.alias("source_clip_id"), cell.alias("cell"),
        kind.alias("kind"), split_of(source).alias("split"), F.lit(4.0).alias("duration_s"),
        F.col("label"),
        F.slice("v", 1, 31).alias("cos"), F.slice("v", 33, 31).alias("dist"),
    )


MEASURED = f"""measured AS (
  SELECT vec_id AS sample_id, vec_id // 5 AS source_clip_id,
         list_value('real','sham','source','source','both')[(vec_id % 5 + 1)::INT] AS cell,
         CASE WHEN vec_id % 5 = 3 THEN 'partial' ELSE 'full' END AS kind,
         {split_sql('vec_id // 5')} AS split, 4.0::DOUBLE AS duration_s, label::BIGINT AS label,
         (embedding::DOUBLE[])[1:31] AS cos, (embedding::DOUBLE[])[33:63] AS dist
  FROM embeddings)"""
