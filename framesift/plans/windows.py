"""Window functions, sorts, set operations and scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions import rules as R
from framesift.functions import vectors as V
from framesift.operators.ordered import halo, positions, previous, running, top_k
from framesift.operators.signals import sigmoid
from framesift.plans.fixtures import SERIES, VECTORS, event_limit, series, vectors
from framesift.plans.registry import query
from framesift.session import table

LIT = F.lit


@query("w1_ranking", "W1", """SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def w1(spark, sf):
    """Ranks come from counts per distinct value, so a huge customer is not sorted in one task."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    numbered = positions(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "rn")
    values = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(LIT(1)).alias("k"))
    ranks = running(values, ["o_custkey"], ["o_orderpriority"], {"dr": ("sum", LIT(1).cast("long")), "upto": ("sum", F.col("k"))})
    ranks = ranks.select("o_custkey", "o_orderpriority", "dr", (F.col("upto") - F.col("k") + 1).alias("rk"))
    return numbered.join(ranks, ["o_custkey", "o_orderpriority"]).select("o_orderkey", (F.col("rn") + 1).alias("rn"), "dr", "rk")


@query("w2_analytic", "W2", f"WITH {SERIES} SELECT clip_id, t, lag(value) OVER w AS prev, lead(value) OVER w AS next, round(value - lag(value) OVER w, 4) AS diff FROM series WINDOW w AS (PARTITION BY clip_id ORDER BY t)")
def w2(spark, sf):
    s = series(spark, sf, event_limit(spark, sf)).select("clip_id", "t", "value")
    out = halo(s, ["clip_id"], "t", 1, lambda w: {"prev": F.lag("value").over(w), "next": F.lead("value").over(w)})
    return out.select("clip_id", "t", "prev", "next", F.round(F.col("value") - F.col("prev"), 4).alias("diff"))


@query("w3_frames", "W3", f"""WITH {SERIES} SELECT clip_id, t, round(avg(x) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred, round(sum(x) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing,
  round(sum(x) OVER (PARTITION BY clip_id ORDER BY t), 6) AS running, round(max(x) OVER (PARTITION BY clip_id ORDER BY t DESC), 6) AS envelope FROM series""")
def w3(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", "x")
    s = halo(s, ["clip_id"], "t", 4, lambda w: {"centred": F.avg("x").over(w.rowsBetween(-2, 2)), "trailing": F.sum("x").over(w.rowsBetween(-4, 0))})
    s = running(s, ["clip_id"], ["t"], {"running": ("sum", F.col("x"))}, hot_rows=hot)
    s = running(s.withColumn("back", -F.col("t")), ["clip_id"], ["back"], {"envelope": ("max", F.col("x"))}, hot_rows=hot)
    return s.select("clip_id", "t", *[F.round(c, 6).alias(c) for c in ("centred", "trailing", "running", "envelope")])


@query("w4_sort", "W4", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey DESC")
def w4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.col("o_orderpriority").desc(), "o_totalprice", F.col("o_orderkey").desc())


@query("w5_top_k", "W5", "SELECT o_orderkey, o_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def w5(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(o, ["o_custkey"], ["-o_totalprice", "o_orderkey"], 3).select("o_orderkey", "o_custkey", "rank")


@query("w5_head", "W5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def w5_head(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("w6_set_operations", "W6", """WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 450000)
SELECT 'union' AS op, id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'intersect', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'except', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)""")
def w6(spark, sf):
    o = table(spark, sf, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), o.where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    named = [d.select(LIT(n).alias("op"), "id") for n, d in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("w7_log_union", "W7", """SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def w7(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    mine, theirs = e.where("event_id % 3 > 0").drop("event_id"), e.where("event_id % 3 < 2").drop("event_id")
    return mine.union(theirs).dropDuplicates()


@query("w8_distinct", "W8", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def w8(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@query("s1_strings", "S1", r"""SELECT doc_id, lower(trim(split_part(text, chr(10), 1))) AS head, regexp_replace(source, '^src', 's-', '') AS src, starts_with(text, 'T') AS t, ends_with(text, '.') AS dot, array_to_string(list_slice(string_split(text, ' '), 1, 3), '_') AS three FROM documents""")
def s1(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.lower(F.trim(F.split_part("text", LIT("\n"), LIT(1)))).alias("head"), F.regexp_replace("source", "^src", "s-").alias("src"),
        F.startswith("text", LIT("T")).alias("t"), F.endswith("text", LIT(".")).alias("dot"), F.array_join(F.slice(F.split("text", " "), 1, 3), "_").alias("three"))


@query("s2_hashing", "S2", """SELECT doc_id, sha256(text) AS h256, sha1(text) AS h1, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS stable, sha256('{"lang":"' || lang || '","n":' || n_chars::VARCHAR || '}') AS fingerprint FROM documents""")
def s2(spark, sf):
    from framesift.functions.hashing import stable_int

    body = F.to_json(F.struct("lang", F.col("n_chars").alias("n")))
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h256"), F.sha1("text").alias("h1"),
                                                stable_int(F.col("text")).alias("stable"), F.sha2(body, 256).alias("fingerprint"))


@query("s3_dates", "S3", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def s3(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), LIT("+00:00")).alias("iso"),
                                             F.date_format(d, "yyyyMMdd").alias("day"), F.date_format(d, "yyyyMMdd_HHmmss").alias("stamp"))


@query("s4_math", "S4", """SELECT event_id, floor(value)::BIGINT AS fl, ceil(value)::BIGINT AS ce, round_even(value * 2, 0) AS re, least(greatest(value, 5), 50) AS clip, round(ln(value), 6) AS ln, round(exp(-value / 100), 6) AS ex, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sig,
  round(20 * log10(value + 1e-9), 6) AS db, round(2595 * log10(1 + value / 700), 6) AS mel FROM events""")
def s4(spark, sf):
    v = F.col("value")
    fine = {"ln": whole_log(F.log, v), "ex": F.exp(-v / 100), "sig": sigmoid((v - 50) / 10), "db": 20 * whole_log(F.log10, v + 1e-9), "mel": 2595 * whole_log(F.log10, 1 + v / 700)}
    return table(spark, sf, "events").select(
        "event_id", F.floor(v).alias("fl"), F.ceil(v).alias("ce"), F.rint(v * 2).alias("re"), F.least(F.greatest(v, LIT(5.0)), LIT(50.0)).alias("clip"), *[x.alias(c) for c, x in fine.items()]
    ).withColumns({c: six(F.col(c)) for c in fine})


def whole_log(log, x):
    """A logarithm with SQL's values at 0 (minus infinity) and below (NaN), where Spark's own are NULL."""
    return F.when(x == 0, LIT(float("-inf"))).when(x < 0, LIT(float("nan"))).otherwise(log(x))


def six(x):
    """Six decimals as SQL rounds them: by the product with 10^6, zeros keep their sign. Spark's own rounding goes by
    the shortest decimal, which may tie where the product does not."""
    whole = F.round(x * 1e6, 0)
    return F.when(whole == 0, x * 0.0).otherwise(whole / 1e6)


@query("s5_arrays", "S5", f"""WITH {VECTORS} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v[1:32], v[33:64]), 6) AS dot, len(list_filter(v, lambda x: x > 0)) AS positive, list_position(v, list_max(v))::BIGINT AS top, round(list_sort(v)[1], 6) AS least FROM vectors""")
def s5(spark, sf):
    v = F.col("v")
    return vectors(spark, sf).select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.dot(F.slice(v, 1, 32), F.slice(v, 33, 32)), 6).alias("dot"),
                                     F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.array_position(v, F.array_max(v)).alias("top"), F.round(F.array_sort(v)[0], 6).alias("least"))


@query("s6_json_maps", "S6", "SELECT (props ->> '$.k')::BIGINT AS k, count(*) AS n, '{\"k\":' || (props ->> '$.k') || '}' AS again FROM events GROUP BY 1, 3")
def s6(spark, sf):
    parsed = F.from_json("props", T.MapType(T.StringType(), T.LongType()))
    rows = table(spark, sf, "events").select(F.explode(parsed).alias("name", "k")).where("name = 'k'")
    return rows.groupBy("k").agg(F.count(LIT(1)).alias("n")).select("k", "n", F.to_json(F.create_map(LIT("k"), "k")).alias("again"))


@query("s7_vector_blobs", "S7", f"WITH {VECTORS} SELECT vec_id, 64::BIGINT AS n, round(v[1], 6) AS first, round(v[64], 6) AS last FROM vectors")
def s7(spark, sf):
    """float32 BLOB (little endian) → array, the import step of a vector column."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def from_blob(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    @F.pandas_udf(T.BinaryType())
    def to_blob(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    back = table(spark, sf, "embeddings").select("vec_id", from_blob(to_blob("embedding")).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[63].cast("double"), 6).alias("last"))


@query("s8_null_nan", "S8", """WITH e AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE sqrt(value) END AS v FROM events)
SELECT event_type, count(v) AS known, round(max(v), 6) AS top, round(median(v), 6) AS med, coalesce(printf('%.3f', round(min(v), 6)), '-') AS text FROM e GROUP BY 1""")
def s8(spark, sf):
    from framesift.operators.signals import exact_quantiles

    raw = F.when(F.col("event_id") % 3 == 0, LIT(float("nan"))).otherwise(F.sqrt("value"))
    e = table(spark, sf, "events").select("event_type", F.when(~F.isnan(raw), raw).alias("v"))
    med = exact_quantiles(e, ["event_type"], "v", {"med": 0.5}).select("event_type", F.round("med", 6).alias("med"))
    out = e.groupBy("event_type").agg(F.count("v").alias("known"), F.round(F.max("v"), 6).alias("top"),
                                      F.coalesce(F.format_string("%.3f", F.round(F.min("v"), 6)), LIT("-")).alias("text"))
    return out.join(med, "event_type")


@query("s9_flag_lists", "S9", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), CASE WHEN p_size > 25 THEN ['big'] ELSE [] END))), ',') AS flags FROM part""")
def s9(spark, sf):
    flags = R.add_flag(F.replace("p_name", LIT(" "), LIT(",")), F.when(F.col("p_size") > 25, LIT("big")))
    return table(spark, sf, "part").select("p_partkey", flags.alias("flags"))
