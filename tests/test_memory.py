"""Steps that need few sorts in one task, whose memory is what a task needs, and give the same rows cut or not."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from framesift.operators import allocate as A
from framesift.operators import components, ordered
from framesift.operators.components import connected_components
from framesift.operators.intervals import cell_cover
from framesift.operators.ordered import dealt
from framesift.plans import fixtures
from framesift.session import shared_folder
from framesift.sources.manifest import finalize


def sorted_steps(df):
    """Sorts of the physical plan before adaptive execution."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*()0123456789").startswith("Sort ") for line in plan.splitlines())


def videos(spark):
    rnd = random.Random(3)
    rows = [(k, k * 100 + i, rnd.randrange(30), rnd.choice([100.0, 900.0, 2500.0, 5000.0])) for k in range(12) for i in range(rnd.randrange(1, 40))]
    return spark.createDataFrame([*rows, (None, -1, 3, 5.0)], "k long, vid long, day int, size double")


def test_choose_single_sorts_once(spark, rows):
    v = videos(spark)
    light, cut = (A.choose_single(v, ["k"], ["day", "vid"], "size", 3500.0, 9000.0, 2, 6, hot) for hot in (None, 5))
    assert rows(light, "vid", "count") == rows(cut, "vid", "count")
    assert sorted_steps(light) == 1
    by_count = [{r["vid"] for r in A.spread(v, ["k"], ["day", "vid"], c, "size", 3500.0, None).collect()} for c in range(2, 7)]
    assert all(r["vid"] in by_count[r["count"] - 2] for r in light.collect())


def test_split_quota_sorts_twice(spark, rows):
    v = videos(spark).withColumn("total", F.lit(17).cast("long"))
    light, cut = (A.split_quota(v, ["k"], "vid", "total", "size", hot) for hot in (None, 5))
    assert rows(light, "vid", "quota") == rows(cut, "vid", "quota")
    assert sorted_steps(light) == 2


def most_rows(df):
    """Rows in the fullest part."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_parts_follow_the_rows(spark, monkeypatch):
    rows = spark.range(4000).withColumn("k", F.col("id") % 1000)
    assert dealt(rows, ["k"]).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert most_rows(dealt(rows, ["k"], task_rows=100)) < 400
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    chain = spark.range(400).select((F.col("id") * 2).cast("string").alias("src"), (F.col("id") * 2 + 1).cast("string").alias("dst"))
    out = connected_components(chain)
    assert out.count() == 800 and out.rdd.getNumPartitions() == 16


def test_steps_take_the_parts(spark, monkeypatch):
    """Spans, series, cells and finalized rows come in as many parts as their number asks for."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    lines, events = (spark.read.parquet(f"{sf}/{n}.parquet").count() for n in ("lineitem", "events"))
    assert fixtures.spans(spark, sf).rdd.getNumPartitions() == -(-lines // 100)
    assert fixtures.series(spark, sf, None).rdd.getNumPartitions() == -(-events // 100)
    clips = spark.range(20).selectExpr("id AS clip_id", "132.0D AS duration", "true AS known")
    spans = spark.createDataFrame([(1, 0.0, 7.0)], "clip_id long, a double, b double")
    cells = cell_cover(clips, spans, 5.0)
    assert cells.count() == 540 and ", 6), REPARTITION_BY_NUM" in cells._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).selectExpr("id % 300 AS key", "id AS sample_id")
    kept, missing = finalize(spark.range(301).toDF("key"), rows, rows.selectExpr("sample_id", "'keep' AS decision"))
    assert kept.count() == 1000 and missing.count() == 1 and kept.rdd.getNumPartitions() == 10


def groups_of(edges):
    """Node → smallest node of its group, by plain union."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components_equal_plain_groups_in_any_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 4)
    monkeypatch.setattr(components, "HELD", 16)
    rnd = random.Random(2)
    some = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(600)]
    chain = [(1000 + i, 1001 + i) for i in range(400)]
    hub = [(2000, 2000 + i) for i in range(300)]
    edges = some + chain + hub + [(5000, 5000), (6000, None), (None, None)]
    rnd.shuffle(edges)
    want = groups_of([(a if a is not None else b, b if b is not None else a) for a, b in edges if (a, b) != (None, None)])
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    found = components.number_components(df).collect()
    least = {}
    for r in found:
        least[r["root"]] = min(least.get(r["root"], r["node"]), r["node"])
    assert len(found) == len(want) and {r["node"]: least[r["root"]] for r in found} == want
    names = connected_components(df.selectExpr("lpad(src, 5, '0') AS src", "lpad(dst, 5, '0') AS dst")).collect()
    assert {r["node"]: r["component"] for r in names if r["node"]} == {f"{n:05d}": f"{c:05d}" for n, c in want.items()}


def test_components_write_less_than_their_edges(spark):
    """A graph of many edges and few nodes goes to disk as nodes, not as edges in every round."""
    folder = Path(shared_folder(spark).replace("file:", ""))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    edges = spark.range(300_000).selectExpr("concat('a', pmod(hash(id), 400)) AS src", "concat('b', pmod(hash(id, 1), 400)) AS dst")
    assert connected_components(edges).agg(F.count("*"), F.countDistinct("component")).first()[:] == (800, 1)
    assert size() - before < 500_000
