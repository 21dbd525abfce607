import hashlib

import duckdb
import pytest
from framesift.llm import periodic_runs as m
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain(w):
    """Every maximal stretch of every lag, kept if no smaller period fits it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            piece = w[s:i + q]
            if i > s and len(piece) >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((s, len(piece), q))
            i += 1
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=6), st.integers(1, 7)), max_size=8))
def test_runs_equal_the_plain_scan(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert m.runs_of(words) == plain(words)
    ids = m.numbered(words)  # segments left after one round are larger, the scan is exact all the same
    assert sorted((a + s, n, q) for a, b in m.segments(ids, 1) for s, n, q in m.lag_scan(ids[a:b])) == plain(words)


@pytest.mark.parametrize("words, want", [
    ([], []), ([b"a"] * 5, []), ([b"a"] * 6, [(0, 6, 1)]), ([b"a", b"b"] * 4, [(0, 8, 2)]), ([b"a", b"b"] * 3 + [b"a"], []),
    ([b"x"] + [b"a", b"b", b"c"] * 4 + [b"a", b"y"], [(1, 13, 3)]),
    ([b"a"] * 6 + [b"b"] + [b"a"] * 6 + [b"b"] + [b"a"] * 6 + [b"b"] + [b"a"] * 6 + [b"b"], [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
])
def test_edges(words, want):
    assert m.runs_of(words) == want == plain(words)


def test_long_texts():
    assert m.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert m.runs_of([b"%d" % (i % 900) for i in range(300_000)]) == [(0, 300_000, 900)]
    assert m.runs_of([b"%d" % (i * i % 7919) for i in range(20_000)]) == []


def test_rows(spark):
    same = "to be or not " * 5
    rows = [(1, same, "x"), (1, same, "x"), (None, None, None), (4, "", "y"), (5, "é è " * 6 + "end", "z"), (6, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("runs", F.lit(7))
    got = m.detected(docs.repartition(3)).select("_row.*", F.col("found").alias("f")).collect()
    assert len(got) == 6 and all(r.runs == 7 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].f.n_runs == 1 and (by[1].f.start, by[1].f.length, by[1].f.period, by[1].f.exponent_milli) == (0, 20, 4, 5000)
    assert by[1].f.collapsed == "to be or not" and by[1].found == "x" and [tuple(r) for r in by[1].f.runs] == [(0, 20, 4)]
    assert by[1].f.runs_sha256 == hashlib.sha256(b"0,20,4\n").hexdigest()
    assert by[5].f.collapsed == "é è end" and by[5].f.period == 1
    for key in (None, 4):
        assert by[key].f.n_runs == 0 and by[key].f.start is None and by[key].f.collapsed == "" and by[key].f.runs_sha256 == hashlib.sha256().hexdigest()
    assert by[6].f.collapsed == "one two"
    assert m.detected(docs.limit(0)).collect() == []


def test_query_equals_sql(spark, docs_of):
    words = "the of and a in to is that it for".split()
    rows = [(k, None if k % 11 == 0 else " ".join(words[(i * i + k) % (2 + k % 9)] for i in range(k % 140))) for k in range(300)]
    documents = docs_of(rows).toPandas()  # noqa: F841
    want = duckdb.sql(m.ORACLE)
    got = m.detected(docs_of(rows), key="doc_id", with_text=False, change=m.planted).select("_row.doc_id", "found.*").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
