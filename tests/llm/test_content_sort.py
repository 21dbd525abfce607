import hashlib
from collections import defaultdict

import pytest
from framesift.llm import content_sort
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain(rows, normalise=lambda t: t, largest=False):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normalise(text or "")].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = (max(known) if largest else min(known)) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        ranked = sorted(keys, key=lambda k: (k != best, str(k)))
        out += [(k, best, len(keys), i == 0, sha) for i, k in enumerate(ranked)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("_key", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = [(5, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (9, "A  b "), (1, None), (2, ""), (None, "lonely"), (7, "é" * 31 + "x"), (8, "é" * 31 + "y"),
        (4, "long " * 200_000), (6, "long " * 200_000), (10, "long " * 200_000 + "!")]


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(spark, docs_of, hot, keep):
    docs = docs_of(ROWS).repartition(5)
    assert got(content_sort.marked(docs, keep=keep, hot_rows=hot)) == plain(ROWS, largest=keep == "largest")
    folded = content_sort.marked(docs, normalise=content_sort.folded, keep=keep, hot_rows=hot)
    assert got(folded) == plain(ROWS, lambda t: " ".join(t.lower().split()), keep == "largest")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.text("ab\x00é", max_size=2))), max_size=40))
def test_any_rows(spark, docs_of, rows):
    for hot in (256, 2):
        assert got(content_sort.marked(docs_of(rows), keep="largest", hot_rows=hot)) == plain(rows, largest=True)


def test_hot_text_is_split(spark):
    """A third of all rows with one text, whole and split, give the same groups."""
    docs = spark.range(6000, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    whole, split = (got(content_sort.marked(docs, hot_rows=n)) for n in (10_000, 50))
    assert whole == split and sum(r[3] for r in whole) == 4001
    sizes = content_sort.marked(docs, hot_rows=50).where("group_size = 2000").agg(F.count_if("kept"), F.count("*")).first()
    assert tuple(sizes) == (1, 2000)


def test_rows_survive_clashing_names_and_empty(spark):
    rows = [(1, "x", "p", {"a": 1}), (2, "x", "q", None), (3, "y", None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _body map<string,int>").withColumn("kept", F.lit(False)).withColumn("_hash", F.lit("h"))
    kept = content_sort.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert [r._row for r in content_sort.deduplicated(docs, hot_rows=0, keep="largest").orderBy("doc_id").collect()] == ["q", None]
    assert content_sort.marked(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        content_sort.marked(docs, keep="first")
