from collections import Counter

import corpus_pipeline
from framesift.llm import mixing, near_join, packing, privacy, quality
from framesift.llm.catalogue import ORACLES, QUERIES


def test_names():
    assert [n for n in QUERIES if n.startswith("op")] == [n for i in range(1, 11) for n in QUERIES if n.startswith(f"op{i}_")] and "pipeline" in QUERIES
    assert ORACLES.keys() <= QUERIES.keys() and corpus_pipeline.ORACLE_SQL is None


def test_stages_one_by_one(spark):
    """Each stage against what its operator says about the stage's own input, row by row."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    (_, good), (_, once), (_, hidden), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    a = good(spark, docs, sf).cache()
    verdict = {r.doc_id: r.kept for r in quality.assess(docs, quality.train(docs, labels)).select("_row.doc_id", "quality_rules.kept").collect()}
    assert sorted(r.doc_id for r in a.collect()) == sorted(k for k, v in verdict.items() if v)
    b = once(spark, a, sf).cache()
    classes = {r.doc_id: r.class_id for r in near_join.joined(a).collect()}
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(classes.values()))
    c = hidden(spark, b, sf).cache()
    texts = {r.doc_id: r.text for r in b.collect()}
    spans = {r.doc_id: r for r in privacy.examined(b).select("_row.doc_id", "spans", "term_spans").collect()}
    for r in c.collect():
        want, at = "", 0
        for s in sorted([*spans[r.doc_id].spans, *spans[r.doc_id].term_spans], key=lambda s: (s.start, s.end)):
            if s.start >= at:
                want += texts[r.doc_id][at:s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert r.text == want + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    d = mixed(spark, c, sf).cache()
    sized = mixing.sized(c)
    times = {r.doc_id: r.copies for r in mixing.copies(sized, mixing.source_rates(sized)).collect() if r.copies}
    assert Counter(r.doc_id for r in d.collect()) == times
    for frame in (a, b, c, d):
        assert frame.columns == docs.columns
    e = packed(spark, d, sf).collect()
    enc = packing.WordEncoder(packing.vocabulary_path())
    ids = {r.doc_id: len(enc.encode([r.text])[0]) // 4 + 1 for r in c.collect()}
    assert sum(r.length for r in e) == sum(ids[k] * n for k, n in times.items())


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0
