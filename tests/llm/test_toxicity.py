import numpy as np
from pyspark.sql import functions as F

from framesift.llm import toxicity


def test_held_out_rows(spark):
    out = toxicity.op4(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.95
    assert (good < 0.5).mean() > 0.97 and (bad >= 0.5).mean() > 0.85
    assert ((out.predicted == 1) == (out.score >= 0.5)).all() and out.score.between(0, 1).all()


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    y = r.random(6000) < 0.15
    votes = [(r.random(6000) < np.where(y, hit, false)) for hit, false in ((0.6, 0.002), (0.5, 0.004), (0.4, 0.001), (0.3, 0.25))]
    votes.insert(1, votes[0] & (r.random(6000) < 0.95))  # a near copy of the first voter
    bits = sum(v.astype(np.int64) << i for i, v in enumerate(votes))
    names, counts = np.unique(bits, return_counts=True)
    model = toxicity.LabelModel(names, counts.astype(float), bits[:800], y[:800].astype(int), 4, 5)
    assert any({0, 1} <= set(g) for g in model.groups)  # correlated voters are modelled together
    assert abs(model.prior - 0.15) < 0.04
    spoken = (bits & 15) > 0
    assert ((model.posterior(bits) >= 0.5) == spoken)[spoken | ~y].mean() > 0.97


def test_odd_tables(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "you are"), (2, "")]).withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert model is None and {r.score for r in toxicity.scored(docs, model).collect()} == {0.0}
    taught = docs_of([(i, f"word{i % 5} plain text" + (" awful scoundrel" if i % 3 == 0 else "")) for i in range(120)] + [(500, "z" * 200_000)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(taught, toxicity.train(taught, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(120))
    assert toxicity.scored(docs_of([]), None).count() == 0
