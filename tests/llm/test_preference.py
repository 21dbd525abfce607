from framesift.llm import preference
from pyspark.sql import functions as F


def plain(chosen, other):
    n = 0
    while n < min(len(chosen), len(other)) and chosen[n] == other[n]:
        n += 1
    text = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            if r == "assistant":
                out.append(f"{at + len(r) + 5}:{at + len(r) + len(t) + 12}")
            at += len(r) + len(t) + 13
        return ",".join(out)

    return n, text(chosen[:n]), text(chosen[n:]), text(other[n:]), mask(chosen[n:]), mask(other[n:])


def test_pairs(spark):
    base = [("user", "hi é"), ("assistant", "yes?"), ("user", "tell 𝄞")]
    cases = [(base + [("assistant", "good")], base + [("assistant", "bad"), ("user", "x")]), (base, base), (base, base[:1]), (base[:1], base[1:]), ([], base), (base, []), ([("assistant", "z" * 100_000)], base)]
    rows = [(2 * k + s, i, r, t) for k, pair in enumerate(cases) for s, turns in enumerate(pair) for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pair_id", F.lit(1)).withColumn("n_prefix", F.lit(1))
    got = {r.pair_id: r for r in preference.formatted(turns.repartition(5), F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 1).collect()}
    assert got.keys() == set(range(len(cases)))
    for k, (a, b) in enumerate(cases):
        r = got[k]
        assert (r.n_prefix, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == plain(a, b)
        assert r.paired == bool(a and b)
        for span in filter(None, r.chosen_mask.split(",")):
            s, e = map(int, span.split(":"))
            assert r.chosen[s:e].endswith("<|end|>")


def test_nulls_marks_and_empty(spark):
    kind = "conv_id long, turn int, role string, text string"
    run = lambda rows: preference.formatted(spark.createDataFrame(rows, kind), F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 1).collect()
    r = run([(0, None, None, None), (0, 1, "user", "<|end|>"), (1, None, None, ""), (1, 1, "user", "b"), (1, 1, "user", "b")])[0]
    assert r.n_prefix == 1 and r.prompt == "<||>\n<|end|>\n" and "< |end|>" in r.chosen and r.rejected.count("b<|end|>") == 2
    assert run([]) == []
