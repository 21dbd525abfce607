import re
from collections import Counter

from pyspark.sql import functions as F

from framesift.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


TEXTS = [None, "", " \n\t", "a b c a b c", "x y  z é# $$", "l\nl\n\n \nl\r\nl", "the cat sat on the mat " * 30, " ".join(f"w{i}" for i in range(60)),
         "a a a a", "one two", "𝄞 wide | pipe <x>", "k" * 100_000, " ".join(f"w{i % 40}" for i in range(20_000))]


def test_measures_against_plain_loops(docs_of):
    rows = quality.assess(docs_of(list(enumerate(TEXTS))), None).select("_row.doc_id", "quality_rules.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id]), r
        assert r.kept == (not r.base_failed) and r.quality is None


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    taught, held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 > 0), labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0)
    model = quality.train(docs, taught)
    out = quality.assess(docs, model).select("_row.doc_id", "quality_rules.*").join(held, "doc_id").where("NOT base_failed")
    good, bad = out.where(held["quality"] == 1), out.where(held["quality"] == 0)
    assert good.where("kept").count() >= 0.97 * good.count() > 0
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_filter_keeps_columns_and_survives_odd_tables(spark, docs_of):
    odd = docs_of([(None, None), (1, " ".join(f"w{i}" for i in range(60))), (1, " ".join(f"w{i}" for i in range(60)))]).withColumn("quality", F.lit("q")).withColumn("kept", F.lit(False))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.filtered(odd, none)
    assert out.columns == odd.columns and out.count() == 2
    assert quality.filtered(docs_of([]), none).count() == 0
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, nulls) is None
