"""Quality rules: plain text measures, and a calibrated n-gram classifier scored against fixed thresholds."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.linear import calibrate, fit_logistic, sigmoid
from framesift.llm.tables import read, small_batches, uniform

BLANKS, SYMBOLS = " \t\n\r\v\f", "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated windows
KEEP_FROM = 0.5  # calibrated probability of quality 1
SAMPLE = 2500  # labelled rows the classifier is fitted on, at most
DIM = 1 << 18
SCALE = 30.0  # features are shares of a text's n-grams, times this


def measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if "\n" in text else []
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def feature_groups(data: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Hashed slots of words, word pairs and character triples (bytes of the text), one array each."""
    ids = np.fromiter(map(crc32, words), np.uint32, len(words))
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    chars = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1) if len(raw) > 2 else raw[:0]
    pairs = ids[:-1] * np.uint32(0x85EBCA6B) + ids[1:] * np.uint32(0xC2B2AE35)
    return [x >> np.uint32(14) for x in (ids * np.uint32(0x27D4EB2F), pairs ^ np.uint32(0x5BD1E995), chars)]


def sparse_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text for the fit."""
    data = text.encode("utf-8", "surrogatepass")
    slots, values = [], []
    for part in feature_groups(data, data.split()):
        slot, count = np.unique(part, return_counts=True)
        slots.append(slot)
        values.append(count * (SCALE / max(len(part), 1)))
    slot, where = np.unique(np.concatenate(slots), return_inverse=True)
    return slot, np.bincount(where, weights=np.concatenate(values), minlength=len(slot))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Weights and calibration from at most `sample` labelled rows, chosen by the hash of their id.

    Rows whose id or label is null, or whose text is missing, teach nothing; a repeated id counts once
    with its lower label. Four of five rows fit the weights, the fifth sets the calibration. None if a
    class is missing.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("good"))
              .orderBy(uniform(F.lit("quality"), "doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for b in batches:
            got = [sparse_row(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].cast(pa.int64()), "good": b["good"], "slot": pa.array([g[0] for g in got], pa.list_(pa.int32())),
                                              "value": pa.array([g[1] for g in got], pa.list_(pa.float32()))})

    table = rows.mapInArrow(features, "doc_id long, good double, slot array<int>, value array<float>").toArrow().sort_by("doc_id")
    good = table["good"].to_numpy()
    if not 0 < good.sum() < len(good):
        return None
    starts = np.concatenate([[0], np.cumsum(table["slot"].combine_chunks().value_lengths().to_numpy())])
    slot, value = (table[c].combine_chunks().flatten().to_numpy() for c in ("slot", "value"))
    fit = np.arange(len(good)) % 5 < 4
    owner = np.repeat(np.arange(len(good)), np.diff(starts))
    own = fit[owner]
    w, b = fit_logistic(np.concatenate([[0], np.cumsum(np.diff(starts)[fit])]), slot[own], value[own], good[fit], DIM)
    score = np.bincount(owner, weights=value * w[slot], minlength=len(good)) + b
    slope, offset = calibrate(score[~fit], good[~fit])
    return {"w": w.astype(np.float32), "b": b, "slope": slope, "offset": offset}


def assess(docs: DataFrame, model: dict | None, text: str = "text", keep_from: float = KEEP_FROM,
           carry: list[str] | None = None) -> DataFrame:
    """Every document (or its columns `carry`), packed as `_row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality (calibrated probability) and kept, as one struct column `quality_rules`.

    A null text has no words and so fails the word count; without a model (no labels of one class) the
    base rules decide alone and the probability is null. Whole texts are read, one Arrow batch at a time.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a quarter of a million weights, 1 MB
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = ", ".join(f"{n}: bigint" for n in names)
    fields = f"struct<{kinds}, base_failed: boolean, quality: double, kept: boolean>"

    def score(batches):
        m = shared.value
        for b in batches:
            rows = []
            for t in b["_text"].to_pylist():
                t = t or ""
                data = t.encode("utf-8", "surrogatepass")
                words = data.split()
                got = measures(t, words)
                failed = got[0] < MIN_WORDS or 100 * got[4] > MAX_REPEATED * got[0]
                p = None
                if m:
                    x = m["b"] + SCALE * sum(float(m["w"][g].mean()) for g in feature_groups(data, words) if len(g))
                    p = float(sigmoid(m["slope"] * x + m["offset"]))
                rows.append(dict(zip(names, got), base_failed=failed, quality=p, kept=not failed and (p is None or p >= keep_from)))
            out = pa.array(rows, pa.struct([(n, pa.int64()) for n in names] + [("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b["_row"], out], ["_row", "quality_rules"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("_row"), F.col(text).alias("_text"))
    kind = packed.schema["_row"].dataType.simpleString()
    return packed.mapInArrow(score, f"_row {kind}, quality_rules {fields}")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return assess(docs, train(docs, labels)).where("quality_rules.kept").select("_row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return assess(docs, model, carry=["doc_id"]).select("_row.doc_id", "quality_rules.*")
