import random
from zlib import crc32

import numpy as np
import pytest

from framesift.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


ODD = ["", None, "don't I'LL we've a'b's 'tis <|endoftext|>x a<|startoftext|>", "é É İstanbul ΣΑΣ ß x\x1cy y　z 日本語 😀👍🏽 a1b2 12.5% ...!!",
       "a" * 5000 + " " + "?!" * 900, "naïve Ångström ×÷ ǅ ǆ İ Ḱ x\x01y", "tab\tnew\nline\r\x0b\x0c end", "the cat " * 6000, "    x"]


def test_word_encoder_is_the_tokenizer(tokenizer):
    texts = ODD + [" ".join(random.Random(i).choices(["the", "Thé", "cat's", "x9", "run-on", "end."], k=50)) for i in range(50)]
    got = packing.WordEncoder(packing.vocabulary_path()).encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, np.uint32).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_word_encoder_on_documents(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = packing.WordEncoder(packing.vocabulary_path()).encode(texts)
    assert all(np.frombuffer(g, np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t, g in zip(texts, got))


def place_all(counts, capacity):
    """Every item's bin and offset by the runs of the plan."""
    runs, bins = packing.plan(counts, capacity), {}
    for length, n in counts.items():
        own = runs[runs[:, 0] == length]
        for item in range(n):
            _, first, base, each, offset = own[np.searchsorted(own[:, 1], item, "right") - 1]
            bins.setdefault(base + (item - first) // each, []).append((offset + (item - first) % each * length, length))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_without_gap_or_overlap(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 60, 4096])
    counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 25))}
    bins = place_all(counts, capacity)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    assert sum(len(i) for i in bins.values()) == sum(counts.values())
    total = sum(x * n for x, n in counts.items())
    assert len(bins) <= 11 / 9 * max(-(-total // capacity), sum(n for x, n in counts.items() if 2 * x > capacity)) + 2


def test_pack_whole_texts(spark, docs_of, tokenizer):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "null key")]
    docs = docs_of(rows)
    got = packing.pack(docs).collect()
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = ids[p:p + 4096]
            want[i, p // 4096] = want.get((i, p // 4096), []) + [(p, len(part), crc32(np.array(part, np.uint32).tobytes()))]
    mine = {}
    for r in got:
        mine.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs_of([])).count() == 0
