"""Best-fit packing by large-item matching, worked out on the histogram of lengths.

Items of one length are alike, so the packing is decided for whole length classes: at most `capacity`
counts reach the driver, whatever the number of documents, and every piece then finds its place from
its length and its number within that length.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from json import loads
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.llm.tables import read, small_batches, written

CAPACITY, END = 4096, np.uint32(1).tobytes()
KNOWN_WORDS = 400_000  # size of a worker's word memory; it starts afresh beyond that
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~\u00C0-\u012F\u0131-\u024F]+")
STOP = "\x01"  # stands for the end of a word; no plain word holds it


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary drops white space and merges nothing across it, so a text's ids are those of its
    words. New words go through a byte-pair encoder in one call (its ranks are the vocabulary's ids, the
    end-of-word mark is one more byte); words with special tokens or letters outside Latin go through
    the vocabulary's own tokenizer. Tests hold both against it.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            vocab = loads(f.read())["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.last, ranks = np.zeros(max(vocab.values()) + 1, bool), {}
        for token, i in vocab.items():
            if token.startswith("<|"):
                continue
            whole = token.removesuffix("</w>") if token != "</w>" else token
            self.last[i] = whole != token
            ranks[bytes(byte_of[c] for c in whole) + STOP.encode() * (whole != token)] = i
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{STOP}]+{STOP}", mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: set[bytes]) -> None:
        plain, counts, pieces = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                parts = [text.lower()] if text.isalpha() else PIECES.findall(text.lower())
                plain.append(w)
                counts.append(len(parts))
                pieces += parts
            else:
                self.known[w] = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if not plain:
            return
        ids = np.array(self.fast.encode_ordinary(STOP.join(pieces) + STOP), np.uint32)
        stops = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])[np.concatenate([[0], np.cumsum(counts)])] * 4
        raw = ids.tobytes()
        self.known.update(zip(plain, map(raw.__getitem__, map(slice, stops[:-1].tolist(), stops[1:].tolist()))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self.learn({w for words in split for w in words if w not in self.known})
        return [b"".join([self.known[w] for w in words]) for words in split]


def encoder(path: str) -> WordEncoder:
    """The worker process's encoder; kept outside this module, whose functions arrive anew with each task."""
    kept = sys.__dict__.setdefault("_framesift_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, _task, _number): every text as pieces of at most `capacity` ids.

    Only texts longer than `capacity` are cut. A null or empty text is its end mark alone. `_number`
    counts the task's pieces of that length; the table is written once, so the numbers hold.
    """
    small_batches(docs.sparkSession)
    path, kind = vocabulary or vocabulary_path(), docs.schema[key].dataType.simpleString()

    def pieces(batches):
        enc, task, numbers = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            at, piece, length, crc, number = [], [], [], [], []
            for i, ids in enumerate(enc.encode(b["_text"].to_pylist())):
                ids += END
                for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s:s + 4 * capacity]
                    n = len(part) // 4
                    at.append(i)
                    piece.append(p)
                    length.append(n)
                    crc.append(crc32(part))
                    number.append(numbers[n])
                    numbers[n] += 1
            piece = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b["_key"].take(pa.array(at, pa.int64())), piece, pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(at), task, np.int64)), pa.array(number, pa.int64())],
                [key, "piece", "start", "length", "ids_crc32", "_task", "_number"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(pieces, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _task long, _number long"), "pack_pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first item, first bin, items per bin, offset): item i of a length lies in the run with
    the largest first item not above i, in bin first_bin + (i - first) // per_bin.

    Lengths above a third of the capacity come first, longest first, each with the longest partner that
    still fits beside it. Shorter ones, longest first, go to the smallest gap that takes them.
    """
    left, taken, runs, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps in use, sorted

    def place(length, first_bin, n_bins, each, offset):
        runs.append((length, taken[length], first_bin, each, offset))
        taken[length] += n_bins * each
        left[length] -= n_bins * each

    def leave(gap, first_bin, n_bins):
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first_bin, n_bins))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        for partner in large:
            if partner > min(length, capacity - length) or not left[partner]:
                continue
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            if n:
                place(length, bins, n, 1, 0)
                place(partner, bins, n, 1, length)
                leave(capacity - length - partner, bins, n)
                bins += n
            if not left[length]:
                break
        if n := left[length]:
            place(length, bins, n, 1, 0)
            leave(capacity - length, bins, n)
            bins += n

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while n := left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                gap = capacity
                first_bin, n_bins = bins, -(-n // (gap // length))
                bins += n_bins
            else:
                gap = order[at]
                first_bin, n_bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(n_bins, n // each)
            if full:
                place(length, first_bin, full, each, capacity - gap)
                leave(gap - each * length, first_bin, full)
            if full < n_bins and left[length]:
                rest = left[length]
                place(length, first_bin + full, 1, rest, capacity - gap)
                leave(gap - rest * length, first_bin + full, 1)
                full += 1
            if full < n_bins:
                leave(gap, first_bin + full, n_bins - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and null keys are packed like any other. Within a sequence the offsets leave no gap.
    """
    pieces = cut(docs, key, text, capacity, vocabulary)
    tasks = written(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")), "pack_counts")
    counts = {r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    starts = tasks.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_first"))
    numbered = pieces.join(starts, ["length", "_task"]).withColumn("_item", F.col("_first") + F.col("_number"))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def assign(batches):
        runs = shared.value
        reach = 1 << 48  # above any number of pieces of one length
        firsts = runs[:, 0] * reach + runs[:, 1]
        for b in batches:
            length, item = b["length"].to_numpy(), b["_item"].to_numpy()
            run = runs[np.searchsorted(firsts, length * reach + item, "right") - 1]
            bin_, nth = np.divmod(item - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(run[:, 2] + bin_), pa.array(run[:, 4] + nth * length)], [*names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return numbered.select(*names, "_item").mapInArrow(assign, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
