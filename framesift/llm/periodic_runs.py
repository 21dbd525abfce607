"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run of period q is at least max(6, 4q) words long, so every word in it stands there four times or more. Words
that occur less often within a segment can belong to no run and split it; pieces are split again by their own
counts until nothing changes. Ordinary prose vanishes this way, and only repetitive stretches are scanned.
Each text is one row and one task's work; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framesift.llm.tables import WORD, crc32_sql, read, small_batches

REPEATS, SHORTEST = 4, 6  # a run holds at least four periods and six words
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd; hashes only propose, equality is decided on the words
ROUNDS = 64  # rounds of splitting before what is left goes to the scan as it is; the scan is exact on any segment


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Stretches [start, stop) in which every word occurs at least REPEATS times.

    All open pieces are split in one pass: words are counted per (piece, word), those too rare become
    borders, and pieces shorter than SHORTEST are dropped. A piece without a border is done.
    """
    done, n = [], len(ids)
    at = np.flatnonzero(np.bincount(ids, minlength=1)[ids] >= REPEATS) if n >= SHORTEST else np.empty(0, np.int64)
    for _ in range(rounds):
        if not len(at):
            return sorted(done)
        # `at` holds the positions still open; a gap in it is a border.
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        sizes = np.diff(np.append(starts, len(at)))
        keep = np.repeat(sizes >= SHORTEST, sizes)
        at, sizes = at[keep], sizes[sizes >= SHORTEST]
        if not len(at):
            return sorted(done)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        _, which, count = np.unique(piece * n + ids[at], return_inverse=True, return_counts=True)
        enough = count[which] >= REPEATS
        split = np.bincount(piece, weights=~enough, minlength=len(sizes)) > 0
        first = np.cumsum(sizes) - sizes
        done += [(int(at[f]), int(at[f]) + int(s)) for f, s in zip(first[~split], sizes[~split])]
        at = at[enough & split[piece]]
    rest = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return sorted(done + [(int(p[0]), int(p[-1]) + 1) for p in rest if len(p) >= SHORTEST])


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two equally long arrays, compared in growing pieces."""
    at, step, n = 0, 64, len(a)
    while at < n:
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in x.

    A run of period q holds three equal neighbouring blocks [kq, kq + q), so only multiples of q are looked
    at, in all n/1 + n/2 + ... of them; block hashes come from prefix hashes. Candidates are extended by
    comparing words. Periods are taken upwards: three blocks that lie inside a run already found have
    that run's smaller period.
    """
    n, out = len(x), []
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)))
    covered = np.zeros(n, np.int64)  # end of the furthest run found so far that holds the position
    for q in range(1, n // REPEATS + 1):
        edges = prefix[0::q]
        block = np.diff(edges)
        if len(block) < 3:
            break
        step = powers[q]
        same = block[:-1] * step == block[1:]
        hits = np.flatnonzero(same[:-1] & same[1:]) * q
        until = -1
        for c in hits[covered[hits] < hits + 3 * q].tolist():
            if c + q <= until:
                continue
            stop = c + reach(x[c:n - q], x[c + q:])
            start = c - reach(x[:c][::-1], x[q:c + q][::-1])
            until = stop
            end = stop + q
            if end - start >= max(SHORTEST, REPEATS * q):
                out.append((start, end - start, q))
                covered[start:end] = np.maximum(covered[start:end], end)
    return out


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    ids = numbered(words)
    return sorted((a + s, n, q) for a, b in segments(ids) for s, n, q in lag_scan(ids[a:b]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in found:
        kept[start + q:start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The query's own test pattern: one key in ten gets a periodic tail, fixed by the key's checksum."""
    n, h = len(words), crc32(b"" if key is None else b"%d" % key)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
                     + [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
                        T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


def described(words: list[bytes], with_text: bool) -> tuple:
    found = runs_of(words)
    left = b" ".join(collapsed(words, found))
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    head = (len(found), *(top if top else (None,) * 3), 1000 * top[1] // top[2] if top else None)
    rows = [dict(zip(("start", "length", "period"), r)) for r in found] if with_text else None
    return *head, rows, hashlib.sha256(listed).hexdigest(), left.decode("utf-8", "replace") if with_text else None, hashlib.sha256(left).hexdigest()


def detected(docs: DataFrame, text: str = "text", key: str | None = None, with_text: bool = True, change=None) -> DataFrame:
    """(_row, found) for every row: all its columns packed, and what its text holds.

    found has n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then
    period; null without a run); runs, every run by start, then period; the collapsed text, in which each run
    is cut to its first period, words joined by one space; and two hashes of the runs and the collapsed text.
    Words are runs of anything but ASCII white space. A null or empty text has no words and no runs; repeated
    rows each get their own result; an empty table gives an empty one. `change(words, key)` may alter the words
    first. `with_text=False` leaves runs and collapsed text null.

    Counting and scanning a text of n words takes O(n log n) steps and memory for a few numbers a word.
    """
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("_row", docs.schema), T.StructField("found", FOUND)])
    arrow = pa.struct([pa.field(n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [
        pa.field("runs", pa.list_(pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")]))),
        pa.field("runs_sha256", pa.string()), pa.field("collapsed", pa.string()), pa.field("collapsed_sha256", pa.string())])

    def batches(parts):
        for part in parts:
            texts = part.column(part.schema.get_field_index(text)).cast(pa.binary())
            keys = part.column(part.schema.get_field_index(key)) if key else None
            found = []
            for i in range(part.num_rows):
                words = (texts[i].as_py() or b"").split()
                if change:
                    words = change(words, keys[i].as_py() if keys is not None else None)
                found.append(dict(zip(FOUND.names, described(words, with_text))))
            whole = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            yield pa.RecordBatch.from_arrays([whole, pa.array(found, arrow)], names=["_row", "found"])

    return docs.mapInArrow(batches, kind)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return detected(docs, key="doc_id", with_text=False, change=planted).select(
        "_row.doc_id", "found.n_runs", "found.start", "found.length", "found.period", "found.exponent_milli", "found.runs_sha256", "found.collapsed_sha256")


ORACLE = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS w, n FROM p),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
f AS (SELECT doc_id, n, i, word FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, word) >= 4),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM f l JOIN f r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'q': q}}, {{'x': -length, 's': start, 'q': q}}) AS b,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY 1),
o AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN o USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
