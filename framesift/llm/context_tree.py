"""Language-model scoring by context-tree weighting of bytes, beside a word-count base score.

Bytes are eight binary decisions each. Every context of 0 to DEPTH bytes keeps Krichevsky-Trofimov counts
for its decisions, and the tree weights all depths. Texts are handled in blocks. A block hands each group of
contexts one sorted, packed list of its byte runs and gets their scores back in the same order; words likewise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.tables import fold_of, read, small_batches, written

DEPTH, NEAR = 6, 3  # bytes of context; nearest bytes whose part of the tree lies in one group
BLOCK_BYTES = 16_000_000  # characters of a block; one longer text is a block of its own
PACK = 2_000_000  # characters of texts packed together
GROUP_BYTES = 64_000_000  # characters for each group of contexts; at least one group per shuffle partition
HELD = 1_600_000  # byte runs a task holds before it merges them
END = b" "  # stands for the end token among the words, none of which has a space
STEP = 2.0**34  # scores travel as whole numbers of 1 / STEP: 3e-11 of rounding a byte
HALF = float(np.log(0.5))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE, LINE = (np.isin(np.arange(256), list(c)) for c in (b" \t\n\v\f\r", b"\n"))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, kind=np.int64) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted whole numbers, as differences."""
    return squeezed(np.diff(x.astype(np.int64), prepend=np.int64(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data))


def listed(words: list[bytes]) -> bytes:
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unlisted(data: bytes) -> list[bytes]:
    return unlisted_words(data).to_pylist()


def unlisted_words(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:8], "little")
    return stretches(pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", LINE)[0]


def stretches(data: bytes, gap: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The longest stretches without a byte of `gap`, and where they begin."""
    raw = np.frombuffer(data, np.uint8)
    held = ~gap[raw]
    edge = np.flatnonzero(np.diff(held, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return binaries(np.concatenate([[0], np.cumsum(ends - starts)]), raw[held]), starts


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def laid(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the words."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)


def counted(words: pa.Array, uses: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the sums of their uses, and the place of each word among them."""
    found = words.dictionary_encode()
    at = found.indices.to_numpy()
    return found.dictionary, np.bincount(at, weights=uses, minlength=len(found.dictionary)).astype(np.int64), at


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(docs: DataFrame, key: str, text: str, held_out) -> DataFrame:
    """(block, size, docs): the documents packed, neighbours in the input sharing a block; written once."""
    small_batches(docs.sparkSession)
    most = BLOCK_BYTES

    def pack(batch):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def assign(batches):
        block, size = TaskContext.get().partitionId() << 28, 0
        for b in batches:
            row, cut, weight = [], 0, 0  # rows `cut` and later are not packed yet
            lengths = [len(n or "") for n in b["text"].to_pylist()]
            for i, n in enumerate(lengths):
                full = size and size + n > most
                if i > cut and (full or weight + n > PACK):
                    row.append((block, weight, pack(b.slice(cut, i - cut))))
                    cut, weight = i, 0
                if full:
                    block, size = block + 1, 0
                size, weight = size + n, weight + n
            if b.num_rows:
                row.append((block, weight, pack(b.slice(cut))))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in row], k) for c, k in enumerate(kinds)], ["block", "size", "docs"])

    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    return written(rows.mapInArrow(assign, "block long, size long, docs binary"), "lm_blocks")


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run of DEPTH + 1 bytes that ends at each byte of each text and at its end mark, and the text's number."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(pad + b"".join(t + b"\0" + pad for t in texts), np.uint8).astype(np.uint64)
    run = raw[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        run |= raw[DEPTH - k:-k] << np.uint64(8 * k)
    size = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(size + DEPTH)[:-1]])
    owner = np.repeat(np.arange(len(texts)), size)
    return run[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[owner]], owner


def run_names(texts: list[bytes], spare: int):
    """A number for each run of `runs_of`, in the same order as runs, and what turns numbers back into runs; None if
    that leaves fewer than `spare` bits. A run is named by its two three-byte stretches and its last byte, each
    numbered among those that occur."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(pad + b"".join(t + b"\0" + pad for t in texts), np.uint8)
    byte = np.flatnonzero(np.bincount(raw, minlength=256)).astype(np.uint64)
    letters = len(byte)
    if DEPTH != 6 or letters**3 > 8 * len(raw) + 1_000_000:
        return None
    number = np.zeros(256, np.uint32)
    number[byte.astype(np.intp)] = np.arange(letters)
    low = number[raw]
    code = low[:-2] * np.uint32(letters)
    code += low[1:-1]
    code *= np.uint32(letters)
    code += low[2:]
    seen = np.zeros(letters**3, bool)
    seen[code] = True
    some = np.flatnonzero(seen)
    if len(some) ** 2 * letters << spare >= 1 << 64:
        return None
    three = byte[some // letters**2] << np.uint64(16) | byte[some // letters % letters] << np.uint64(8) | byte[some % letters]
    place = (np.cumsum(seen, dtype=np.int32) - 1).astype(np.uint32)[code]
    del code
    many, wide = np.uint64(len(some)), np.uint64(letters)
    name = place[:-4].astype(np.uint64)
    name *= many
    name += place[3:-1]
    name *= wide
    name += low[DEPTH:]
    del place, low
    inside = np.ones(len(name), bool)
    inside[((np.cumsum([len(t) + 1 + DEPTH for t in texts]) - DEPTH)[:, None] + np.arange(DEPTH)).ravel()] = False

    def back(name):
        stretch, last = np.divmod(name, wide)
        far, near = np.divmod(stretch, many)
        return three[far] << np.uint64(32) | three[near] << np.uint64(8) | byte[last]

    return name[inside], back


def ranked_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `runs_of`, sorted, and the place of each byte's run among them: names and places share
    a number, so that one plain sort gives both."""
    size = sum(len(t) + 1 for t in texts)
    bits = size.bit_length()
    found = run_names(texts, bits)
    if found is None:
        run, at = np.unique(runs_of(texts)[0], return_inverse=True)
        return run, at.ravel().astype(np.int32)
    name, back = found
    name <<= np.uint64(bits)
    name |= np.arange(size, dtype=np.uint64)
    name.sort()
    where = (name & np.uint64((1 << bits) - 1)).view(np.int64)
    name >>= np.uint64(bits)
    new = np.r_[True, name[1:] != name[:-1]]
    at = np.empty(size, np.int32)
    at[where] = np.cumsum(new, dtype=np.int32) - 1
    return back(name[new]), at


def counted_runs(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `runs_of`, sorted, and how often they occur in the texts marked in `train`."""
    learned = np.repeat(train, [len(t) + 1 for t in texts])
    found = run_names(texts, 1)
    name, back = found or (runs_of(texts)[0], lambda run: run)
    name <<= np.uint64(1)  # a run has 56 bits, so there is always room for one more
    name |= learned
    name.sort()
    learned = (name & np.uint64(1)).view(np.int64)
    name >>= np.uint64(1)
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    return back(name[first]), stretch_sums(learned, first)


def stretch_sums(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the whole numbers from each place of `first` to the next."""
    total = np.cumsum(n)
    return np.diff(total[np.append(first[1:], len(n)) - 1], prepend=0)


def turned(run: np.ndarray) -> np.ndarray:
    """The run with its context bytes in opposite order, nearest first, so that sorting puts contexts with common
    nearest bytes together; turns it back as well."""
    return (run.byteswap() & np.uint64(0x00FFFFFFFFFFFF00)) | (run & np.uint64(255))


def dealt_runs(run: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned runs, their order by group and in it, and the groups in that order. A group holds all runs with
    the same NEAR nearest context bytes."""
    turn = turned(run)
    near = (turn >> np.uint64(8 * (DEPTH - NEAR + 1))) * np.uint64(0x9E3779B97F4A7C15)
    group = ((near >> np.uint64(33)) % np.uint64(groups)).astype(np.uint16 if groups < 1 << 16 else np.int32)  # 16 bits sort in one pass
    order = np.argsort(turn)
    order = order[np.argsort(group[order], kind="stable")]
    return turn, order, group[order]


def dealt_words(words: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of different words by group and in it, and the groups in that order."""
    group = np.array([zlib.crc32(w) % groups for w in words.to_pylist()], np.int32)
    order = pc.sort_indices(words).to_numpy()
    order = order[np.argsort(group[order], kind="stable")]
    return order, group[order]


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    words, starts = stretches(b" ".join(texts), SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def items(batches, groups: int):
    """What each block holds, one row per group: its byte runs and words, with their counts in training texts."""

    def passed_words():
        some, uses, _ = counted(pa.concat_arrays([*words, pa.array([END], pa.large_binary())]), np.concatenate([*used, [ends]]))
        words.clear()
        used.clear()
        order, group = dealt_words(some, groups)
        offsets, data = laid(pc.binary_join_element_wise(some.take(pa.array(order)), *(pa.scalar(x, pa.large_binary()) for x in (b"", b"\n"))))
        uses, edges = uses[order], np.searchsorted(group, np.arange(groups + 1))
        return [(listed([data[offsets[lo]:max(offsets[hi] - 1, offsets[lo])].tobytes()]), squeezed(uses[lo:hi])) for lo, hi in zip(edges, edges[1:])], np.diff(edges)

    def passed():
        mine, sizes = passed_words()
        run, n = merged(runs)
        runs.clear()
        turn, order, group = dealt_runs(run, groups)
        edges = np.searchsorted(group, np.arange(groups + 1))
        rows = []
        for g, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo < hi or sizes[g]:
                at = order[lo:hi]
                rows.append((g, block, rising(turn[at]), squeezed(n[at]), *mine[g]))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["grp", "block", "runs", "n", "words", "uses"])

    block, words, used, ends, runs, weight = None, [], [], 0, [], 0
    for b in batches:
        for at, docs in zip(b["block"].to_pylist(), b["docs"].to_pylist()):
            if at != block:
                if runs:
                    yield passed()
                block, words, used, ends, runs, weight = at, [], [], 0, [], 0
            part = unpacked(docs)
            texts, train = [folded(t) for t in part["text"].to_pylist()], np.array([not h for h in part["held_out"].to_pylist()])
            runs.append(counted_runs(texts, train))
            weight += len(runs[-1][0])
            some, sizes = words_of(texts)
            some, uses, _ = counted(some, np.repeat(train, sizes))
            words.append(some)
            used.append(uses)
            ends += int(train.sum())
            if weight > HELD:
                runs = [merged(runs)]
                weight = len(runs[0][0]) // 2
    if runs:
        yield passed()


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    run, n = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(run, kind="stable")  # quick on lists that are sorted already
    run = run[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return run[first], stretch_sums(n[order], first)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence."""
    y = x + 8
    shift = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


LOOKED_UP = 65_536
AT_HALF, AT_WHOLE = log_gamma(np.arange(LOOKED_UP) + 0.5), log_gamma(np.arange(LOOKED_UP) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""

    def gamma(x, table, shift):
        out = table[np.minimum(x, LOOKED_UP - 1).astype(np.intp)]
        large = x >= LOOKED_UP
        if large.any():
            out[large] = log_gamma(x[large] + shift)
        return out

    return gamma(zeros, AT_HALF, 0.5) + gamma(ones, AT_HALF, 0.5) - np.log(np.pi) - gamma(zeros + ones, AT_WHOLE, 1.0)


def decisions(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run and each of the eight decisions of its last byte: context, place in the byte's tree, bit."""
    byte, k = (run & np.uint64(255))[:, None], np.arange(8, dtype=np.uint64)[None, :]
    place = (np.uint64(1) << k) | (byte >> (np.uint64(8) - k))
    return np.broadcast_to((run >> np.uint64(8))[:, None], place.shape), place, (byte >> (np.uint64(7) - k)) & np.uint64(1)


def node_at(context: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    return (context & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | place


def mixed(names, zeros, ones, share, node, bit, deeper) -> np.ndarray:
    """Chance of each bit at one depth: the node's own estimate and the deeper one, by its share. A node
    never met in training says one half."""
    if not len(names):
        return np.full(node.shape, 0.5)
    at = np.minimum(np.searchsorted(names, node), len(names) - 1)
    own = (np.where(bit > 0, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
    return np.where(names[at] == node, share[at] * own + (1 - share[at]) * deeper, 0.5)


class Level:
    """Nodes of one depth: sorted names, counts, log probability, and the share of their own estimate
    against the deeper ones."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones = node, zeros, ones
        own = log_kt(zeros, ones)
        self.log = own if below is None else np.logaddexp(own, below) + HALF
        self.share = np.ones(len(node)) if below is None else np.exp(own + HALF - self.log)

    def predict(self, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        return mixed(self.node, self.zeros, self.ones, self.share, node, bit, deeper)


def summed(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    name, where = np.unique(node, return_inverse=True)
    return name, *[np.bincount(where.ravel(), weights=v.ravel(), minlength=len(name)) for v in values]


class Layer:
    """One depth over sorted turned runs: their distinct (context, byte) pairs and, for each of a byte's eight
    decisions, the nodes. Pairs with equal leading bits lie together, so nodes are stretches of pairs."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, deep: Layer | None = None, up: np.ndarray | None = None):
        self.pair, self.n, self.up = pair, n, up  # up: the pair here of each pair of the deeper layer
        self.at, self.zeros, self.ones, self.log, self.share, self.first = [], [], [], [], [], []
        for k in range(8):
            name = pair >> np.uint64(8 - k)
            new = np.r_[True, name[1:] != name[:-1]]
            first, at = np.flatnonzero(new), np.cumsum(new) - 1
            one = n * self.bit(k)
            ones = np.add.reduceat(one, first)
            zeros = np.add.reduceat(n - one, first)
            own = log_kt(zeros, ones)
            if deep is None:
                log, share = own, np.ones(len(own))
            else:
                below = np.bincount(at[up[deep.first[k]]], weights=deep.log[k], minlength=len(first))
                log = np.logaddexp(own, below) + HALF
                share = np.exp(own + HALF - log)
            for values, value in ((self.at, at), (self.zeros, zeros), (self.ones, ones), (self.log, log), (self.share, share), (self.first, first)):
                values.append(value)

    def bit(self, k: int) -> np.ndarray:
        return ((self.pair >> np.uint64(7 - k)) & np.uint64(1)).astype(float)

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's chance of its k-th bit by its node alone, and the node's share."""
        at = self.at[k]
        zeros, ones = self.zeros[k][at], self.ones[k][at]
        return (np.where(self.bit(k) > 0, ones, zeros) + 0.5) / (zeros + ones + 1.0), self.share[k][at]

    def named(self, depth: int) -> np.ndarray:
        """Names of all nodes, as `node_at` gives them."""
        names = []
        for k in range(8):
            pair = self.pair[self.first[k]]
            context = turned((pair >> np.uint64(8)) << np.uint64(8 * (DEPTH - depth + 1))) >> np.uint64(8)
            names.append(node_at(context, np.uint64(1 << k) | ((pair & np.uint64(255)) >> np.uint64(8 - k)), depth))
        return np.concatenate(names)


def risen_pairs(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs one context byte shorter, their counts, and where each pair went."""
    short, up = np.unique(((pair >> np.uint64(16)) << np.uint64(8)) | (pair & np.uint64(255)), return_inverse=True)
    return short, np.bincount(up.ravel(), weights=n, minlength=len(short)), up.ravel()


def layers_of(turn: np.ndarray, n: np.ndarray) -> list[Layer]:
    """Layers DEPTH to NEAR over sorted turned runs. Runs never met in training count 0: a node of such runs only
    says one half and changes no other."""
    out = [Layer(turn, n.astype(float))]
    for _ in range(DEPTH - NEAR):
        pair, more, up = risen_pairs(out[-1].pair, out[-1].n)
        out.append(Layer(pair, more, out[-1], up))
    return out


def near_levels(run: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH to NEAR of the tree, from the runs met in training, to be asked about any run."""
    some, where = np.unique(turned(run[n > 0]), return_inverse=True)
    levels: list[Level] = []
    for depth, layer in zip(range(DEPTH, NEAR - 1, -1), layers_of(some, np.bincount(where.ravel(), weights=n[n > 0])) if len(some) else []):
        node, level = layer.named(depth), Level.__new__(Level)
        order = np.argsort(node, kind="stable")
        level.node = node[order]
        level.zeros, level.ones, level.log, level.share = (np.concatenate(v)[order] for v in (layer.zeros, layer.ones, layer.log, layer.share))
        levels.append(level)
    return levels


GROUPS = "grp int, block long, runs binary, n binary, c binary, node binary, zeros binary, ones binary, log binary, total long, known long"


def grow(key, table):
    """One group: a row with all its runs and words counted and its nodes at depth NEAR, and a row per block with
    the places of the block's runs among all, and the counts of its words."""
    blocks, lists = table["block"].to_pylist(), [risen(x) for x in table["runs"].to_pylist()]
    turn, where = np.unique(np.concatenate(lists), return_inverse=True)
    n = np.bincount(where.ravel(), weights=np.concatenate([unsqueezed(x) for x in table["n"].to_pylist()]), minlength=len(turn))
    where = np.split(where.ravel(), np.cumsum([len(x) for x in lists])[:-1])
    words = [unlisted_words(x) for x in table["words"].to_pylist()]
    _, uses, mine = counted(pa.concat_arrays(words), np.concatenate([unsqueezed(x) for x in table["uses"].to_pylist()]))
    mine = np.split(uses[mine], np.cumsum([len(x) for x in words])[:-1])
    rows = [{"block": b, "runs": rising(at), "c": squeezed(c)} for b, at, c in zip(blocks, where, mine)]
    whole = {"block": None, "runs": rising(turn), "n": squeezed(n), "total": int(uses.sum()), "known": int((uses > 0).sum())}
    if len(turn):
        top = layers_of(turn.astype(np.uint64), n)[-1]
        whole |= {"node": squeezed(top.named(NEAR)), **{c: squeezed(np.concatenate(v)) for c, v in (("zeros", top.zeros), ("ones", top.ones), ("log", top.log))}}
    kinds = {"grp": pa.int32(), "block": pa.int64(), **dict.fromkeys(("runs", "n", "c", "node", "zeros", "ones", "log"), pa.binary()), "total": pa.int64(), "known": pa.int64()}
    rows = [r | {"grp": key[0].as_py()} for r in (whole, *rows)]
    return pa.table({c: pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()})


def near_nodes(batches):
    """The nodes at depth NEAR as rows."""
    for b in batches:
        for row in b.to_pylist():
            got = {c: unsqueezed(row[c], float) for c in ("zeros", "ones", "log")}
            node = unsqueezed(row["node"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), row["grp"], np.int32)), pa.array(node), *map(pa.array, got.values())], ["grp", "node", *got])


def above(nodes: DataFrame, depth: int) -> DataFrame:
    """Counts and children's log probability of the nodes one level up, at `depth`."""
    up = F.col("node").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))
    return nodes.groupBy(up.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("below"))


def weighed(nodes: DataFrame) -> DataFrame:
    """(node, zeros, ones, log, share) of nodes with their children's log probability."""

    def weigh(batches):
        for b in batches:
            level = Level(b["node"].to_numpy(), b["zeros"].to_numpy(), b["ones"].to_numpy(), b["below"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["node"], b["zeros"], b["ones"], pa.array(level.log), pa.array(level.share)], ["node", "zeros", "ones", "log", "share"])

    return written(nodes.mapInArrow(weigh, "node long, zeros double, ones double, log double, share double"), "lm_level")


def run_scores(held: DataFrame) -> DataFrame:
    """(block, grp, score, c): for each block and group, log10 of the chance of each run's last byte after its
    context by the whole tree, in the order of the block's runs, and its word counts.

    The tree grows from its deep end: groups of runs that share their NEAR nearest context bytes, then
    one aggregate per level. Depths 1 and 0 hold at most 65,535 nodes and go to every task; depth 2 meets
    the groups that lie under it. Then the groups are weighed again from the top.
    """
    spark = held.sparkSession
    nodes = written(held.where("node IS NOT NULL").select("grp", "node", "zeros", "ones", "log").mapInArrow(near_nodes, "grp int, node long, zeros double, ones double, log double"), "lm_nodes")
    second = weighed(above(nodes, 2))
    first = above(second, 1).toArrow().sort_by("node")
    one = Level(*(first[c].to_numpy().astype(t) for c, t in (("node", np.uint64), ("zeros", float), ("ones", float), ("below", float))))
    top = Level(*summed(one.node & np.uint64(255), one.zeros, one.ones, one.log))
    shared = spark.sparkContext.broadcast((one, top))
    pair = F.shiftright("node", 8)
    under = nodes.select("grp", pair.bitwiseAND(F.lit(0xFFFF)).alias("pair")).distinct().join(second.withColumn("pair", pair), "pair").select("grp", "node", "zeros", "ones", "share")

    def weigh(left, right):
        one, top = shared.value
        whole = left.filter(left["block"].is_null()).to_pylist()[0]
        mine = left.filter(left["block"].is_valid())
        turn, n = risen(whole["runs"]).astype(np.uint64), unsqueezed(whole["n"], float)
        log = np.zeros(len(turn))
        if len(turn):
            layers = layers_of(turn, n)
            pair, _, up = risen_pairs(layers[-1].pair, layers[-1].n)
            two = right.sort_by("node")
            names = two["node"].to_numpy().astype(np.uint64)
            zeros, ones, share = (two[c].to_numpy() for c in ("zeros", "ones", "share"))
            context, place, bit = decisions(turned(pair << np.uint64(8 * (DEPTH - 2))) & np.uint64(0xFFFF00) | (pair & np.uint64(255)))
            ends = []
            for deeper in (0.0, 1.0):  # the upper depths are linear in what depth NEAR says
                chance = mixed(names, zeros, ones, share, node_at(context, place, 2), bit, np.full(bit.shape, deeper))
                chance = one.predict(node_at(context, place, 1), bit, chance)
                ends.append(top.predict(node_at(context, place, 0), bit, chance))
            for k in range(8):
                chance, at = layers[0].own(k)[0], np.arange(len(turn))
                for layer in layers[1:]:
                    at = layer.up[at]
                    own, part = layer.own(k)
                    chance = part[at] * own[at] + (1 - part[at]) * chance
                at = up[at]
                log += np.log10(ends[0][at, k] * (1 - chance) + ends[1][at, k] * chance)
        whole_steps = np.rint(-log * STEP).astype(np.int64)
        scores = [squeezed(whole_steps[risen(x)]) for x in mine["runs"].to_pylist()]
        return pa.table({"block": mine["block"], "grp": mine["grp"], "score": pa.array(scores, pa.binary()), "c": mine["c"]})

    rows = held.select("grp", "block", "runs", "n", "c")
    return rows.groupBy("grp").cogroup(under.groupBy("grp")).applyInArrow(weigh, "block long, grp int, score binary, c binary")


def scored(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per document.

    Learns from rows that are not `held_out`, all of them. `score` is log10 of the probability of the
    text's bytes (A-Z in lower case) and its end mark, `bits_per_byte` the same as code length. A null text
    is empty: one end token. Repeated rows are alike. Without training rows every bit has chance 1/2.
    """
    placed = blocks(docs, key, text, held_out)
    kind = docs.schema[key].dataType.simpleString()
    size = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    parts = placed.select("block", "docs").mapInArrow(lambda batches: items(batches, groups), "grp int, block long, runs binary, n binary, words binary, uses binary")
    held = written(parts.groupBy("grp").applyInArrow(grow, GROUPS), "lm_groups")
    total, distinct = held.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    found = run_scores(held)

    def score(left, right):
        texts, names, marks = [], [], []
        for docs in left["docs"].to_pylist():
            part = unpacked(docs)
            texts += [part["text"].combine_chunks()]
            names += part["key"].chunks
            marks += part["held_out"].chunks
        got = {g: (s, c) for g, s, c in zip(right["grp"].to_pylist(), right["score"].to_pylist(), right["c"].to_pylist())}
        pieces = []
        for some in texts:  # the block's runs once more, which its scores follow in order
            raw = [folded(t) for t in some.to_pylist()]
            words, sizes = words_of(raw)
            words, _, word = counted(words, np.zeros(len(words)))
            pieces.append((np.array([len(t) + 1 for t in raw]), *ranked_runs(raw), sizes, words, word))
        words, _, place = counted(pa.concat_arrays([*[p[4] for p in pieces], pa.array([END], pa.large_binary())]), np.zeros(sum(len(p[4]) for p in pieces) + 1))
        count = np.empty(len(words), np.int64)
        count[dealt_words(words, groups)[0]] = np.concatenate([unsqueezed(got[g][1]) for g in sorted(got)])
        count = count[place]
        log = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        runs = np.concatenate([p[1] for p in pieces])
        runs.sort()
        runs = runs[np.r_[True, runs[1:] != runs[:-1]]]
        _, order, _ = dealt_runs(runs, groups)
        value = np.empty(len(runs))
        value[order] = np.concatenate([unsqueezed(got[g][0]) for g in sorted(got)]) / -STEP
        out: dict[str, list] = {n: [] for n in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        begin = 0
        for length, own, at, sizes, words, word in pieces:
            sums = np.add.reduceat(value[np.searchsorted(runs, own)][at], np.cumsum(length) - length)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            known = np.concatenate([[0], np.cumsum((count[begin:begin + len(words)] > 0)[word])])
            base = log[begin:begin + len(words)][word]
            begin += len(words)
            out["n_tokens"].append(sizes + 1)
            out["n_known"].append(np.diff(known[edge]) + (count[-1] > 0))
            out["base_score"].append([base[lo:hi].sum() + log[-1] for lo, hi in zip(edge, edge[1:])])
            out["score"].append(sums)
            out["bits_per_byte"].append(-sums / np.log10(2) / length)
        types = {"n_tokens": pa.int64(), "n_known": pa.int64()}
        return pa.table({"key": pa.chunked_array(names), "held_out": pa.chunked_array(marks), **{n: pa.array(np.concatenate(v), types.get(n, pa.float64())) for n, v in out.items()}})

    rows = placed.select("block", "docs").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        score, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return rows.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fold_of(F.col("doc_id")) == 1)
