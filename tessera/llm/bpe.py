"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each word of the pattern has a segment tree whose leaves are its byte positions. A leaf holds the
rank of the pair that begins there (the live node at that position and its next live neighbour), a
parent the smaller of its children; as a leaf's value is rank * width + position, the root names the
leftmost pair of the lowest rank. A merge updates the leaves of the merged node, of its left
neighbour and of the node that died, each by one walk to the root. Short words are merged side by
side, one tree to a row of an array; long ones one at a time.

Defined results: a null text counts as empty, an empty text has no ids; equal texts have equal ids;
rows, ties and columns are kept as they come. An input column that has the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.chunks import ChunkEncoder, batches
from tessera.llm.common import claim, release, remember, ship

SHORT = 64  # bytes of a word that is merged side by side with others
RUN = 2_000_000  # characters of the texts that are encoded together
_NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file's tokens, and for each pair of tokens whose bytes together are a token, that token."""

    def __init__(self, content: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.size = max(rank.values()) + 1
        self.tokens = [b""] * self.size
        for t, r in rank.items():
            self.tokens[r] = t
        self.byte = np.array([rank[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), dtype=np.int64, count=len(pairs))
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()] or [0], dtype=np.int32)
        self.table = pa.array(self.tokens, pa.large_binary())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where the two are no token together."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each of several texts, given their ids one after the other and how many each has."""
        flat = self.table.take(pa.array(ids))
        bounds = flat.buffers()[1]
        bytes_at = np.frombuffer(bounds, dtype=np.int64)[: len(ids) + 1]
        return joined(flat.buffers()[2], bytes_at[np.concatenate(([0], np.cumsum(counts)))])


def joined(data: pa.Buffer | None, ends: np.ndarray) -> pa.Array:
    """A binary array whose values lie one after the other in data, between the places of ends. Its offsets have 32 bits,
    as Spark reads them, so a run of texts must stay below 2 gigabytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")])


def merge_rows(ranks: Ranks, words: list[bytes], width: int) -> list[bytes]:
    """Words of 2 to width bytes (a power of two, SHORT at most), each with a tree in a row of its own."""
    n = len(words)
    raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(n, width)
    length = np.fromiter(map(len, words), dtype=np.int64, count=n)
    at = np.arange(width)
    live = at < length[:, None]
    ids = np.where(live, ranks.byte[raw], -1).astype(np.int32)
    nxt = np.tile(np.minimum(at + 1, width).astype(np.int16), (n, 1))
    prv = np.tile((at - 1).astype(np.int16), (n, 1))
    tree = np.full((n, 2 * width), _NONE, dtype=np.int32)
    has = at[:-1] + 1 < length[:, None]
    r, c = np.nonzero(has)
    found = ranks.pair_ranks(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(found == _NONE, _NONE, found * width + c)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    flat_tree, flat_ids, flat_nxt, flat_prv = tree.ravel(), ids.ravel(), nxt.ravel(), prv.ravel()
    rows = np.nonzero(tree[:, 1] != _NONE)[0]
    while len(rows):
        root = flat_tree[rows * (2 * width) + 1]
        pos, new = root % width, root // width
        base, tbase = rows * width, rows * (2 * width) + width
        dead = flat_nxt[base + pos].astype(np.int64)
        after = flat_nxt[base + dead].astype(np.int64)
        flat_ids[base + pos] = new
        flat_ids[base + dead] = -1
        flat_nxt[base + pos] = after
        inside = after < length[rows]
        flat_prv[(base + after)[inside]] = pos[inside]
        before = flat_prv[base + pos].astype(np.int64)
        # the three leaves that change: the dead node's, the merged node's and its left neighbour's
        flat_tree[tbase + dead] = _NONE
        right = flat_ids[base + np.where(inside, after, 0)]
        value = np.where(inside, ranks.pair_ranks(new, right), _NONE)
        flat_tree[tbase + pos] = np.where(value == _NONE, _NONE, value * np.int32(width) * (value != _NONE) + pos)
        some = before >= 0
        if some.any():
            lb, lp = (base + before)[some], before[some]
            value = ranks.pair_ranks(flat_ids[lb], new[some])
            flat_tree[(tbase + before)[some]] = np.where(value == _NONE, _NONE, value * np.int32(width) * (value != _NONE) + lp)
        top = rows * (2 * width)
        walk = [width + dead, width + pos, width + np.where(some, before, pos)]
        while walk[0][0] > 1:
            for k in range(3):
                walk[k] = walk[k] >> 1
                child = top + 2 * walk[k]
                flat_tree[top + walk[k]] = np.minimum(flat_tree[child], flat_tree[child + 1])
        rows = rows[flat_tree[top + 1] != _NONE]
    keep = ids >= 0
    flat = ids[keep].astype("<u4").tobytes()
    ends = np.cumsum(keep.sum(axis=1)) * 4
    starts = np.concatenate(([0], ends[:-1]))
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def merge_one(ranks: Ranks, word: bytes) -> bytes:
    """A word of any length: the same tree in plain lists, so that one long word costs n log n."""
    n, none = len(word), 1 << 62
    width = 1 << max(1, (n - 1).bit_length())
    pairs, size = ranks.pairs, ranks.size
    ids = [int(ranks.byte[b]) for b in word]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = pairs.get(ids[i] * size + ids[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            v = a if a < b else b
            if tree[i] == v:
                break
            tree[i] = v

    while tree[1] != none:
        new, pos = divmod(tree[1], width)
        dead = nxt[pos]
        after, before = nxt[dead], prv[pos]
        ids[pos], ids[dead], nxt[pos] = new, -1, after
        put(dead, none)
        r = None
        if after < n:
            prv[after] = pos
            r = pairs.get(new * size + ids[after])
        put(pos, none if r is None else r * width + pos)
        if before >= 0:
            r = pairs.get(ids[before] * size + new)
            put(before, none if r is None else r * width + before)
    return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


def encode_words(ranks: Ranks, words: list[str], rows: int = 65_536) -> list[bytes]:
    raw = [w.encode("utf-8") for w in words]
    out: list[bytes] = [b""] * len(raw)
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(raw):
        if len(w) == 1:
            out[i] = ranks.byte[w[0]].astype("<u4").tobytes()
        elif len(w) > SHORT:
            out[i] = merge_one(ranks, w)
        elif w:
            by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
    for width, at in by_width.items():
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            for i, ids in zip(some, merge_rows(ranks, [raw[i] for i in some], width), strict=True):
                out[i] = ids
    return out


_coders: dict[str, tuple[Ranks, ChunkEncoder]] = {}
remember("bpe", _coders)


def coder(content: bytes, pattern: str) -> tuple[Ranks, ChunkEncoder]:
    """One for each rank file and worker process."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _coders:
        ranks = Ranks(content)
        _coders[key] = (ranks, ChunkEncoder(lambda words: encode_words(ranks, words), pattern))
    return _coders[key]


def encode_decode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids_le", decoded: str = "decoded") -> DataFrame:
    """df with two binary columns: the ids of the text as little-endian unsigned 32-bit integers, and the bytes
    that those ids decode to. The rank file (about a megabyte; a vocabulary, it does not grow with the data) is
    read on the driver and broadcast. No shuffle; memory is bounded by a batch of rows. Spark keeps a worker after its
    task, so it forgets its words and gives its memory back when a task ends."""
    spark = df.sparkSession
    ship(spark)
    with open(rank_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    keep = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def coded(it: Iterator[pa.RecordBatch], ranks: Ranks, encoder: ChunkEncoder) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = 0
            for texts in batches([t or "" for t in batch.column(text).to_pylist()], RUN):
                found, counts = encoder.encode(texts)
                bounds = 4 * np.concatenate(([0], np.cumsum(counts)))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                columns = [rows.column(n) for n in names] + [joined(pa.py_buffer(found.tobytes()), bounds), ranks.decode(found, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, decoded])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        ranks, encoder = coder(content.value, pattern)
        try:
            yield from coded(it, ranks, encoder)
        finally:
            encoder.known.clear()
            release()

    return df.mapInArrow(run, schema)
