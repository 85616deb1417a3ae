"""Whole texts to token ids by way of remembered chunks.

A space between two characters that are not white space always begins a token of the byte-level
pattern, so a text falls apart there into chunks that can be encoded alone. A run of texts is split and its chunks
are numbered by Arrow's kernels; only the distinct ones reach Python, where a worker remembers their ids, and the
texts' ids are gathered from those. The memory is emptied when it reaches its bound, which costs time and never
changes a result.
"""

from __future__ import annotations

import contextlib
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space as Unicode's White_Space property lists it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIR = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 1 << 20


def explicit_space(pattern: str) -> str:
    """The pattern with its white space classes spelt out, so that this library's own view of them does not matter."""
    return pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[str, bool]]:
    """Parts of a text, cut at such spaces, and whether a part follows a space that was taken away."""
    start, inner = 0, False
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()], inner
        start, inner = m.end(), True
    yield text[start:], inner


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of texts: each one's place among the distinct ones, how many each text has, the distinct ones.
    A chunk stands for itself after the space before it; a text's first chunk, which follows none, has one put before
    it (no other chunk begins with a space)."""
    parts: list[str] = []
    own = np.zeros(len(texts), dtype=np.int64)
    edged = False
    for k, t in enumerate(texts):
        edged = edged or t[:1] == " " or t[-1:] == " "
        if len(t) <= SEGMENT:
            parts.append(t)
            own[k] = 1
        else:
            found = list(segments(t))
            parts += [x for x, _ in found]
            own[k] = len(found)
    heads = np.zeros(len(parts), dtype=bool)
    heads[np.cumsum(own) - own] = True
    if edged or any(map(_PAIR.search, parts)):
        lists = [_CUT.split(x) for x in parts]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = pa.array([c for found in lists for c in found], pa.string())
    else:
        split = pc.split_pattern(pa.array(parts, pa.string()), " ")
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        flat = split.flatten()
    starts = np.cumsum(counts) - counts
    coded = flat.dictionary_encode()
    places, chunks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    first = starts[heads]
    at: dict[str, int] = {}
    for i, p in zip(first.tolist(), places[first].tolist(), strict=True):
        places[i] = at.setdefault(" " + chunks[p], len(chunks) + len(at))
    per_text = np.add.reduceat(counts, np.cumsum(own) - own) if len(own) else counts
    return places, per_text, chunks + list(at)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for cycles: here are millions of strings and no cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ChunkEncoder:
    """encode_words: for a list of distinct words, the little-endian ids of each. Of more than limit remembered
    chunks only those stay that the run at hand has twice."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], pattern: str, limit: int = 800_000):
        self.encode_words, self.limit = encode_words, limit
        self.find = regex.compile(explicit_space(pattern)).findall
        #: by chunk; a word's key is the same as that of a chunk which is this word alone
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Texts of any length."""
        if not texts:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        with uncollected():
            places, per_text, chunks = numbered(texts)
            if len(self.known) > self.limit:
                often = (np.bincount(places, minlength=len(chunks)) > 1).tolist()
                self.known = {c: self.known[c] for c, o in zip(chunks, often, strict=True) if o and c in self.known}
            self._learn(chunks)
            found = list(map(self.known.__getitem__, chunks))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        table, begin = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        each = sizes[places]
        ends = np.cumsum(each)
        ids = table[np.repeat(begin[places] - (ends - each), each) + np.arange(ends[-1])]
        upto = np.cumsum(per_text)
        done = np.concatenate(([0], ends))[upto]
        return ids, np.diff(done, prepend=0)

    def _words(self, chunk: str) -> list[str]:
        """The words of a chunk, each as a key."""
        found = self.find(chunk[1:] if chunk[:1] == " " else " " + chunk)
        return [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else " " + w for w in found]

    def _learn(self, chunks: list[str]) -> None:
        """Plain letters, with a stop or comma at most, need no pattern."""
        known = self.known
        unseen = [c for c in chunks if c not in known]
        if not unseen:
            return
        plain = [c for c in unseen if c.isalpha()]
        other = [c for c in unseen if not c.isalpha()]
        ended = [c for c in other if c[-1:] in (".", ",") and c[:-1].isalpha()]
        taken = set(ended)
        split = {c: self._words(c) for c in other if c not in taken}
        new = {c[:-1] for c in ended}
        for ws in split.values():
            new.update(ws)
        new.update((" .", " ,"))
        new = plain + list(new.difference(known, plain))
        known.update(zip(new, self.encode_words([w[1:] if w[0] == " " else " " + w for w in new]), strict=True))
        stop, comma = known[" ."], known[" ,"]
        known.update({c: known[c[:-1]] + (stop if c[-1] == "." else comma) for c in ended})
        for c, ws in split.items():
            if len(ws) != 1 or ws[0] != c:
                known[c] = b"".join([known[w] for w in ws])


def batches(texts: list[str], chars: int = 8_000_000) -> Iterator[list[str]]:
    """Runs of texts of so many characters at most, or single longer ones."""
    own, n = [], 0
    for t in texts:
        if own and n + len(t) > chars:
            yield own
            own, n = [], 0
        own.append(t)
        n += len(t)
    if own:
        yield own
