"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt by ranges of their id, so part k holds smaller ids than part k + 1. Each part is
three flat files: ``.tok`` (ids, 16 bits wide where the vocabulary allows, else 32), ``.off`` (64-bit
token offsets of its documents, one more than it has) and ``.doc`` (64-bit document ids). Offsets
inside a part start at 0; the manifest holds each part's base, the prefix sum of the token counts
before it. A task writes under a name of its own and renames at the end, so a task that runs again
leaves the same files. Files are read through memory maps.

Defined results: a null text counts as empty and is the end id alone; a null document id is stored as
the smallest 64-bit integer, sorts first and is read back as null; rows with equal ids are ordered by
Spark's 64-bit hash of their text, rows equal in both by their place in the table, and all stay (such rows may
fall into several parts); texts may be of any length, one that is longer than a run is encoded alone; an empty
table has no parts; further columns, whatever their names, are not stored.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkEncoder, batches
from tessera.llm.common import claim, remember, ship

NO_ID = -(2**63)
MANIFEST = "manifest.json"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def load(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A flat file as a memory map; from a store that cannot be mapped it is first copied, some megabytes at a time, to a
    scratch file without a name, which the system frees with the map."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as scratch:
        with fs.open_input_stream(path) as f:
            shutil.copyfileobj(f, scratch, 8 << 20)
        scratch.flush()
        return np.memmap(scratch, dtype=dtype, mode="r") if scratch.tell() else np.empty(0, dtype)


class Coder:
    """Cuts texts at the tokenizer's added tokens, as the library does, and encodes what lies between them."""

    def __init__(self, inner: ChunkEncoder, added: dict[str, int]):
        self.inner, self.added = inner, added
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not any(a in t for a in self.added for t in texts):
            return self.inner.encode(texts)
        pieces = [self.cuts.split(t) for t in texts]
        ids, counts = self.inner.encode([x for p in pieces for x in p[::2]])
        found = iter(np.split(ids, np.cumsum(counts)[:-1]))
        whole = [np.concatenate([np.array([self.added[x]], dtype="<u4") if k % 2 else next(found) for k, x in enumerate(p)]) for p in pieces]
        return np.concatenate(whole), np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))


#: Bytes as the file's vocabulary spells them: printable characters for themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [i for i in range(256) if i not in set(_PLAIN)]
_SPELT = {i: i for i in _PLAIN} | {b: 256 + k for k, b in enumerate(_OTHER)}


def spelt(word: str) -> str:
    if word[:1] == " " and word.isascii() and word[1:].isalnum():
        return "\u0120" + word[1:]
    return word.encode("utf-8").decode("latin-1").translate(_SPELT)


_coders: dict[str, Coder] = {}
remember("token_files", _coders)


def coder(content: bytes, pattern: str) -> Coder:
    """One for each tokenizer file and worker process; words are encoded by the tokenizers library."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        merge = tokenizer.model.tokenize

        def words(some: list[str]) -> list[bytes]:
            return [array.array("I", [t.id for t in merge(spelt(w))]).tobytes() for w in some]

        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        _coders[key] = Coder(ChunkEncoder(words, pattern), added)
    return _coders[key]


def write(df: DataFrame, out_dir: str, tokenizer_path: str, pattern: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Writes the files under out_dir, a folder that driver and executors share, and returns the manifest.
    The driver gets one row for each part. The one shuffle moves the texts, before they are encoded."""
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    fs, top = _fs(out_dir)
    fs.create_dir(top, recursive=True)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_files")
        encoder, part, own = coder(content.value, pattern), TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, top = _fs(out_dir)
        names = {k: (f"{top}/_{own}.{k}", f"{top}/part-{part:06d}.{k}") for k in ("tok", "off", "doc")}
        files, n_docs, n_tokens = None, 0, 0
        for batch in it:
            if not batch.num_rows:
                continue
            if files is None:
                files = {k: fs.open_output_stream(x[0]) for k, x in names.items()}
                files["off"].write(np.zeros(1, dtype="<u8").tobytes())
            doc_ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], dtype="<i8")
            at = 0
            for texts in batches([t or "" for t in batch.column(1).to_pylist()]):
                ids, counts = encoder.encode(texts)
                after = np.cumsum(counts)
                files["tok"].write(np.insert(ids.astype(dtype), after, end_id).tobytes())
                ends = n_tokens + after + np.arange(1, len(texts) + 1)
                files["off"].write(ends.astype("<u8").tobytes())
                files["doc"].write(doc_ids[at : at + len(texts)].tobytes())
                at, n_tokens = at + len(texts), int(ends[-1])
            n_docs += batch.num_rows
        if files is not None:
            for f in files.values():
                f.close()
            for made, final in names.values():
                if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(final).type != pafs.FileType.NotFound:
                    fs.delete_file(final)
                fs.move(made, final)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "n_docs", "n_tokens"])

    dealt = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    dealt = dealt.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange("id", "hash", "place").sortWithinPartitions("id", "hash", "place").select("id", "text")
    parts = sorted(tuple(r) for r in dealt.mapInArrow(run, "part long, n_docs long, n_tokens long").collect())
    bases = np.cumsum([0, *(p[2] for p in parts)]).tolist()
    docs = np.cumsum([0, *(p[1] for p in parts)]).tolist()
    manifest = {
        "dtype": dtype,
        "end_id": end_id,
        "n_tokens": bases[-1],
        "n_docs": docs[-1],
        "parts": [{"part": p, "n_docs": d, "n_tokens": n, "token_base": b, "doc_base": e} for (p, d, n), b, e in zip(parts, bases, docs, strict=False)],
    }
    with fs.open_output_stream(f"{top}/{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, out_dir: str, tokens: bool = True) -> DataFrame:
    """The documents of the files, one task to a part: doc_id, start (tokens of all documents before), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, token_ids."""
    ship(spark)
    fs, top = _fs(out_dir)
    with fs.open_input_file(f"{top}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    parts, dtype = manifest["parts"], manifest["dtype"]
    shared = spark.sparkContext.broadcast(parts)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<int>" if tokens else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(out_dir)
        for row in it:
            for k in row.column(0).to_pylist():
                p = shared.value[k]
                name = f"{top}/part-{p['part']:06d}"
                ids, off, doc = load(fs, name + ".tok", dtype), load(fs, name + ".off", "<u8"), load(fs, name + ".doc", "<i8")
                for a in range(0, p["n_docs"], 4096):
                    b = min(a + 4096, p["n_docs"])
                    cuts = off[a : b + 1].astype(np.int64)
                    own = [np.asarray(ids[x:y]).astype("<u4") for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    ids64 = np.asarray(doc[a:b])
                    columns = [
                        pa.array(ids64, pa.int64(), mask=ids64 == NO_ID),
                        pa.array(p["token_base"] + cuts[:-1], pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if tokens:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                        names.append("token_ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, schema)
