"""URL rules in a sorted array of digests.

A rule is a host and a path prefix. Its key is the 64-bit xxhash of ``host + path``; the keys lie sorted
in one flat file, the full strings and the actions beside them, all memory-mapped by the executors.
A url is probed with every suffix of its host at a dot and every path prefix of a length that some rule
has, by one vectorised binary search for a batch of urls; a key that is found is confirmed on the
stored string, along the whole run of equal keys. The longest rule that fits wins (ties: the longer host).

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits;
an empty host fits no rule; urls that no rule fits get the default verdict; repeated rows stay; an
empty rule list or table is allowed; of rules with the same host and path, block wins; an input column
that has the name of a result is replaced.
"""

from __future__ import annotations

import json
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_dir, ship
from tessera.llm.token_files import _fs, load

#: Rules that one array holds at most: the driver sorts them in memory, about 500 bytes each, so 2.5 GB at the bound.
MAX_RULES = 5_000_000


def host_of(url: str | Column) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes the array of (host, path, 'allow' or 'block') into the shared folder and returns the place."""
    best: dict[tuple[str, str], int] = {}
    for host, path, action in rules:
        best[host, path] = max(best.get((host, path), 0), int(action == "block"))
        if len(best) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
    own = sorted((xxhash.xxh64_intdigest((h + p).encode()), h, p, a) for (h, p), a in best.items())
    names = [f"{h}\0{p}".encode() for _, h, p, _ in own]
    out = fresh_dir(spark, "urls")
    fs, top = _fs(out)
    fs.create_dir(top, recursive=True)
    arrays = {
        "keys": np.array([x[0] for x in own], dtype="<u8"),
        "ends": np.cumsum([0, *map(len, names)]).astype("<u8"),
        "text": np.frombuffer(b"".join(names), dtype="<u1"),
        "block": np.array([x[3] for x in own], dtype="<u1"),
    }
    for name, a in arrays.items():
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(a.tobytes())
    with fs.open_output_stream(f"{top}/meta.json") as f:
        f.write(json.dumps({"lengths": sorted({len(p) for _, _, p, _ in own})}).encode())
    return out


class Digests:
    def __init__(self, place: str):
        fs, top = _fs(place)
        self.keys, self.ends, self.text, self.block = (load(fs, f"{top}/{n}", d) for n, d in (("keys", "<u8"), ("ends", "<u8"), ("text", "<u1"), ("block", "<u1")))
        with fs.open_input_file(f"{top}/meta.json") as f:
            self.lengths = json.loads(f.read())["lengths"]

    def find(self, probes: list[tuple[str, str]]) -> np.ndarray:
        """The place of each (host, path) in the array, -1 where it is not there."""
        want = np.fromiter((xxhash.xxh64_intdigest((h + p).encode("utf-8", "surrogatepass")) for h, p in probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, want)
        out = np.full(len(probes), -1, dtype=np.int64)
        hit = np.nonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == want) if len(self.keys) else np.zeros(len(probes), bool))[0]
        for i in hit.tolist():
            name, k = "\0".join(probes[i]).encode("utf-8", "surrogatepass"), int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == name:
                    out[i] = k
                    break
                k += 1
        return out


_open: dict[str, Digests] = {}


def judge(df: DataFrame, place: str, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict."""
    ship(df.sparkSession)
    new = ("host", "path", "rule", "verdict")
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*keep, *(T.StructField(n, T.StringType()) for n in new)])
    names = [f.name for f in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if place not in _open:
            _open[place] = Digests(place)
        digests = _open[place]
        for batch in it:
            probes, rows = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                start = 0 if host else -1
                while start >= 0:
                    suffix = host[start:]
                    for n in digests.lengths:
                        if n <= len(path):
                            probes.append((suffix, path[:n]))
                            rows.append(i)
                    start = host.find(".", start) + 1 or -1
            rule, verdict, best = [None] * batch.num_rows, [default] * batch.num_rows, [(-1, -1)] * batch.num_rows
            for j, k in enumerate(digests.find(probes).tolist() if probes else ()):
                if k >= 0:
                    (h, p), i = probes[j], rows[j]
                    if (len(h) + len(p), len(h)) > best[i]:
                        best[i], rule[i], verdict[i] = (len(h) + len(p), len(h)), h + p, "block" if digests.block[k] else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in [*names, "host", "path"]), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, *new])

    return df.select(*names, host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(run, schema)
