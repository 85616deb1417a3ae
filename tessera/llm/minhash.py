"""Near duplicates by min-max hashing: shingle sets, banded signatures, confirmed links, components.

Under each of HASHES permutations both the least and the greatest value of a set are kept, so a
signature of 2 * HASHES rows costs HASHES evaluations for each shingle. A band takes ROWS minima, or
ROWS maxima, of different permutations; at a similarity of 0.75 two sets share no band with a chance of
(1 - 0.75 ** 6) ** 56, two in a hundred thousand, while sets that share a third (a long passage in common)
meet in a few hundredths of the cases. Every link is confirmed on the full sets.

Documents with equal sets form a class, and the rest works on classes. In a bucket (a band's value)
some members are leaders in each round: each is compared with all other members that are not yet in
its component, and then leaves the bucket. A bucket is finished when its members are of one component,
so a bucket of n near copies costs about n comparisons and not n * n. Two rounds over an eighth of the
buckets come first: they tie most of a large group together, and the two rounds over all buckets then
find most of its members in one component. What is left are buckets of documents that share a band and
are no near copies; there every member meets every other inside tasks of bounded size, which return forests
and no pairs. No comparison that could join two components is left out. Nothing but counts reaches the driver.

Defined results: a null or empty text, or one of white space, has no shingles, links with nothing and
stays; rows with equal texts are one class; a null id counts as larger than any other; rows stay as
they come, repeated ones too; an empty table gives an empty one; texts may be of any length, long ones are hashed a
megabyte at a time; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import claim, cut, drop, free, remember, ship
from tessera.llm.components import least_neighbour, renamed

WORDS = 5
PERCENT = 75
HASHES = 168
ROWS = 6
SEED = 20_240_607
#: Classes whose ids may be broadcast (8 bytes each) to fetch their texts; more are fetched by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that one part holds, about; two parts meet in a task.
PART = 256
_BYTES = 1 << 20
_NO_ID = -(2**63)
_NAMES = ("id", "t", "n_shingles", "class", "bands", "root", "component_id", "node", "alone", "x")

_rng = np.random.default_rng(SEED)
_TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(2**32, 2**63, dtype=np.uint64)) | 5 | 1
_ODD = _rng.integers(1, 2**64, max(WORDS, ROWS), dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}
remember("minhash", _powers)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte of each word: runs of bytes that are not ASCII white space, A-Z lower-cased."""
    b = np.frombuffer(data.lower(), dtype=np.uint8)
    word = np.zeros(len(b) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[b]
    edge = np.diff(word)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _parts(data: bytes) -> Iterator[bytes]:
    """Runs of whole words of a long text."""
    start = 0
    while len(data) - start > _BYTES:
        end = start + _BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    words: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            h, starts = word_hashes(b"\n".join(group))
            cuts = np.cumsum([len(t) + 1 for t in group])
            words.extend(np.split(h, np.searchsorted(starts, cuts[:-1])))
            group.clear()

    size = 0
    for t in texts:
        if len(t) > _BYTES:
            flush()
            words.append(np.concatenate([word_hashes(p)[0] for p in _parts(t)]))
            size = 0
            continue
        if size + len(t) > _BYTES:
            flush()
            size = 0
        group.append(t)
        size += len(t) + 1
    flush()
    out = []
    for w in words:
        n = len(w)
        if not n:
            out.append(np.empty(0, np.uint64))
        elif n < WORDS:
            h = np.full(1, n, np.uint64)
            for j in range(n):
                h = _mix(h + w[j : j + 1] * _ODD[j : j + 1])
            out.append(h)
        else:
            h = np.zeros(n - WORDS + 1, np.uint64)
            for j in range(WORDS):
                h += _mix(w[j : n - WORDS + 1 + j] ^ _ODD[j]) * _ODD[j]
            out.append(np.unique(_mix(h)))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band values of sets that are not empty, a row each."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    rows = np.empty((2, HASHES, len(sets)), dtype=np.uint64)
    for k in range(HASHES):
        v = (flat ^ _XOR[k]) * _MUL[k]
        np.minimum.reduceat(v, starts, out=rows[0, k])
        np.maximum.reduceat(v, starts, out=rows[1, k])
    n = 2 * HASHES // ROWS
    rows = rows.reshape(n, ROWS, len(sets))
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64)[:, None], (1, len(sets)))
    for j in range(ROWS):
        out = _mix(out * _ODD[j] + rows[:, j])
    return out.T


def _runs(texts: list[bytes], size: int = _BYTES) -> Iterator[list[bytes]]:
    own, n = [], 0
    for t in texts:
        if own and n + len(t) > size:
            yield own
            own, n = [], 0
        own.append(t)
        n += len(t)
    if own:
        yield own


def sketch(df: DataFrame, doc_id: str, text: str, more: tuple[str, ...] = ()) -> DataFrame:
    """id, n_shingles, class (128-bit hash of the whole set, null without shingles), bands, and more binary columns."""
    ship(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in it:
            at = 0
            for texts in _runs([t or b"" for t in batch.column(1).to_pylist()]):
                sets = shingle_sets(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                found = bands([sets[i] for i in full]).astype(np.int64) if full else np.empty((0, 2 * HASHES // ROWS), np.int64)
                keys, own = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full):
                    keys[i], own[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), found[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64())), *(batch.column(c).slice(at, len(texts)) for c in more)],
                    names=["id", "n_shingles", "class", "bands", *more],
                )
                at += len(texts)

    schema = ", ".join(["id long, n_shingles long, class binary, bands array<long>", *(f"{c} binary" for c in more)])
    return df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("t"), *more).mapInArrow(run, schema)


def full_sets(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """class and set (all shingles) of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in it:
            for texts in _runs([t or b"" for t in batch.column(0).to_pylist()]):
                sets = [s for s in shingle_sets(texts) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "set"]
                )

    return df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "class binary, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs u, v of classes, those similar enough on their full sets."""
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("su"))
    two = sets.select(F.col("node").alias("v"), F.col("set").alias("sv"))
    both = pairs.join(one, "u").join(two, "v")
    both = both.select(*pairs.columns, F.size("su").cast("bigint").alias("nu"), F.size("sv").cast("bigint").alias("nv"), F.size(F.array_intersect("su", "sv")).cast("bigint").alias("both"))
    return both.filter(F.expr(f"100 * both >= {percent} * (nu + nv - both)")).select(*pairs.columns)


def _grouped(df: DataFrame, doc_id: str, text: str, percent: int, more: tuple[str, ...] = ()) -> DataFrame:
    """id, n_shingles, class, root (of the component; null without shingles), component_id (its least id) and more for each row."""
    rows = cut(sketch(df, doc_id, text, more), "sketch")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("head"), F.max("n_shingles").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = rows.select("class", F.col("id").alias("head"), "bands").join(classes.select("class", F.col("head").alias("first"), "node"), "class").filter("head <=> first")
    member = own.select(F.explode("bands").alias("bucket"), "node")
    shared = member.groupBy("bucket").agg(F.count("*").cast("int").alias("size")).filter("size > 1")
    members = cut(member.join(shared, "bucket"), "members")
    wanted = members.groupBy("node").agg(F.lit(1).alias("_one")).select("node")
    wanted = cut(wanted.join(classes, "node"), "wanted")
    n_wanted = wanted.count()
    found = classes.select("class", F.col("node").alias("root"), F.col("head").alias("component_id"))
    if n_wanted:
        heads = wanted.select(F.coalesce("head", F.lit(_NO_ID)).alias("id")).distinct()
        fetched = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("t"))
        fetched = fetched.join(F.broadcast(heads) if n_wanted <= BROADCAST_IDS else heads, "id", "left_semi")
        sets = cut(full_sets(fetched, "id", "t").join(wanted.select("class", "node"), "class").select("node", "set"), "sets")
        if sets.count() > n_wanted:  # an id stands for several rows
            old, sets = sets, cut(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
            drop(old)
        roots = _link(members, wanted.select("node", "n", F.col("node").alias("root")), sets, percent)
        least = cut(roots.join(classes.select("node", "head"), "node").groupBy("root").agg(F.min("head").alias("component_id")), "least")
        of = roots.join(least, "root").select("node", "root", "component_id")
        found = classes.select("class", "node", "head").join(of, "node", "left")
        found = found.select("class", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "head").alias("component_id"))
        found = cut(found, "found")
        drop(wanted, sets, roots, least, classes)
    drop(members)
    return rows.select("id", "n_shingles", "class", *more).join(found, "class", "left")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    out = _grouped(df, doc_id, text, percent)
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _cross(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different roots among these sets: a forest, as pairs of roots."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    order = np.cumsum(times > 1) - 1
    of, column = of[several], order[column[several]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[of[lo:hi], column[lo:hi] - a] = 1
        both += dense @ dense.T
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    i, j = np.nonzero(near & (roots[:, None] > roots[None, :]))
    names, at = np.unique(roots, return_inverse=True)
    least, x, y = np.arange(len(names)), at[i], at[j]
    while len(x):
        before = least.copy()
        np.minimum.at(least, x, least[y])
        np.minimum.at(least, y, least[x])
        least = least[least]
        if (least == before).all():
            break
    moved = np.nonzero(least != np.arange(len(names)))[0]
    return names[moved], names[least[moved]]


def _block_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between roots in the buckets that still hold several: every member against every other, in tasks of two
    parts of a bucket each, whose sizes are bounded. A task returns a forest, not its pairs."""
    parts = F.expr(f"CAST(1 + size DIV {PART} AS INT)")
    now = members.join(roots, "node").withColumn("c", F.pmod(F.xxhash64("node"), parts).cast("int"))
    open_ = now.groupBy("bucket", "size").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z")
    open_ = open_.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("c"))
    dealt = now.join(open_, ["bucket", "c"]).select("bucket", "node", "root", "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    dealt = dealt.select("bucket", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "node", "root").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        claim("minhash")
        own = [np.asarray(x.values, dtype=np.int64) for x in table.column("set")]
        u, v = _cross(own, table.column("root").to_numpy(), percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("bucket", "a", "b").applyInArrow(run, "u long, v long")


def _link(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, n, root: the least node reachable by links. members: bucket, node, size (of the bucket); roots: each node its own.

    A round compares members with leaders, turns confirmed links into links between roots, renames each root to
    the least of itself and its neighbours, and keeps the links that are still between different roots for the next."""
    links, names = None, None

    def absorb(new: DataFrame | None) -> None:
        nonlocal links, names, roots
        waiting = renamed(links, names) if links is not None else None
        new = waiting if new is None else new if waiting is None else new.unionAll(waiting)
        made = cut(new.groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v"), "links")
        drop(links, names)
        links = None if made.isEmpty() else made
        if links is None:
            drop(made)
            return
        names = cut(least_neighbour(links), "names")
        after = roots.join(names.select(F.col("node").alias("root"), "least"), "root", "left")
        old, roots = roots, cut(after.select("node", "n", F.coalesce("least", "root").alias("root")), "roots")
        drop(old)

    before = None
    for some, leaders in ((members.filter(F.pmod(F.xxhash64("bucket"), F.lit(8)) == 0), 1), (None, 2), (members, 1), (None, 2)):
        if some is None:
            some = before.filter(~F.array_contains(F.col("ls.node"), F.col("node"))).select("bucket", "size", "node")
        now = some.join(roots, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.expr("1 + size DIV 256")).cast("int"))
        slots = now.groupBy("bucket", "size", F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders)).alias("slot")).agg(
            F.min(F.struct("node", "root", "n")).alias("l"), F.min("root").alias("a"), F.max("root").alias("z")
        )
        open_ = slots.groupBy("bucket", "size").agg(F.collect_list("l").alias("ls"), F.min("a").alias("a"), F.max("z").alias("z")).filter("a <> z")
        open_ = open_.select("bucket", "ls", F.explode(F.sequence(F.lit(0), F.expr("CAST(size DIV 256 AS INT)"))).alias("salt"))
        at = cut(now.join(open_, ["bucket", "salt"]).select("bucket", "size", "node", "n", "root", "ls"), "open")
        drop(before)
        before = at
        other = F.expr(f"filter(ls, l -> l.root <> root AND 100 * least(n, l.n) >= {percent} * greatest(n, l.n))")
        each = at.select("node", "root", F.explode(other).alias("l"))
        mine, theirs = F.struct("node", "root"), F.struct(F.col("l.node").alias("node"), F.col("l.root").alias("root"))
        pairs = each.select(F.greatest(mine, theirs).alias("x"), F.least(mine, theirs).alias("y"))
        pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.root").alias("ru"), F.col("y.root").alias("rv")).groupBy("u", "v", "ru", "rv").agg(F.lit(1).alias("_one"))
        absorb(_confirmed(pairs.select("u", "v", "ru", "rv"), sets, percent).select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")))
    left = before.filter(~F.array_contains(F.col("ls.node"), F.col("node"))).select("bucket", "size", "node")
    absorb(_block_links(left, roots.select("node", "root"), sets, percent))
    while links is not None:
        absorb(None)
    drop(before)
    return roots


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group stays, with all its columns: that of the smallest id, and of the smallest hash of its text
    where the id is repeated or missing. Rows without shingles are no group: of them only repeats of id and text go."""
    sha, own_id, kept = free([*df.columns, *_NAMES], "sha", "own_id", "kept_sha")
    own = df.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    alone = F.when(F.col("class").isNull(), F.struct("id", sha))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(sha).alias("sha")))
    stay = _grouped(own, doc_id, text, percent, (sha,)).groupBy("root", alone.alias("alone")).agg(first.alias("x"))
    stay = stay.select(F.col("x.id").alias(own_id), F.col("x.sha").alias(kept))
    both = F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(kept))
    return own.join(stay, both, "left_semi").dropDuplicates([doc_id, sha]).drop(sha)
