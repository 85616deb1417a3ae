"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the 2- to 4-byte grams of its lower-cased letters, with runs of anything else as
one word boundary. Each has a row in a table of BUCKETS embeddings; their mean goes through a linear
layer and a softmax. Embeddings and layer are trained by stochastic gradient descent in numpy on
pieces of the sampled texts, so that short texts are learned too. As everything between a subword and the
scores is linear, prediction uses the product of both matrices: one small table of buckets by languages,
whose size does not depend on the data, broadcast to the executors.

A part of the sample is set aside to fit a temperature, which makes the score a calibrated probability,
and the score below which a prediction is rejected.

Training sample: rows with a text and a language, chosen by a hash of id and text, the same number for each language
and SAMPLE_ROWS in all at most (a documented bound, as SAMPLE_CHARS is for each row). Languages and their counts come from
all rows; of more languages than SAMPLE_ROWS the most frequent are learned. Prediction uses the whole text and nothing else.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any
labelled row nothing is learned and every text is ``und``; ties go to the language that sorts first; a text of any
length is read in pieces; rows stay as they come, repeated ones too; an empty table gives an empty one; an input
column that has the name of a result is replaced, others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import claim, free, ship

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 3000
#: Characters of a sampled row that the driver gets: of a longer text, windows spread evenly over the whole of it.
SAMPLE_CHARS = 20_000
WINDOWS = 100
EPOCHS = 2
RATE = 0.5
PIECE = 160  # bytes of a training piece
#: Up to so many languages the table holds their scores; beyond it the two factors are kept apart.
FOLDED = 64
UNKNOWN = "und"
SEED = 11
_BYTES = 1 << 21

#: Bytes of letters stay (those of all characters beyond ASCII too); the rest become a boundary.
_KEEP = np.zeros(256, dtype=np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)


def folded(text: str) -> np.ndarray:
    """The bytes of a text: letters lower-cased, every other run one zero, a zero at both ends."""
    b = _KEEP[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    out = np.zeros(len(b) + 2, dtype=np.uint8)
    out[1:-1] = b
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def buckets(b: np.ndarray) -> np.ndarray:
    """Bucket of each gram that holds no boundary inside it."""
    x, found = b.astype(np.uint32), []
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, dtype=np.uint32)
        good = np.ones(len(h), dtype=bool)
        for j in range(n):
            h = (h ^ x[j : len(h) + j]) * np.uint32(0x01000193)
            if 0 < j < n - 1:
                good &= b[j : len(h) + j] != 0
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        found.append((h[good] >> np.uint32(16)) & np.uint32(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """languages, table (buckets by languages, or by dimensions with the linear layer as head), temperature, reject_below."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float = 1.0, reject_below: float = 0.0, head: np.ndarray | None = None):
        self.languages, self.table, self.temperature, self.reject_below, self.head = languages, table, temperature, reject_below, head

    def logits(self, text: str) -> np.ndarray | None:
        """Mean over the whole text, in pieces of bounded memory; None without a gram."""
        total, n = np.zeros(self.table.shape[1]), 0
        for a in range(0, len(text), _BYTES):
            g = buckets(folded(text[a : a + _BYTES]))
            if len(g):
                total += np.bincount(g, minlength=BUCKETS) @ self.table if len(g) > BUCKETS else self.table[g].sum(axis=0, dtype=np.float64)
                n += len(g)
        if not n:
            return None
        return total / n if self.head is None else total / n @ self.head

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """rows: text and language. Every seventh row is set aside for temperature and rejection."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    rng = np.random.default_rng(seed)
    at = {lang: k for k, lang in enumerate(languages)}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    aside = rows[::7] if len(rows) >= 70 else rows
    own = [r for i, r in enumerate(rows) if i % 7] if len(rows) >= 70 else rows
    pieces, labels = [], []
    for text, lang in own:
        b = folded(text)
        for a in range(0, max(1, len(b) - PIECE // 2), PIECE):
            g = buckets(b[a : a + PIECE])
            if len(g):
                pieces.append(g.astype(np.uint16))
                labels.append(at[lang])
    e = (rng.random((BUCKETS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    w = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    y = np.array(labels, dtype=np.int64)
    steps, done = max(1, EPOCHS * len(pieces)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            rate = np.float32(RATE * (1 - done / steps))
            done += len(some)
            parts = [pieces[i] for i in some]
            n = np.array([len(p) for p in parts])
            flat = np.concatenate(parts).astype(np.int64)
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(e[flat], starts, axis=0) / n[:, None].astype(np.float32)
            d = _softmax(mean @ w).astype(np.float32)
            d[np.arange(len(some)), y[some]] -= 1
            back = (d @ w.T) / n[:, None].astype(np.float32)
            w -= rate * (mean.T @ d)
            np.subtract.at(e, flat, np.repeat(rate * back * np.float32(8), n, axis=0))
    model = Model(languages, (e @ w).astype(np.float32)) if len(languages) <= FOLDED else Model(languages, e, head=w)
    _calibrate(model, aside, at)
    return model


def _calibrate(model: Model, rows: list[tuple[str, str]], at: dict[str, int]) -> None:
    """Temperature by the least cross entropy on pieces of the rows set aside; rejection below the score that
    one correct piece in a thousand falls short of, at most an eighth of the way from chance to certainty."""
    z, y = [], []
    for text, lang in rows:
        words = re.split(r"\s+", text)
        for a in range(0, len(words), max(25, len(words) // 4)):
            found = model.logits(" ".join(words[a : a + 25]))
            if found is not None:
                z.append(found)
                y.append(at[lang])
    if not z:
        return
    z, y = np.array(z), np.array(y)
    choices = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in choices]
    model.temperature = float(choices[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    chance = 1 / len(model.languages)
    model.reject_below = float(min(np.quantile(right, 0.001) if len(right) else 1.0, chance + (1 - chance) / 8))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Two passes: languages are counted over all rows, then a hash of key and text chooses the sample: of each language
    the rows of the smallest hashes among about twice as many as are wanted, repeated rows once."""
    known = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("k")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return train([])
    share, whole = max(1, rows // len(counts)), 1 << 40
    upto = [(r["lang"], whole if r["n"] <= 2 * share else max(1, whole * 2 * share // r["n"])) for r in counts]
    chosen = known.withColumn("h", F.xxhash64("k", "text")).join(F.broadcast(df.sparkSession.createDataFrame(upto, "lang string, upto long")), "lang")
    chosen = chosen.filter(F.pmod("h", F.lit(whole)) < F.col("upto")).withColumn("text", sampled("text")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    found = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= share).select("text", "lang", "k").collect()
    return train([(r[0], r[1]) for r in sorted(found, key=lambda r: (r[2] or "", r[1], r[0]))])


def sampled(text: str) -> Column:
    """A text of SAMPLE_CHARS characters at most; of a longer one, windows from its beginning to its end."""
    width = SAMPLE_CHARS // WINDOWS - 1
    at = f"CAST(1 + i * (length({text}) - {width}L) DIV {WINDOWS - 1} AS INT)"
    return F.expr(f"CASE WHEN length({text}) <= {SAMPLE_CHARS} THEN {text} ELSE array_join(transform(sequence(0, {WINDOWS - 1}), i -> substring({text}, {at}, {width})), ' ') END")


def has_letter(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected."""
    spark = df.sparkSession
    ship(spark)
    new = ("lang_pred", "score", "rejected")
    keep = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared, (letter,) = spark.sparkContext.broadcast(model), free(names, "letter")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        m = shared.value
        for batch in it:
            found = [m.predict(t) if ok else (UNKNOWN, 0.0) for t, ok in zip(batch.column(text).to_pylist(), batch.column(letter).to_pylist(), strict=True)]
            score = np.array([s for _, s in found], dtype=np.float64)
            columns = [pa.array([p for p, _ in found], pa.string()), pa.array(score), pa.array([p == UNKNOWN or s < m.reject_below for p, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, *new])

    return df.select(*names, has_letter(text).alias(letter)).mapInArrow(run, schema)
