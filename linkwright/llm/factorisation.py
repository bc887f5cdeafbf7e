"""Operator 7: quality classifier, a factorisation machine over hashed words, structure and size.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs cost no more than
the features: with s = sum v_i x_i they sum to half of (s * s - sum (v_i x_i)^2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded, chunks, held_out, held_out_of, record_batch, texts
from .quality_rules import SYMBOLS, counts

#: Buckets of hashed words, length of a feature's vector, labelled rows to learn from at most.
BUCKETS, RANK, SAMPLE = 1 << 14, 8, 8000
FOLDS, PREDICT_FROM = 5, 0.3
_MARKS = bytes(b for b in range(256) if b not in SYMBOLS)
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LETTERS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_SHOUT = bytes(b for b in range(256) if b not in b"!?")
#: Structure and, as metadata, the number of characters that the table states.
STRUCTURE = 11
#: Bytes of the labelled texts of one class at most.
SAMPLE_BYTES = 64 << 20


def structure(raw: bytes, n_chars: int | None = None) -> list[float]:
    """Size and shares of a text, each about between -2 and 2. `n_chars` is what the table says; where it says nothing, the text's own characters count."""
    n, chars, symbols, dup, repeats = counts(raw)
    size, words = max(len(raw), 1), max(n, 1)
    share = lambda x, scale: min(scale * x, 2.0)
    return [
        np.log1p(n) / 4 - 1.5,
        np.log1p(chars) / 4 - 2,
        min(chars / words, 16) / 8 - 0.75,
        share(symbols / words, 4),
        share(dup / (raw.count(b"\n") + 1), 4),
        share(repeats / words, 3),
        share(len(raw.translate(None, _UPPER)) / size, 4),
        share(len(raw.translate(None, _SHOUT)) / words, 4),
        share(len(raw.translate(None, _DIGITS)) / size, 6),
        share(1 - len(raw.translate(None, _LETTERS)) / size, 3) - 0.6,
        min(np.log1p(max(len(raw.decode(errors="replace")) if n_chars is None else n_chars, 0)), 24) / 4 - 2,
    ]


def features(raw: list[bytes], n_chars: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the different words of all texts in a row, how many each text has, and the structure."""
    mask, crc = BUCKETS - 1, zlib.crc32
    words = [set(t.translate(LOWER).split()) for t in raw]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((crc(w) for s in words for w in s), np.int64, int(n.sum())) & mask
    return flat, n, np.array([structure(t, c) for t, c in zip(raw, n_chars or [None] * len(raw), strict=True)], dtype=np.float64).reshape(-1, STRUCTURE)


class Machine:
    """Weights of the words' buckets and of the structure; a word counts 1 / sqrt(words of its text)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = BUCKETS + STRUCTURE
        self.bias = np.zeros(1)
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, RANK))

    def sums(self, flat: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.cumsum(n) - n
        x = 1 / np.sqrt(np.maximum(n, 1))

        def total(a: np.ndarray) -> np.ndarray:
            out = np.zeros((len(n), *a.shape[1:]))
            some = n > 0
            if some.any():
                out[some] = np.add.reduceat(a, first[some], axis=0)
            return out

        vs = self.v[BUCKETS:]
        line = total(self.w[flat]) * x + s @ self.w[BUCKETS:]
        mixed = total(self.v[flat]) * x[:, None] + s @ vs
        own = total((self.v**2).sum(axis=1)[flat]) * x**2 + s**2 @ (vs**2).sum(axis=1)
        return self.bias[0] + line + 0.5 * ((mixed**2).sum(axis=1) - own), mixed, x

    def score(self, flat: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(flat, n, s)[0], -35, 35)))

    def fit(self, flat: np.ndarray, n: np.ndarray, s: np.ndarray, y: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.08, shrink: float = 1e-4, seed: int = 11) -> Machine:
        """Adaptive gradient steps on the logarithmic loss, over batches in a fixed random order."""
        rng = np.random.default_rng(seed)
        first = np.cumsum(n) - n
        seen = [np.full_like(a, 1e-6) for a in (self.bias, self.w, self.v)]
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for start in range(0, len(order), batch):
                at = order[start : start + batch]
                part = np.concatenate([flat[first[i] : first[i] + n[i]] for i in at]) if len(at) else flat[:0]
                m, st = n[at], s[at]
                z, mixed, x = self.sums(part, m, st)
                g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[at]) / len(at)
                doc = np.repeat(np.arange(len(at)), m)
                gx = (g * x)[doc]
                gw, gv = shrink * self.w, shrink * self.v
                np.add.at(gw, part, gx)
                np.add.at(gv, part, gx[:, None] * (mixed[doc] - self.v[part] * x[doc][:, None]))
                gw[BUCKETS:] += st.T @ g
                gv[BUCKETS:] += (st * g[:, None]).T @ mixed - (st**2).T @ g[:, None] * self.v[BUCKETS:]
                for p, d, a in zip((self.bias, self.w, self.v), (np.array([g.sum()]), gw, gv), seen, strict=True):
                    a += d * d
                    p -= rate * d / np.sqrt(a)
        return self


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = FOLDS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most `most` labelled rows of the training folds and `most_bytes` of their texts, the same ones each time: (doc_id, y, text, ...).

    The bound makes the ids and labels small enough to send to every task."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return bounded(docs.join(F.broadcast(chosen), "doc_id"), "y", most, most_bytes)


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars); n_chars is null where the table has none."""
    return docs.select("doc_id", "text", (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Machine:
    """Learn on a bounded sample of labelled rows; without any, every score is one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, n, s = features(texts(batch), batch.column("n_chars").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.sort(flat) if len(n) == 1 else flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), lists, pa.array(s.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "words", "shape"])

    found = sample(_read(docs), labels, label, most).mapInArrow(run, "doc_id long, y int, words array<int>, shape array<double>")
    rows = found.withColumn("again", F.to_json(F.struct("shape", F.array_sort("words")))).toArrow()
    machine = Machine()
    if not rows.num_rows:
        return machine
    rows = rows.sort_by([("doc_id", "ascending"), ("again", "ascending")]).combine_chunks()  # rows of one id in an order of their own
    words = [np.sort(np.asarray(w, dtype=np.int64)) for w in rows["words"].to_pylist()]
    return machine.fit(np.concatenate(words), np.array([len(w) for w in words]), np.array(rows["shape"].to_pylist()), np.array(rows["y"].to_pylist(), dtype=float))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, predict_from: float = PREDICT_FROM) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs`.

    A null text is scored as an empty one. A null doc_id counts as held out, for nothing is learned from it;
    repeated ids keep their own rows. Of the documents only doc_id, text and, where it is, n_chars are read."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, most))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = machine.value.score(*features(texts(batch), batch.column("n_chars").to_pylist()))
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), held_out_of(batch.column("doc_id").to_pylist(), FOLDS), pa.array(p), pa.array((p >= predict_from).astype(np.int32)))

    return _read(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
