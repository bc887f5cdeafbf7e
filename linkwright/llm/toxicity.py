"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries of the same size are made from labelled text. Both begin with the commonest words of
ordinary text; one ends with the pieces of words that set toxic text apart, the other with more ordinary
words. zstandard's own trainer was tried on toxic windows and chops the words that tell; README has the figures. A window of words that the toxic dictionary makes shorter than the ordinary one is close to
toxic text. How much shorter, and how many windows of a document, is calibrated on the same labelled rows."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded, chunks, held_out, held_out_of, record_batch, texts

#: Words of a window, words from one window to the next, compression level, common words in both dictionaries.
WINDOW, STEP, LEVEL, COMMON = 6, 3, 6, 900
#: Labelled rows to learn from at most: toxic and ordinary ones.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2000, 4000
#: Bytes of the labelled texts of one class at most.
SAMPLE_BYTES = 24 << 20
#: A piece tells if it is in this share of the toxic sample and so many times rarer in the ordinary one.
LEAST_SHARE, LEAST_RATIO = 0.01, 8.0
FOLDS, PREDICT_FROM = 5, 0.5


def windows(raw: bytes) -> list[bytes]:
    words = raw.translate(LOWER).split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)] if words else []


def pieces(words: set[bytes]) -> set[bytes]:
    """Whole words, and beginnings and ends of words, with the space beside them."""
    out = set()
    for w in words:
        out.add(b" " + w + b" ")
        for n in (4, 5, 6, 7):
            if len(w) > n:
                out.add(b" " + w[:n])
                out.add(w[-n:] + b" ")
    return out


def one_of_copies(sets: list[set[bytes]]) -> list[set[bytes]]:
    """Sets of words without near copies: two min-hashes stand for each, so a group of copies counts once."""
    seen, out = set(), []
    for s in sets:
        if s:
            key = (min(map(zlib.crc32, s)), min(zlib.crc32(w, 77) for w in s))
            if key not in seen:
                seen.add(key)
                out.append(s)
    return out


def telling(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Pieces that set toxic text apart, the most frequent last."""
    a, b = Counter(), Counter()
    for s in toxic:
        a.update(pieces(s))
    least = max(4, LEAST_SHARE * len(toxic))
    a = Counter({p: n for p, n in a.items() if n >= least})
    for s in ordinary:
        b.update(p for p in pieces(s) if p in a)
    good = {p: n for p, n in a.items() if n / max(len(toxic), 1) > LEAST_RATIO * (b[p] + 1) / (len(ordinary) + 1)}

    def best(p: bytes) -> bool:
        # of pieces inside each other, the longer one if it is about as frequent, else the shorter
        return not any(q != p and (p in q and n >= 0.8 * good[p] or q in p and good[p] < 0.8 * n) for q, n in good.items())

    return sorted((p for p in good if best(p)), key=lambda p: (good[p], p))


class Distance:
    """The two dictionaries and the calibration."""

    def __init__(self, shared: bytes, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None):
        self.parts = (shared, toxic, ordinary)
        self.weights = weights
        self._ready = None

    def __getstate__(self):
        return self.parts, self.weights

    def __setstate__(self, state):
        self.parts, self.weights = state
        self._ready = None

    def _compressors(self):
        if self._ready is None:
            made = []
            for tail in self.parts[1:]:
                d = zstandard.ZstdCompressionDict(self.parts[0] + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self._ready = made
        return self._ready

    def gains(self, raw: bytes) -> np.ndarray:
        """For each window, by how many bytes the toxic dictionary makes it shorter."""
        toxic, ordinary = self._compressors()
        w = windows(raw)
        return np.fromiter(map(len, map(ordinary, w)), np.int64, len(w)) - np.fromiter(map(len, map(toxic, w)), np.int64, len(w))

    def summary(self, raw: bytes) -> list[float]:
        g = self.gains(raw)
        n = len(g)
        if not n:
            return [0.0] * 7
        return [min(g.max(), 12) / 4, (g >= 2).mean() * 8, (g >= 3).mean() * 12, (g >= 5).mean() * 16, np.log1p((g >= 3).sum()), np.log1p(n) / 4, float(np.clip(g.mean(), -2, 2))]

    def score(self, raw: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(raw))
        x = np.array([[1.0, *self.summary(t)] for t in raw]).reshape(-1, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_share: float) -> Distance:
    """Make the dictionaries, then calibrate. `toxic_share` is that of all labelled rows, which the sample may not have."""
    t, o = (one_of_copies([set(x.translate(LOWER).split()) for x in part]) for part in (toxic, ordinary))
    tail = b" ".join(p.strip() if p[:1] == b" " == p[-1:] else p for p in telling(t, o))
    common = Counter()
    for s in o:
        common.update(s)
    words = sorted(common, key=lambda w: (-common[w], w))
    more, size = [], 0
    for w in words[COMMON:]:
        if size + len(w) + 1 > len(tail):
            break
        more.append(w)
        size += len(w) + 1
    d = Distance(b" " + b" ".join(reversed(words[:COMMON])) + b" ", tail + b" ", b" ".join(more) + b" ")
    if not toxic or not ordinary:
        return d
    x = np.array([d.summary(r) for r in [*toxic, *ordinary]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    d.weights = logistic(x, y)
    odds = lambda p: np.log(p / (1 - p))
    d.weights[0] += odds(np.clip(toxic_share, 1e-4, 1 - 1e-4)) - odds(len(toxic) / len(y))
    return d


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Distance:
    """Learn on a bounded sample of labelled rows of the training folds, the same rows each time."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id", FOLDS)).groupBy("doc_id").agg((F.max(label) > 0).alias("y"))
    total = rows.agg(F.count("*"), F.sum(F.col("y").cast("long"))).first()
    if not total[0]:
        return Distance(b"", b"", b"")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("y").orderBy(*order).limit(TOXIC_SAMPLE).unionAll(rows.where("not y").orderBy(*order).limit(ORDINARY_SAMPLE))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = bounded(rows, "y", max(TOXIC_SAMPLE, ORDINARY_SAMPLE), SAMPLE_BYTES).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    raw, y = [x.encode() if x else b"" for x in got["text"].to_pylist()], got["y"].to_pylist()
    return fit([r for r, t in zip(raw, y, strict=True) if t], [r for r, t in zip(raw, y, strict=True) if not t], (total[1] or 0) / total[0])


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", predict_from: float = PREDICT_FROM) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs`.

    A null text is scored as an empty one. Without toxic or without ordinary rows to learn from every
    score is zero. A null doc_id counts as held out; repeated ids keep their own rows. Of the documents only
    doc_id and text are read."""
    known = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = known.value.score(texts(batch))
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), held_out_of(batch.column("doc_id").to_pylist(), FOLDS), pa.array(p), pa.array((p >= predict_from).astype(np.int32)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
