"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within R bits have a common variant within R/2 bits of each. So every distinct
fingerprint emits all its variants within half the radius, rows meet on equal variants, and pairs that meet are
verified on the whole fingerprint. With `parts` > 1 the same is done on parts of the fingerprint: of
R differing bits one part holds at most R // parts, so each part emits its own ball of half that
radius. Both are exact. One part of 64 bits and radius 4 makes 2081 variants a fingerprint, two
parts make 66, at the price of more pairs that fail verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import materialize
from .common import chunks, free_name, record_batch, texts

BITS, RADIUS, SHINGLE, SEED, PARTS = 64, 4, 4, 42, 2
#: A bucket of more fingerprints is split further, by exact blocks of the fingerprint.
LARGE_BUCKET = 4096
#: Tasks that the label of a component is sent to.
SALTS = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned; without words it is zero."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp), fp being the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), pa.array(fp))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to `radius` set bits out of `width`."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def variants(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Rows (part, variant, fp): the ball of half the part's radius around each part of each fingerprint."""
    width = BITS // parts
    masks = ball(width, -(-(radius // parts) // 2))
    whole = (1 << width) - 1
    out = None
    for p in range(parts):
        value = F.col("fp") if parts == 1 else F.shiftrightunsigned("fp", p * width).bitwiseAND(F.lit(whole))
        signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks])
        rows = fps.select(F.lit(p).alias("part"), value.alias("value"), "fp", F.explode(signed).alias("mask")).select("part", F.expr("value ^ mask").alias("variant"), "fp")
        out = rows if out is None else out.unionAll(rows)
    return out


class Forest:
    """Components within one task: of the pairs that match, only those that join two trees leave it."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.node = np.unique(fps, return_inverse=True)
        self.root = np.arange(len(self.fps))

    def add(self, a: np.ndarray, b: np.ndarray, out: list[tuple[int, int]]) -> None:
        a, b = self.node[a], self.node[b]
        new = self.root[a] != self.root[b]
        if not new.any():
            return
        _, first = np.unique(np.stack([self.root[a[new]], self.root[b[new]]], axis=1), axis=0, return_index=True)
        parent = self.root
        for x, y in zip(a[new][first].tolist(), b[new][first].tolist(), strict=True):
            r, s = x, y
            while parent[r] != r:
                r = parent[r]
            while parent[s] != s:
                s = parent[s]
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        self.root = parent


def _within(key: np.ndarray, rows: np.ndarray, fp: np.ndarray, radius: int, forest: Forest, out: list) -> None:
    """Compare the rows of equal keys, which stand together, in steps of growing distance."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    left = np.repeat(start + length, length) - np.arange(len(key))  # rows from here to the end of the bucket
    at, lag = np.arange(len(key)), 1
    while len(at := at[left[at] > lag]):
        a, b = rows[at], rows[at + lag]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        forest.add(a[near], b[near], out)
        lag += 1


def link(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of fingerprints within the radius that share a key, as far as they join components; `key` is sorted.

    A bucket of more than LARGE_BUCKET rows is dealt by radius + 1 blocks of the fingerprint: of
    `radius` differing bits at least one block has none, so near rows meet in one of them."""
    forest, out = Forest(fp), []
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=np.int64)
    length = np.diff(np.r_[start, len(key)])
    small = np.repeat(length <= LARGE_BUCKET, length)
    rows = np.flatnonzero(small)
    if len(rows):
        _within(key[rows], rows, fp, radius, forest, out)
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    for s, n in zip(start[length > LARGE_BUCKET].tolist(), length[length > LARGE_BUCKET].tolist(), strict=True):
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            block = fp[s : s + n] >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)
            order = np.argsort(block, kind="stable")
            _within(block[order], order + s, fp, radius, forest, out)
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return forest.fps[pairs]


def near_pairs(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Edges (a, b) that have the components of all pairs of distinct fingerprints within the radius."""
    rows = variants(fps, radius, parts).repartition("part", "variant").sortWithinPartitions("part", "variant", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(key, fp):
            pairs = link(key, fp, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            # two parts of the key make one number: equal numbers mean equal keys, as a part has fewer than 64 bits unless it is alone
            key = batch.column("variant").to_numpy().view(np.uint64) ^ (batch.column("part").to_numpy().astype(np.uint64) << np.uint64(60))
            held.append(np.stack([key, batch.column("fp").to_numpy().view(np.uint64)]))
            if sum(x.shape[1] for x in held) < 400_000:
                continue
            block = np.concatenate(held, axis=1)
            change = np.flatnonzero(block[0][1:] != block[0][:-1])
            if not len(change):
                held = [block]
                continue
            cut = int(change[-1]) + 1
            yield done(block[0][:cut], block[1][:cut])
            held = [block[:, cut:]]
        if held:
            block = np.concatenate(held, axis=1)
            yield done(block[0], block[1])

    return rows.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of `docs`: component_id is the smallest doc_id that
    can be reached over fingerprints within the radius, itself included.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. A row with a null
    doc_id links nothing and has component_id null if no row with an id has its component; otherwise that
    component's. Repeated ids keep their own rows. Other columns are not read. Exact copies share a
    fingerprint and are one row before any pair is made."""
    found = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = near_pairs(distinct.select("fp"), radius, parts)
    label = connected_components(pairs, "a", "b")
    joined = materialize(distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", "component"), "labelled")
    linked = joined.where("component is not null")
    # a large component is one key: its label is sent to SALTS tasks, and each fingerprint goes to one of them. Only fingerprints with a link get here
    least = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_label = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"]).select("fp", "component_id")
    by_fp = by_label.unionAll(joined.where("component is null").select("fp", F.col("least").alias("component_id")))
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest id stays,
    once. Rows with a null id stay. The columns are those of `docs`."""
    gone = components(docs, radius, parts).where("doc_id <> component_id").select("doc_id").distinct()
    # the same join at every size: what goes grows with the documents, so it is never sent whole
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, "doc_id", "left_semi")
    # rows of one id go by their JSON, which every type of column has, also those that cannot be sorted
    row = free_name("_row", docs.columns)
    first = again.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*docs.columns))))).where(F.col(row) == 1).drop(row)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
