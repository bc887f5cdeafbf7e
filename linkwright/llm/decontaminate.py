"""Operator 6: benchmark decontamination with an FM-index for each shard of documents.

A shard is a chunk of a partition. Its words become numbers: a word of the benchmark has its own,
every other word is a break. Stretches between breaks that are shorter than the shortest window can't
hold one and are left out; the rest stands in one text. Over it the shard builds a suffix array, the
Burrows-Wheeler transform, a wavelet matrix for ranks and sampled suffix positions. All windows
of all items are searched backwards at once, their occurrences are located by walking to the next sampled
position, and the spans of each document are merged."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record_batch, texts, with_text

#: Words of a window; an item of fewer words is one window.
WINDOW = 8
#: Bytes of benchmark text that go to the executors at once; a larger benchmark is dealt with in blocks.
BLOCK_BYTES = 8 << 20
#: Every so manieth position of the shard's text keeps its place in the suffix array.
SAMPLE = 4
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8: digits, ASCII letters and all characters beyond ASCII."""
    return raw.translate(_TABLE).split()


class Phrases:
    """Windows of benchmark items as numbers, and the items that each window belongs to."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names: list[str] = []
        self.vocab: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        place: dict[str, int] = {}
        for name, raw in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(raw)]
            if name not in place:
                place[name] = len(self.names)
                self.names.append(name)
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                window = tuple(ids[i : i + WINDOW])
                k = number.setdefault(window, len(number))
                if k == len(owners):
                    owners.append(set())
                owners[k].add(place[name])
        self.length = np.array([len(w) for w in number], dtype=np.int64)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.words = np.zeros((len(number), WINDOW), dtype=np.int64)  # from the right, as the search goes
        for k, w in enumerate(number):
            self.words[k, : len(w)] = w[::-1]
        self.owner_start = np.cumsum([0] + [len(o) for o in owners])
        self.owner = np.array([i for o in owners for i in sorted(o)], dtype=np.int64)


class FMIndex:
    """An FM-index over numbers; 0 stands for breaks and is never searched for."""

    def __init__(self, text: np.ndarray, largest: int):
        n = len(text)
        self.n = n
        breaks = text == 0
        key = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))  # each break differs, so sorting ends
        order = np.argsort(key, kind="stable")
        rank, step = self._ranks(key[order], order, n), 1
        while len(open_ := np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)):  # what is not in place yet
            ahead = np.full(n, -1, dtype=np.int64)
            ahead[:-step] = rank[step:]
            pair = rank * (n + 1) + ahead + 1
            at = open_[np.argsort(pair[open_], kind="stable")]
            p = pair[at]
            first = np.r_[True, p[1:] != p[:-1]]
            group = np.r_[True, rank[at][1:] != rank[at][:-1]]
            index = np.arange(len(at))
            base = np.maximum.accumulate(np.where(group, index, 0))
            rank[at] = rank[at] + np.maximum.accumulate(np.where(first, index, 0)) - base
            step *= 2
        sa = np.empty(n, dtype=np.int64)
        sa[rank] = np.arange(n)
        bwt = text[sa - 1]
        # places are kept for every SAMPLE-th position and after breaks, so a walk never passes a break
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept, self.kept_rank, self.place = kept, np.cumsum(kept), sa[kept]
        self.bwt = bwt
        count = np.bincount(text, minlength=largest + 2)
        self.before = np.r_[0, np.cumsum(count)]
        self.levels = []
        self.bits = max(1, int(largest).bit_length())
        cur = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = n - int(ones[-1])
            self.levels.append((ones, zeros))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # where each symbol begins on the lowest level
        self.low = self._rank_walk(np.arange(largest + 1), np.zeros(largest + 1, dtype=np.int64))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        first = np.r_[True, key[1:] != key[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        return rank

    def _rank_walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level)) & 1
            r = ones[i]
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        return self._rank_walk(symbol, i) - self.low[symbol]

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases, their words given from the last to the first."""
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.n, dtype=np.int64)
        for k in range(words.shape[1]):
            at = np.flatnonzero((length > k) & (hi > lo))
            if not len(at):
                break
            s = words[at, k]
            lo[at] = self.before[s] + self.rank(s, lo[at])
            hi[at] = self.before[s] + self.rank(s, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix array."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        at, cur = np.arange(len(rows)), rows
        while len(at):
            hit = self.kept[cur]
            out[at[hit]] = self.place[self.kept_rank[cur[hit]] - 1] + steps
            at, cur = at[~hit], cur[~hit]
            s = self.bwt[cur]
            cur = self.before[s] + self.rank(s, cur)
            steps += 1
        return out


def _occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Position and phrase of every occurrence in a shard's numbers, where 0 ends each document."""
    none = np.array([], dtype=np.int64)
    inside = ids != 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= phrases.shortest
    start, length = start[long], (stop - start)[long]
    if not len(start):
        return none, none
    shift = np.cumsum(length + 1) - (length + 1)
    text = np.zeros(int((length + 1).sum()), dtype=np.int64)
    origin = np.zeros(len(text), dtype=np.int64)
    rows = np.arange(int(length.sum()))
    run = np.repeat(np.arange(len(length)), length)
    within = rows - np.repeat(np.cumsum(length) - length, length)
    text[shift[run] + within] = ids[start[run] + within]
    origin[shift[run] + within] = start[run] + within
    index = FMIndex(text, len(phrases.vocab))
    lo, hi = index.search(phrases.words, phrases.length)
    n = np.maximum(hi - lo, 0)
    if not n.any():
        return none, none
    phrase = np.repeat(np.arange(len(n)), n)
    row = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return origin[index.locate(row)], phrase


class Shard:
    """Documents of a chunk: their words' numbers, which words are hit, and items by document."""

    def __init__(self, raw: list[bytes], phrases: Phrases):
        get = phrases.vocab.get
        parts, self.n_words = [], []
        for t in raw:
            words = words_of(t)
            self.n_words.append(len(words))
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, dtype=np.int64))
        ids = np.concatenate(parts) if parts else np.array([], dtype=np.int64)
        self.start = np.cumsum([0] + [n + 1 for n in self.n_words])
        at, phrase = _occurrences(ids, phrases) if len(phrases.length) else (np.array([], dtype=np.int64),) * 2
        depth = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + phrases.length[phrase], -1)
        self.hit = np.cumsum(depth)[:-1] > 0
        doc = np.searchsorted(self.start, at, side="right") - 1
        self.items: list[list[str]] = [[] for _ in raw]
        if len(doc):
            pairs = np.unique(np.stack([doc, phrase], axis=1), axis=0)
            n = phrases.owner_start[pairs[:, 1] + 1] - phrases.owner_start[pairs[:, 1]]
            of = np.repeat(pairs[:, 0], n)
            k = np.repeat(phrases.owner_start[pairs[:, 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            for d, i in np.unique(np.stack([of, phrases.owner[k]], axis=1), axis=0).tolist():
                self.items[d].append(phrases.names[i])

    def spans(self, d: int) -> list[tuple[int, int]]:
        """Merged spans of hit words of a document: first word, word after the last."""
        hit = self.hit[self.start[d] : self.start[d + 1] - 1]
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def blocks(benchmark: DataFrame, item: str = "item_id", most: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark in blocks of at most `most` bytes of text (or one item), so what is sent at once is bounded.
    Items without an id are left out."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text")).orderBy("name", "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        raw = r.text.encode()
        if held and size + len(raw) > most:
            yield Phrases(held)
            held, size = [], 0
        held.append((r.name, raw))
        size += len(raw)
    yield Phrases(held)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def find(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", min_items: int = 2, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of `docs`.

    A null or empty text has no words; a null or empty item has no window; an item without an id is left out;
    items with the same id count once. Null and repeated doc_ids keep their own rows. Other
    columns are not read."""
    docs = docs.select("doc_id", "text")
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, item, most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=SHARD_BYTES):
            s = _over(texts(batch), sent)
            hits = np.add.reduceat(s.hit.astype(np.int64), s.start[:-1])
            yield record_batch(_FOUND, batch.column("doc_id").cast(pa.int64()), s.n_words, hits.tolist(), [len(i) for i in s.items], [_digest(i) for i in s.items], [len(i) >= min_items for i in s.items])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _over(raw: list[bytes], sent: list) -> Shard:
    """The shard's hits and items over all blocks; with more than one, a worker holds one at a time."""
    out = None
    for b in sent:
        s = Shard(raw, b.value)
        if len(sent) > 1 and hasattr(b, "_value"):
            del b._value
        if out is None:
            out = s
        else:
            out.hit |= s.hit
            out.items = [sorted({*i, *j}) for i, j in zip(out.items, s.items, strict=True)]
    return out


def cut_words(text: str, spans: list[tuple[int, int]], word: re.Pattern = _WORD) -> str:
    """The text without the words of the spans; what stood between them goes too."""
    places = [m.span() for m in word.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return "".join(out)


def remove(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", most: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with every occurrence of a benchmark window cut out of the texts; rows and columns stay, and
    n_chars, if there, follows. A text that loses all its words stays as what is left of it."""
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, item, most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=SHARD_BYTES):
            merged = _over(texts(batch), sent)
            if not merged.hit.any():
                yield batch
                continue
            out = batch.column("text").to_pylist()
            for d in range(len(out)):
                spans = merged.spans(d)
                if spans:
                    out[d] = cut_words(out[d], spans)
            yield with_text(batch, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
