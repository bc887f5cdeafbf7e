"""Operator 10: byte-level BPE encoding and decoding over an index of pair occurrences."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, record_batch

#: How byte-level vocabularies write bytes as letters. Fixed values of that format.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The word pattern of such vocabularies. A fixed value of that format.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
#: From so many occurrences on a pair is merged at all of them at once.
MANY = 150


def byte_letters() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    return {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBPE:
    """The vocabulary of a tokenizers file, applied to many words at once.

    All new words of a partition's chunk stand in one array of symbols. For every adjacent pair that
    has a rank the index lists all positions where it begins. The lowest active rank is taken
    from a heap, all its occurrences are merged from left to right, and the lists of the pairs to the left and
    right are updated. A merge only makes pairs of higher ranks or, if not, they go on the
    heap again, so each word gets the merges that one word alone would get."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in self.vocab.items()}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = self.vocab[c]
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.rank.setdefault(self.vocab[a] << 32 | self.vocab[b], r)
        ids = self.byte_id.tolist()
        self.byte_rank = np.array([[self.rank.get(a << 32 | b, -1) for b in ids] for a in ids], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(WORD)
        self.shown = {i: str(i) for i in self.bytes_of}
        #: For each word that is remembered its ids, as text, and their bytes.
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] | None = None

    def forget(self) -> None:
        self.ids, self.raw, self.older = {}, {}, None

    def _merge_all(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words in a row, and where each word's end."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        inside = np.ones(len(data), dtype=bool)
        inside[ends - 1] = False
        n = len(data)
        sym, after, before = array("q", bytes(8 * n)), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        before[0] = n - 1  # the last end
        np_sym, np_after, np_before = (np.frombuffer(x, dtype=np.int64) for x in (sym, after, before))
        np_sym[:] = np.where(inside, self.byte_id[data], -1)  # -1 ends each word
        first = np.where(inside[:-1] & inside[1:], self.byte_rank[data[:-1], data[1:]], -1)
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, start = np.unique(first[at], return_index=True)
        places, stops = at.tolist(), [*start[1:].tolist(), len(at)]
        index = {r: places[a:b] for r, a, b in zip(ranks.tolist(), start.tolist(), stops, strict=True)}
        heap = ranks.tolist()  # ascending, so a heap
        rank_of, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            where = index.pop(r)
            left, right, made = self.merge[r]
            if left == right:
                where.sort()
            high = made << 32
            if len(where) >= MANY and left != right:
                i = np.unique(np.array(where))
                i = i[np_sym[i] == left]
                j = np_after[i]
                right_there = np_sym[j] == right
                i, j = i[right_there], j[right_there]
                if not len(i):
                    continue
                k = np_after[j]
                np_sym[i], np_sym[j], np_after[i], np_before[k] = made, -2, k, i
                h = np_before[i]
                for at, ids, by in ((i, np_sym[k], lambda t: high | t), (h, np_sym[h], lambda t: t << 32 | made)):
                    order = np.argsort(ids, kind="stable")
                    ids, at = ids[order], at[order]
                    each, start = np.unique(ids, return_index=True)
                    for t, a, b in zip(each.tolist(), start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
                        if t >= 0 and (q := rank_of(by(t))) is not None:
                            if q in index:
                                index[q] += at[a:b].tolist()
                            else:
                                index[q] = at[a:b].tolist()
                                push(heap, q)
                continue
            for i in where:
                if sym[i] != left:
                    continue
                j = after[i]
                if sym[j] != right:
                    continue
                sym[i] = made
                sym[j] = -2
                after[i] = k = after[j]
                before[k] = i
                t = sym[k]
                if t >= 0 and (q := rank_of(high | t)) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        push(heap, q)
                h = before[i]
                s = sym[h]
                if s >= 0 and (q := rank_of(s << 32 | made)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        push(heap, q)
        kept = np_sym >= 0
        return np_sym[kept].tolist(), np.cumsum(kept)[ends - 1].tolist()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.ids) > REMEMBERED:
            self.older = (self.ids, self.raw)
            self.ids, self.raw = {}, {}
        words = words.difference(self.ids)
        if self.older:
            ids, raw = self.older
            for w in [w for w in words if w in ids]:
                self.ids[w], self.raw[w] = ids[w], raw[w]
            words = words.difference(ids)
        new = list(words)
        if new:
            ids, stops = self._merge_all(new)
            shown, raw, at = list(map(self.shown.__getitem__, ids)), list(map(self.bytes_of.__getitem__, ids)), 0
            for w, stop in zip(new, stops, strict=True):
                self.ids[w] = ",".join(shown[at:stop])
                self.raw[w] = b"".join(raw[at:stop])
                at = stop

    def pieces(self, text: str) -> list[str]:
        """Words in order; special strings stand alone and are marked by a leading NUL pair."""
        if not self.cut or not any(s in text for s in self.special):
            return self.word.findall(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                mark = "\0\0" + part
                out.append(mark)
            else:
                out += self.word.findall(part)
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), with `ids` also the ids. A null or empty text has no
    ids and the hashes of the empty string. A row with a null or repeated id gets its own result row. Other
    columns are not read. Strings of special tokens in a text become their ids. `vocabulary`
    is the path of a byte-level tokenizers file on every executor."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in chunks(batches):
            cut = [coder.pieces(t or "") for t in batch.column("text").to_pylist()]
            for start in range(0, len(cut), 2048):
                part = cut[start : start + 2048]
                new: set[str] = set()
                for words in part:
                    new.update(words)
                marks = {w for w in new if w[:2] == "\0\0" and w[2:] in coder.special}
                coder.learn(new - marks)
                for w in marks:
                    coder.ids[w], coder.raw[w] = str(coder.special[w[2:]]), w[2:].encode()
                shown = [",".join(map(coder.ids.__getitem__, words)) for words in part]
                counts = [s.count(",") + 1 if s else 0 for s in shown]
                hashes = [hashlib.sha256(s.encode()).hexdigest() for s in shown]
                decoded = [hashlib.sha256(b"".join(map(coder.raw.__getitem__, words)).decode("utf-8", "replace").encode()).hexdigest() for words in part]
                lists = pa.array([np.fromstring(s, np.int32, sep=",") if s else [] for s in shown], pa.list_(pa.int32())) if ids else []
                cols = [batch.column("doc_id").slice(start, len(part)).cast(pa.int64()), counts, hashes, decoded] + [lists] * ids
                yield record_batch(schema, *cols)
        coder.forget()  # the worker lives on, and other stages need its memory

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
