"""Operator 4: token ids in Arrow IPC files of equal-length sequences.

All documents, in ascending doc_id order, make one stream of ids that is cut into shards. A shard
is one Arrow IPC file whose batches hold fixed-size lists, `tokens` of LENGTH ids and `mask` of LENGTH bytes (1: an id,
0: padding after the shard's last id). All batches but the last hold BATCH sequences, so sequence i of a shard is row i % BATCH of batch i // BATCH
and a memory map hands it and its mask out without a copy. A second file beside it, named *.docs.arrow, has (doc_id, first, n_tokens) of the
shard's documents. The manifest, a Parquet table, names the shards that count: files carry the task
attempt in their name, so what a lost or repeated task wrote is never read."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch_path
from .common import chunks, record_batch, texts

#: Ids of a sequence, sequences of a batch, ids from which on a new shard begins, the id that ends a document.
LENGTH, BATCH, SHARD, END = 1024, 256, 16 << 20, 2
#: Words whose ids a worker remembers, words that the library gets as one text: for more, its time grows faster than they do.
REMEMBERED, JOINED = 450_000, 256

#: Lower-case printable ASCII, and its pieces as the vocabulary cuts them. Fixed values of that vocabulary.
_PLAIN = re.compile(rb"[!-@\[-~]+").fullmatch
#: Signs that may stand behind a word: no rule of that vocabulary takes them together with a letter.
_MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


def _letters(t: str) -> bool:
    """True for letters alone that stay as many letters in lower case."""
    return t.isalpha() and (t.islower() or len(low := t.lower()) == len(t) and low.isalpha())


class WordEncoder:
    """Ids as the tokenizers library gives them, remembered by word.

    The vocabulary must drop white space between words, as those of the kind of word_bpe_49k.json do; then no
    word depends on another. ASCII letters are lower-cased first if the vocabulary does so itself and
    no special string can arise from it. The ids of words are remembered, and a document's are gathered from them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_str(json.dumps(spec | {"padding": None, "truncation": None}))
        # the same merges alone, for pieces that the vocabulary's own rules have nothing left to do with
        self.bare = Tokenizer.from_str(json.dumps(spec | {"padding": None, "truncation": None, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower = self.tok.encode("AB", add_special_tokens=False).ids == self.tok.encode("ab", add_special_tokens=False).ids
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.table = WordTable(self.encode_words, self.dtype, REMEMBERED)

    def _joined(self, tok, words: list[bytes], odd: list[bytes]) -> None:
        """Encode words that are one piece each as one text; their last ids mark where each ends."""
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            ids = np.array(tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(part):
                odd += part
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(part, (stops * self.dtype.itemsize).tolist(), strict=True):
                self.known[w] = data[at:stop]
                at = stop

    def _learn(self, new: list[bytes]) -> None:
        pieces, letters, odd, cut = set(), set(), [], []
        for w in new:
            if w.isalpha():
                # a text with '<|' keeps its capitals, which `bare` does not lower-case
                if w.islower() or not self.lower:
                    pieces.add(w)
                else:
                    odd.append(w)
            elif w.isascii():
                if _PLAIN(w) and b"<|" not in w:
                    parts = _PIECE(w)
                    pieces.update(parts)
                    cut.append((w, parts))
                else:
                    odd.append(w)
            elif _letters((body := w.rstrip(_MARKS)).decode()):
                letters.add(body)
                if len(body) < len(w):
                    pieces.add(tail := w[len(body) :])
                    cut.append((w, (body, tail)))
            else:
                odd.append(w)
        self._joined(self.bare, list(pieces.difference(self.known)), odd)
        self._joined(self.tok, list(letters), odd)
        for start in range(0, len(odd), 4096):
            part = odd[start : start + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, dtype=self.dtype).tobytes()
        get = self.known.__getitem__
        for w, parts in cut:
            self.known[w] = b"".join(map(get, parts))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The bytes of the ids of different words; nothing is remembered."""
        self.known = {}
        self._learn(words)
        out = list(map(self.known.__getitem__, words))
        self.known = {}
        return out

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        cut = [(t.lower() if self.lower and b"<|" not in t else t) for t in raw]
        words, n_words = split(cut)
        return self.table.sequences(self.table.look_up(words)[0], n_words)


def split(raw: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 texts in a row, cut at ASCII white space alone, and how many each text has."""
    lists = pc.ascii_split_whitespace(pa.array(raw, pa.large_string()))
    words, edge = lists.flatten(), lists.offsets.to_numpy()
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty one
    if not some.all():
        words, edge = words.filter(pa.array(some)), np.r_[0, np.cumsum(some)][edge]
    return words, np.diff(edge)


class WordTable:
    """Numbers of words, and the sequences of all of them in a row, as `spell` gives them; no more than `most` words are remembered from one call to the next.

    Over that, the words that stood in the texts once alone are forgotten, which are most, and of the others those met least: what is common is spelled once."""

    def __init__(self, spell, unit: np.dtype, most: int):
        self.spell, self.unit, self.most = spell, unit, most
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pieces, self.start, self.n, self.met = np.array([], dtype=self.unit), *[np.array([], dtype=np.int64) for _ in range(3)]

    def thin(self) -> np.ndarray:
        """Forget all but the most common words, half of `most` at most; returns the numbers that these had, in the order of their new ones."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: self.most // 2]])
        words = list(self.index)  # in the order of their numbers
        self.index = {words[i]: k for k, i in enumerate(kept.tolist())}
        n = self.n[kept]
        stop = np.cumsum(n)
        self.pieces = self.pieces[np.arange(stop[-1] if len(kept) else 0) + np.repeat(self.start[kept] - (stop - n), n)]
        self.start, self.n, self.met = stop - n, n, self.met[kept] // 2  # what was common long ago counts less
        return kept

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray | slice]:
        """Numbers of the words, those that are new: they have the highest numbers, in this order; and the numbers that the others had in the call before."""
        old = self.thin() if len(self.index) > self.most else slice(None)
        # equal words are found by Arrow, so that Python meets each once
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(number < 0)
        fresh = [distinct[i] for i in unknown.tolist()]
        if fresh:
            got = self.spell(fresh)
            n = np.fromiter(map(len, got), np.int64, len(got)) // self.unit.itemsize
            number[unknown] = np.arange(len(self.n), len(self.n) + len(fresh))
            self.index.update(zip(fresh, number[unknown].tolist(), strict=True))
            self.start = np.r_[self.start, len(self.pieces) + np.cumsum(n) - n]
            self.n = np.r_[self.n, n]
            self.pieces = np.r_[self.pieces, np.frombuffer(b"".join(got), dtype=self.unit)]
            self.met = np.r_[self.met, np.zeros(len(fresh), dtype=np.int64)]
        self.met[number] += np.bincount(code, minlength=len(number))
        return number[code], fresh, old

    def sequences(self, idx: np.ndarray, n_words: np.ndarray) -> list[bytes]:
        """The bytes of the sequence of each document."""
        n = self.n[idx]
        stop = np.cumsum(n)
        at = np.arange(stop[-1] if len(idx) else 0) + np.repeat(self.start[idx] - (stop - n), n)
        data = self.pieces[at].tobytes()
        edge = (np.r_[0, stop][np.r_[0, np.cumsum(n_words)]] * self.unit.itemsize).tolist()
        return [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]


@lru_cache(maxsize=2)
def _coder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def token_type(dtype: np.dtype) -> pa.DataType:
    return pa.uint16() if dtype.itemsize == 2 else pa.uint32()


class ShardWriter:
    """Writes one shard; at most BATCH sequences are held."""

    def __init__(self, uri: str, dtype: np.dtype, length: int):
        self.fs, self.path = _filesystem(uri)
        self.type, self.dtype, self.length = token_type(dtype), dtype, length
        self.schema = pa.schema([("tokens", pa.list_(self.type, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.held_bytes, self.tokens = 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.tokens, n))
        self.tokens += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= BATCH * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        row = self.length * self.dtype.itemsize
        whole = len(data) // row
        at = 0
        while at + BATCH <= whole:
            self._batch(np.frombuffer(data, self.dtype, BATCH * self.length, at * row), BATCH * self.length)
            at += BATCH
        rest = data[at * row :]
        if last and rest:
            padded = rest + b"\0" * (-len(rest) % row)
            self._batch(np.frombuffer(padded, self.dtype), len(rest) // self.dtype.itemsize)
            rest = b""
        self.held, self.held_bytes = [rest], len(rest)

    def _batch(self, values: np.ndarray, used: int) -> None:
        mask = np.ones(len(values), dtype=np.uint8)
        mask[used:] = 0
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(values, self.type), pa.array(mask))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        rows = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "first": pa.array([d[1] for d in self.docs], pa.int64()), "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(self.path + ".docs.arrow") as sink, pa.ipc.new_file(sink, rows.schema) as out:
            out.write_table(rows, max_chunksize=65536)


class Shard:
    """Random access to a shard: `sequence(i)` and `mask(i)` are views of the file where it can be mapped."""

    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.open = (lambda p: pa.memory_map(p)) if local else self.fs.open_input_file
        self.path = path
        self.reader = pa.ipc.open_file(self.open(path))
        self._at: tuple[int, pa.RecordBatch] | None = None
        self.length = self.reader.schema.field("tokens").type.list_size

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._at is None or self._at[0] != k:
            self._at = (k, self.reader.get_batch(k))
        return self._at[1]

    def __len__(self) -> int:
        """Sequences of the shard."""
        k = self.reader.num_record_batches
        return (k - 1) * BATCH + self._batch(k - 1).num_rows if k else 0

    def _row(self, i: int, column: str) -> np.ndarray:
        return self._batch(i // BATCH).column(column).values.slice(i % BATCH * self.length, self.length).to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        return self._row(i, "tokens")

    def mask(self, i: int) -> np.ndarray:
        return self._row(i, "mask")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first, ids) of each document, read from the file in one pass."""
        index = pa.ipc.open_file(self.open(self.path + ".docs.arrow"))
        held, at, k = np.array([], dtype=np.uint32), 0, 0  # ids not handed out, where they begin, next batch
        for b in range(index.num_record_batches):
            rows = index.get_batch(b)
            for doc_id, first, n in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "first", "n_tokens")), strict=True):
                parts, have = [held[first - at :]], len(held) - (first - at)
                while have < n:
                    batch = self.reader.get_batch(k)
                    tokens, mask = (batch.column(c).values for c in ("tokens", "mask"))
                    got = tokens.to_numpy(zero_copy_only=True)
                    used = int(np.count_nonzero(mask.to_numpy(zero_copy_only=True)))
                    got = got[:used]  # padding stands at the end only
                    parts.append(got)
                    have += len(got)
                    k += 1
                whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
                held, at = whole[n:], first + n
                yield doc_id, first, whole[:n]


def write(docs: DataFrame, tokenizer: str, out: str, end: int = END, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Encode all texts and write the shards under `out`, a folder that all executors reach.

    Returns the manifest, read back from its Parquet table: (part, number, path, n_tokens, n_docs, start), start being the
    ids of all shards before. A null text is empty: its document has the end id alone. Rows with a null doc_id
    come first; rows of one doc_id keep the order of their texts. Other columns are not read."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _filesystem(out)
        fs.create_dir(base, recursive=True)
        coder = _coder(tokenizer)
        tail = np.array([end], dtype=coder.dtype).tobytes()
        writer, number = None, 0

        def close() -> pa.RecordBatch:
            writer.close()
            return record_batch(schema, [task.partitionId()], [number], [uri], [writer.tokens], [len(writer.docs)])

        for batch in chunks(batches, most=8 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts(batch)), strict=True):
                if writer is None:
                    uri = f"{out}/shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.arrow"
                    writer = ShardWriter(uri, coder.dtype, length)
                writer.add(doc_id, ids + tail)
                if writer.tokens >= shard:
                    yield close()
                    writer, number = None, number + 1
        if writer is not None:
            yield close()

    table = f"{out}/manifest"
    ordered.mapInArrow(run, "part long, number long, path string, n_tokens long, n_docs long").write.parquet(table)
    rows = docs.sparkSession.read.parquet(table)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row for each shard


def read(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document in the shards of the manifest."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    n = max(1, min(manifest.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, first, ids in Shard(path).documents():
                    rows.append((doc_id, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield record_batch(schema, *map(list, zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield record_batch(schema, *map(list, zip(*rows, strict=True)))

    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, out: str | None = None) -> DataFrame:
    """Write the files (in the shared folder, if no other is named) and describe each document from them."""
    return read(write(docs, tokenizer, out or scratch_path(docs.sparkSession, "tokens")))
