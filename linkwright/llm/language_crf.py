"""Operator 8: language of each word by a linear-chain conditional random field.

A word's features are its beginnings and ends of 1 to 4 characters, all its runs of 3 characters and, if it is in the lexicon learned from
the sample, itself. Transitions between the languages of neighbouring words, and the language a text begins in, are learned on sequences in which the
language changes, so code-switched text gets a label for each word (`label_words`). Labels are the marginals of the
forward-backward algorithm; a document's language is the one with the largest mean marginal."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunks, held_out, held_out_of, one_blas_thread, record_batch

#: Buckets of hashed features, documents to learn from at most, bytes of the texts of a language at most, words of a training sequence and their number.
BUCKETS, SAMPLE, SAMPLE_BYTES, LENGTH, SEQUENCES = 1 << 15, 3000, 8 << 20, 48, 6000
#: Words of the lexicon at most, the commonest, and sample documents that one has to be in.
LEXICON, LEAST = 50_000, 2
FOLDS = 5
#: Words of a block: blocks of all texts are walked side by side.
BLOCK = 64
#: Words whose scores a worker remembers.
REMEMBERED = 300_000


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word: its ends, and its runs of characters with a sign at either end."""
    b = f"^{word}$".encode("utf-32-le")
    crc, mask, n = zlib.crc32, BUCKETS - 1, len(b)
    out = [crc(b[i : i + 12], 4) & mask for i in range(0, n - 8, 4)]
    for k in range(8, min(24, n), 4):  # with the sign, 1 to 4 characters
        out.append(crc(b[:k], 2) & mask)
        out.append(crc(b[n - k :], 3) & mask)
    return out


def tokens(text: str) -> list[str]:
    """Lower-cased words between white space; which of them have a letter is decided word by word."""
    return text.lower().split()


def letters(word: str) -> str:
    return "".join(c for c in word if c.isalpha())


def _normal(a: np.ndarray, axis) -> np.ndarray:
    return a / a.sum(axis=axis, keepdims=True)


def marginals(emission: np.ndarray, length: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences that stand one after the other in `emission` (log scores).

    Each sequence is cut into blocks. What a block does to any incoming message is one matrix; those of all blocks are made side by
    side, chained along each sequence, and then every block is walked with its true incoming messages. So the
    work is that of the plain algorithm, in steps of BLOCK and not of the longest text, and nothing is approximated."""
    k = emission.shape[1]
    n_blocks = -(-length // BLOCK)
    owner = np.repeat(np.arange(len(length)), n_blocks)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = np.repeat(np.cumsum(length) - length, n_blocks) + order * BLOCK
    size = np.minimum(BLOCK, length[owner] - order * BLOCK)
    grid = np.minimum(first[:, None] + np.arange(BLOCK), len(emission) - 1)
    inside = np.arange(BLOCK) < size[:, None]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    out = np.zeros_like(emission)
    total = len(owner)
    width = int(size.max()) if total else 0
    # matrix of each block: from the state before its first word to the state at its last word
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(width):
        at = inside[:, j]
        step = (m[at] @ t) * e[grid[at, j]][:, None, :]
        m[at] = step / step.sum(axis=(1, 2), keepdims=True)
    # chain forwards and backwards over the blocks of each sequence
    enter = np.ones((total, k)) / k  # message before a block's first word
    leave = np.ones((total, k)) / k  # message after its last word
    head = np.cumsum(n_blocks) - n_blocks
    first_message = np.exp(start - start.max())
    enter[head[n_blocks > 0]] = first_message
    for i in range(1, int(n_blocks.max()) if len(n_blocks) else 0):
        at = head[n_blocks > i] + i
        enter[at] = _normal(np.einsum("bi,bij->bj", enter[at - 1], m[at - 1]), 1)
    for i in range(int(n_blocks.max()) - 2 if len(n_blocks) else -1, -1, -1):
        at = head[n_blocks > i + 1] + i
        leave[at] = _normal(np.einsum("bij,bj->bi", m[at + 1], leave[at + 1]), 1)
    alpha = np.zeros((total, BLOCK, k))
    cur = enter
    for j in range(width):
        nxt = (cur @ t) * e[grid[:, j]]
        nxt = np.where(inside[:, j, None], _normal(nxt, 1), cur)
        alpha[:, j] = cur = nxt
    beta = leave
    for j in range(width - 1, -1, -1):
        at = inside[:, j]
        p = alpha[:, j] * beta
        out[grid[at, j]] = _normal(p[at], 1)
        beta = np.where(at[:, None], _normal((e[grid[:, j]] * beta) @ t.T, 1), beta)
    return out


class LanguageField:
    """Weights of the features for each language, transitions, and the languages themselves."""

    def __init__(self, langs: list[str], seed: int = 3):
        k = len(langs)
        self.langs = langs
        self.w = np.zeros((BUCKETS, k), dtype=np.float64)  # and, once there is a lexicon, a row for each of its words
        self.transition = np.eye(k)
        self.start = np.zeros(k)
        self.lexicon: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def __getstate__(self):
        return self.langs, self.w, self.transition, self.start, self.lexicon

    def __setstate__(self, state):
        self.langs, self.w, self.transition, self.start, self.lexicon = state
        self.known, self.rows = {}, []

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weights of all words in a row, and where each word's begin."""
        rows = [features(w) for w in words]
        for w, r in zip(words, rows, strict=True):
            if (i := self.lexicon.get(w)) is not None:
                r.append(BUCKETS + i)
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((x for r in rows for x in r), np.int64, int(n.sum())), np.cumsum(n) - n

    def fit(self, docs: list[tuple[list[str], int]], sequences: int = SEQUENCES, rounds: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 5) -> LanguageField:
        """Adaptive gradient steps on the conditional log-likelihood of sequences put together from stretches of 4 to 40 words
        of one sample document after the other. `docs`: words and language of each."""
        rng = np.random.default_rng(seed)
        k = len(self.langs)
        by = [[d for d, y in docs if y == i and d] for i in range(k)]
        able = [i for i in range(k) if by[i]]
        if not able:
            return self
        within: Counter[str] = Counter()
        for d, _ in docs:
            within.update(set(d))
        common = sorted((w for w, n in within.items() if n >= LEAST), key=lambda w: (-within[w], w))[:LEXICON]
        self.lexicon = {w: i for i, w in enumerate(common)}
        self.w = np.zeros((BUCKETS + len(common), k))
        number: dict[str, int] = {}
        x, y = np.zeros((sequences, LENGTH), dtype=np.int64), np.zeros((sequences, LENGTH), dtype=np.int64)
        for i in range(sequences):
            j = 0
            while j < LENGTH:
                lang = able[int(rng.integers(len(able)))]
                words = by[lang][int(rng.integers(len(by[lang])))]
                a = int(rng.integers(len(words)))
                part = words[a : a + int(rng.integers(4, 41))][: LENGTH - j]
                x[i, j : j + len(part)] = [number.setdefault(w, len(number)) for w in part]
                y[i, j : j + len(part)] = lang
                j += len(part)
        flat, first = self._features(list(number))
        size = np.diff(np.r_[first, len(flat)])
        seen = [np.full_like(a, 1e-3) for a in (self.w, self.transition, self.start)]
        one = np.eye(k)
        for _ in range(rounds):
            order = rng.permutation(sequences)
            for s in range(0, sequences, batch):
                at = order[s : s + batch]
                met, place = np.unique(x[at], return_inverse=True)
                n = size[met]
                rows = flat[np.arange(n.sum()) + np.repeat(first[met] - (np.cumsum(n) - n), n)]
                emission = np.add.reduceat(self.w[rows], np.cumsum(n) - n, axis=0)[place.reshape(len(at), LENGTH)]
                e, t, st = np.exp(emission - emission.max(axis=2, keepdims=True)), np.exp(self.transition), np.exp(self.start)
                alpha, beta = np.zeros_like(e), np.ones_like(e)
                cur = _normal((st @ t) * e[:, 0], 1)
                alpha[:, 0] = cur
                for j in range(1, LENGTH):
                    alpha[:, j] = cur = _normal((cur @ t) * e[:, j], 1)
                for j in range(LENGTH - 2, -1, -1):
                    beta[:, j] = _normal((e[:, j + 1] * beta[:, j + 1]) @ t.T, 1)
                p = _normal(alpha * beta, 2)
                pair = alpha[:, :-1, :, None] * t * (e * beta)[:, 1:, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                truth = one[y[at]]
                gap = (p - truth) / len(at)
                by_word = np.zeros((len(met), k))
                np.add.at(by_word, place.reshape(-1), gap.reshape(-1, k))
                # the state before the first word is not seen: what the model takes it to be, less what it takes it to be if the first language is known
                enter = st[:, None] * t
                free = enter[None] * (e[:, 0] * beta[:, 0])[:, None, :]
                free /= free.sum(axis=(1, 2), keepdims=True)
                told = (enter / enter.sum(axis=0))[:, y[at][:, 0]].T
                gs = (free.sum(axis=2) - told).sum(axis=0) / len(at)
                true_pair = np.einsum("bji,bjk->ik", truth[:, :-1], truth[:, 1:]) + told.T @ truth[:, 0]
                gt = (pair.sum(axis=(0, 1)) + free.sum(axis=0) - true_pair) / len(at) / 10
                touched, back = np.unique(rows, return_inverse=True)
                gw = 1e-6 * self.w[touched]
                np.add.at(gw, back, np.repeat(by_word, n, axis=0))
                seen[0][touched] += gw * gw
                self.w[touched] -= rate * gw / np.sqrt(seen[0][touched])
                for q, g, a in ((self.transition, gt, seen[1]), (self.start, gs, seen[2])):
                    a += g * g
                    q -= rate * g / np.sqrt(a)
        return self

    def _learn(self, words: set[str]) -> None:
        """Sum up the weights of words that are not remembered; a word without a letter has row -1."""
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, []
        new = [w for w in words if w not in self.known]
        bare = [letters(w) for w in new]
        with_letters = [i for i, b in enumerate(bare) if b]
        base = sum(map(len, self.rows))
        for i, b in enumerate(bare):
            if not b:
                self.known[new[i]] = -1
        if with_letters:
            flat, first = self._features([bare[i] for i in with_letters])
            self.rows.append(np.add.reduceat(self.w[flat], first, axis=0).astype(np.float32))
            self.known.update(zip((new[i] for i in with_letters), range(base, base + len(with_letters)), strict=True))

    def label(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words that have a letter, in a row, and how many each document has."""
        words: set[str] = set()
        for d in docs:
            words.update(d)
        self._learn(words)
        ids = np.fromiter((i for d in docs for i in map(self.known.__getitem__, d)), np.int64, sum(map(len, docs)))
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[ids >= 0]
        n = np.bincount(owner, minlength=len(docs))
        if not len(owner):
            return np.zeros((0, len(self.langs))), n
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        some = n > 0
        return marginals(self.rows[0][ids[ids >= 0]].astype(np.float64), n[some], self.transition, self.start), n

    def predict(self, docs: list[list[str]]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(docs), [0.0] * len(docs)
        if not self.langs:
            return lang, score
        p, n = self.label(docs)
        some = np.flatnonzero(n > 0)
        if len(some):
            first = np.cumsum(n[some]) - n[some]
            mean = np.add.reduceat(p, first, axis=0) / n[some][:, None]
            best = mean.argmax(axis=1)
            for i, b, s in zip(some.tolist(), best.tolist(), mean.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = self.langs[b], min(max(s, 0.0), 1.0)
        return lang, score


def train(docs: DataFrame, most: int = SAMPLE, sequences: int = SEQUENCES, most_bytes: int = SAMPLE_BYTES) -> LanguageField:
    """Learn on a bounded sample of documents of the training folds that have a language, the same ones each time; each language has
    at most an equal part of `most`, and `most_bytes` of texts. The languages themselves are all that occur in those folds.

    One scan counts the languages; a second takes of each the ids whose hashes are low enough for about that many, so what is sorted is few rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(~held_out("doc_id", FOLDS)).select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(n)
    field = LanguageField(langs)
    if not langs:
        return field
    each = max(1, most // len(langs))
    top = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(top, int(top * (1.5 * each + 20) / n[lang]) + 1))]), F.col("lang"))
    few = rows.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) % top < share)
    got = bounded(few, "lang", each, most_bytes).toArrow()
    table = sorted(zip(got["doc_id"].to_pylist(), got["lang"].to_pylist(), got["text"].to_pylist(), strict=True))
    number = {x: i for i, x in enumerate(langs)}
    return field.fit([([b for w in tokens(t) if (b := letters(w))], number[y]) for _, y, t in table], sequences)


def identify(docs: DataFrame, most: int = SAMPLE, sequences: int = SEQUENCES) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of `docs`.

    A text that is null or has no letter is `und` with score 0, as is every text if no row has a language to learn
    from. A null doc_id counts as held out; repeated ids keep their own rows. Of the documents only doc_id, text and, for
    learning, lang are read."""
    known = docs.sparkSession.sparkContext.broadcast(train(docs, most, sequences))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in chunks(batches, most=4 << 20):
            lang, score = known.value.predict([tokens(t or "") for t in batch.column("text").to_pylist()])
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), held_out_of(batch.column("doc_id").to_pylist(), FOLDS), lang, score)
        known.value.known, known.value.rows = {}, []  # the worker lives on

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, field: LanguageField) -> DataFrame:
    """Rows (doc_id, place, word, lang, score) of all words that have a letter, lower-cased, of each text in order, with the language that `field` (see `train`)
    finds likeliest for each. A null text has none; other columns are not read."""
    known = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            cut = [[w for w in tokens(t or "") if letters(w)] for t in batch.column("text").to_pylist()]
            p, n = known.value.label(cut)
            if not len(p) or not known.value.langs:
                continue
            ids = [i for i, k in zip(batch.column("doc_id").to_pylist(), n.tolist(), strict=True) for _ in range(k)]
            yield record_batch(schema, ids, [j for k in n.tolist() for j in range(k)], [w for d in cut for w in d], [known.value.langs[i] for i in p.argmax(axis=1).tolist()], p.max(axis=1).tolist())
        known.value.known, known.value.rows = {}, []

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, word string, lang string, score double")
