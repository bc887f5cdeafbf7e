"""Operator 3: language-model scoring with causal self-attention, trained and run in numpy.

A text is a row of words, `[^\\x20\\x09-\\x0D]+` in lower case, and an end. A word becomes subword ids of a public
vocabulary, a mark standing before an id that goes on with a word where the vocabulary would also let the word
end. A word that its ids do not give back byte by byte (capitals beyond ASCII, say) is spelled in bytes. So
different texts have different sequences, and the probabilities of all sequences add up to 1.

At each place the model first says what comes, if there is a choice: the same word goes on, a new word, or the end. Then it
says which id, first its class and then its place in the class. Both are read from one attention layer that looks back
WINDOW ids at most: windows of WINDOW ids overlap by WINDOW - STEP, and each id is scored once, in the window
where it is among the last STEP. Windows are scored in batches with one mask.

The model learns from every window of every training document. Each task makes one pass of adaptive gradient steps over its
partition from the same weights; the changes of each weight row are averaged by how often the row was met,
in a DataFrame aggregation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import LOWER, chunks, held_out, held_out_of, one_blas_thread, record_batch, texts
from .token_files import WordTable, _coder, split

#: Ids that a window holds, ids that it scores, size of a vector.
WINDOW, STEP, SIZE = 24, 16, 16
#: Words whose counts are sent to the executors at most, and their bytes at most; all others are joined.
TOP_WORDS, TOP_BYTES = 300_000, 64
#: Passes over all training documents, step sizes of weight rows and of matrices, windows of the first and of later steps.
ROUNDS, RATE, DENSE_RATE, FIRST_BATCH, BATCH = 1, 0.1, 0.02, 48, 768
FOLDS, ADD = 10, 0.1
#: Scores are cut off here before they are raised to powers of e.
HIGHEST, TINY = np.float32(60), np.float32(1e-30)
#: Words besides the top ones that a worker remembers, words of a partial count, bytes of sequences held at once.
REMEMBERED, COUNTED, HELD = 300_000, 400_000, 2 << 20
#: What comes at a place: the word goes on within a piece, it goes on after one, a new word, the end.
INSIDE, ON, NEW, END = range(4)


class Speller:
    """Sequences of words: their ids as bytes, with a mark before an id that goes on with a word after a piece that could end it."""

    def __init__(self, path: str):
        self.coder = _coder(path)
        vocab = self.coder.tok.get_vocab()
        self.size = len(self.coder.ends_word)
        self.dtype = self.coder.dtype if self.size < np.iinfo(self.coder.dtype).max else np.dtype("<u4")
        self.mark = int(np.iinfo(self.dtype).max)
        # fixed values of such vocabularies: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        char = {b: c for c, b in of_char.items()}
        self.closes = self.coder.ends_word.copy()
        self.bytes_of: list[bytes | None] = [None] * self.size
        special = {t.content for t in self.coder.tok.get_added_tokens_decoder().values()}
        for token, i in vocab.items():
            if token in special:
                self.closes[i], self.bytes_of[i] = True, token.encode()
                continue
            body = token.removesuffix("</w>")
            if all(c in of_char for c in body):
                self.bytes_of[i] = bytes(of_char[c] for c in body)
        self.byte = [vocab[char[b]] for b in range(256)]
        self.last_byte = [vocab[char[b] + "</w>"] for b in range(256)]

    def spell(self, words: list[bytes]) -> list[bytes]:
        """The sequences of different lower-cased words."""
        ids = self.coder.encode_words(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.coder.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), dtype=self.coder.dtype).astype(self.dtype)
        stop = np.cumsum(n)
        odd = np.zeros(len(words), dtype=bool)
        odd[n == 0] = True
        some = np.flatnonzero(n)
        odd[some[~self.closes[flat[stop[some] - 1]]]] = True
        for i in [i for i, w in enumerate(words) if not w.isascii()]:
            if not odd[i]:
                odd[i] = b"".join([self.bytes_of[k] or b"\xff" for k in flat[stop[i] - n[i] : stop[i]].tolist()]) != words[i]
        # marks go before ids that follow a closing one within a word
        closed = np.r_[False, self.closes[flat[:-1]]] if len(flat) else np.array([], dtype=bool)
        closed[(stop - n)[some]] = False
        at = np.flatnonzero(closed)
        marked = np.insert(flat, at, self.mark)
        more = np.r_[0, np.cumsum(closed)]
        width = self.dtype.itemsize
        data, begin = marked.tobytes(), (stop - n + more[stop - n]) * width
        end = (stop + more[stop]) * width
        out = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            w = words[i]
            out[i] = np.array([*[self.byte[b] for b in w[:-1]], self.last_byte[w[-1]]], dtype=self.dtype).tobytes()
        return out


@lru_cache(maxsize=2)
def _speller(path: str) -> Speller:
    return Speller(path)


def lower(raw: bytes) -> bytes:
    return raw.translate(LOWER)


class Places:
    """The places of some texts one after the other, an end after each: slot, kind, whether the kind was a choice, slot before."""

    def __init__(self, model: AttentionModel, sequences: list[bytes]):
        unit = np.dtype(model.dtype).itemsize
        flat = np.frombuffer(b"".join(sequences), dtype=model.dtype)
        stop = np.cumsum(np.fromiter(map(len, sequences), np.int64, len(sequences)) // unit)
        marks = flat == np.iinfo(model.dtype).max
        keep = ~marks
        on = (np.r_[False, marks[:-1]] if len(flat) else marks)[keep]
        ids = flat[keep]
        stop = np.r_[0, np.cumsum(keep)][stop]
        n = np.diff(np.r_[0, stop])
        self.length = n + 1
        total = int(self.length.sum())
        end = np.cumsum(self.length) - 1
        inside = np.ones(total, dtype=bool)
        inside[end] = False
        at = np.flatnonzero(inside)
        self.slot = np.zeros(total, dtype=np.int32)
        self.slot[at] = model.slot[ids]
        self.before = np.empty(total, dtype=np.int32)
        self.before[1:] = self.slot[:-1]
        first = end - n
        self.before[first] = model.begin
        closed = np.ones(total, dtype=bool)
        closed[at + 1] = model.closes[ids]
        self.kind = np.full(total, END, dtype=np.int8)
        self.kind[at] = np.where(on, ON, NEW)
        self.kind[~closed & inside] = INSIDE
        self.first = np.zeros(total, dtype=bool)
        self.first[first] = True

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each window: its slots, the mask of places before the text, the place of its first scored input and the end of its text."""
        n_win = -(-self.length // STEP)
        owner = np.repeat(np.arange(len(self.length)), n_win)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        base = (np.cumsum(self.length) - self.length)[owner].astype(np.int32)
        stop = base + self.length[owner].astype(np.int32)
        at = base + k.astype(np.int32) * STEP
        place = at[:, None] + np.arange(WINDOW, dtype=np.int32)[None, :] - (WINDOW - STEP)
        outside = (place < base[:, None]) | (place >= stop[:, None])
        x = self.before[np.clip(place, 0, max(len(self.before) - 1, 0), out=place)]
        x[outside] = 0
        return x, outside * np.float32(-1e9), at, stop


class AttentionModel:
    """One layer: a vector for each slot, matrices of queries, keys and values, and the outputs.

    Slots are the ids that occur in training text, by frequency, and one for all others, which share its probability;
    one more vector stands for the begin of a text."""

    #: Rows of slots, and what is not kept by slot.
    rows, dense = ("e", "o"), ("wq", "wk", "wv", "near", "wc", "kinds", "wn")

    def __init__(self, counts: np.ndarray, closes: np.ndarray, dtype: str = "<u2", seed: int = 1):
        """`counts`: how often each id occurs; `closes`: whether a word may end after it."""
        self.dtype, self.closes = np.dtype(dtype).str, closes
        seen = np.flatnonzero(counts > 0)
        seen = seen[np.argsort(-counts[seen], kind="stable")]
        n = len(seen) + 1
        self.slot = np.full(len(counts), n - 1, dtype=np.int32)
        self.slot[seen] = np.arange(n - 1)
        self.begin, self.n = n, n
        self.unseen = max(1, len(counts) - len(seen))
        weight = np.r_[counts[seen], 0.5]
        # common slots are in small classes, rare ones in large ones, so an id costs few steps on average
        sizes = []
        while sum(sizes) < n:
            sizes.append(min(int(8 * 1.3 ** len(sizes)), n - sum(sizes)))
        self.sizes, self.classes = sizes, len(sizes)
        self.off = np.r_[0, np.cumsum(sizes)]
        self.cls = np.repeat(np.arange(self.classes), sizes).astype(np.uint8)
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.5 / np.sqrt(SIZE), s).astype(np.float32)
        # the last column of the outputs is their bias
        self.e, self.o = draw(n + 1, SIZE), draw(n, SIZE + 1)
        self.wq, self.wk, self.wv, self.wc, self.wn, self.kinds = draw(SIZE, SIZE), draw(SIZE, SIZE), draw(SIZE, SIZE), draw(self.classes, SIZE + 1), draw(3, SIZE + 1), draw(3, SIZE)
        self.near = np.zeros(WINDOW, dtype=np.float32)  # by distance
        self.wn[:, SIZE] = 0  # on, new, end
        total = np.add.reduceat(weight, self.off[:-1])
        self.wc[:, SIZE] = np.log(total / total.sum())
        self.o[:, SIZE] = np.log(weight / total[self.cls])
        self.ones = np.ones(max(WINDOW, SIZE, self.classes, *sizes), dtype=np.float32)
        back = WINDOW - STEP + np.arange(STEP)[:, None] - np.arange(WINDOW)[None, :]
        self.back = np.where(back >= 0, back, 0)
        self.mask = np.where(back >= 0, 0, -1e9).astype(np.float32)
        self.sums = None

    def _attend(self, x: np.ndarray, live: np.ndarray):
        """x: windows of slots (n, WINDOW); live: below 0 where a window has no id of its text. Vectors that predict what follows the last STEP,
        and what the way back needs."""
        n = len(x)
        e = self.e[x]
        flat = e.reshape(-1, SIZE)
        own = e[:, WINDOW - STEP :]
        q = (own.reshape(-1, SIZE) @ (self.wq * np.float32(1 / np.sqrt(SIZE)))).reshape(n, STEP, SIZE)
        k = (flat @ self.wk).reshape(n, WINDOW, SIZE)
        v = np.empty((n, WINDOW, SIZE + 1), dtype=np.float32)
        v[:, :, SIZE] = 1  # so that the sum of the weights comes with the sum of the values
        np.matmul(flat, self.wv, out=(value := np.empty_like(flat)))
        v[:, :, :SIZE] = value.reshape(n, WINDOW, SIZE)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.near[self.back] + self.mask
        part = np.flatnonzero(live.min(axis=1) < 0)
        a[part] += live[part, None, :]
        self._powers(a)
        ctx = np.matmul(a, v)
        norm = 1 / (ctx[:, :, SIZE:] + TINY)
        ctx = ctx[:, :, :SIZE] * norm
        return own + ctx, (ctx, a, norm, q, k, v, e)

    @staticmethod
    def _powers(z: np.ndarray) -> None:
        """Powers of e, in place; what float32 could not hold is cut off first."""
        if z.size and z.max() > HIGHEST:
            np.minimum(z, HIGHEST, out=z)
        np.exp(z, out=z)

    def _log_shares(self, h: np.ndarray, w: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets in the softmax over the rows of w."""
        z = h @ w.T
        got = np.minimum(z[np.arange(len(z)), target], HIGHEST)
        self._powers(z)
        return got - np.log(z @ self.ones[: z.shape[1]])

    def _seen(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The vectors from which ids are told, with a last 1 for the bias."""
        out = np.ones((len(h), SIZE + 1), dtype=np.float32)
        np.add(h, np.concatenate([self.kinds, np.zeros((1, SIZE), dtype=np.float32)])[kind], out=out[:, :SIZE])
        return out

    def _next(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of what comes: on, new, end."""
        z = h @ self.wn[:, :SIZE].T + self.wn[:, SIZE]
        z[first, 0] = -2 * HIGHEST  # a text does not go on at its begin
        return z

    def _by_class(self, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and rows (class, from, to) of pieces of it of at most 4096 places."""
        order = np.argsort(c, kind="stable")
        edge = np.r_[0, np.cumsum(np.bincount(c, minlength=self.classes))].tolist()
        return order, [(i, a, min(a + 4096, edge[i + 1])) for i in range(self.classes) for a in range(edge[i], edge[i + 1], 4096)]

    def logs(self, places: Places) -> np.ndarray:
        """Natural log probability of each place given those before it in its text."""
        out = np.zeros(len(places.slot), dtype=np.float32)
        x, live, at, end = places.windows()
        last = len(out) - 1
        for s in range(0, len(x), 768):
            h = self._attend(x[s : s + 768], live[s : s + 768])[0].reshape(-1, SIZE)
            place = (at[s : s + 768, None] + np.arange(STEP)).reshape(-1)
            ok = place < np.repeat(end[s : s + 768], STEP)
            place = np.minimum(place, last)
            kind, target = places.kind[place], places.slot[place]
            z = self._next(h, places.first[place])
            got = np.minimum(z[np.arange(len(z)), kind - 1], HIGHEST)  # inside is the last column here, and left out below
            self._powers(z)
            got -= np.log(z @ self.ones[:3])
            got[kind == INSIDE] = 0
            h = self._seen(h, kind)
            c = self.cls[target]
            word = self._log_shares(h, self.wc, c)
            order, pieces = self._by_class(c)
            h, target = h[order], target[order]
            inner = np.empty(len(h), dtype=np.float32)
            for i, a, b in pieces:
                lo, hi = self.off[i], self.off[i + 1]
                inner[a:b] = self._log_shares(h[a:b], self.o[lo:hi], target[a:b] - lo)
            word[order] += inner
            word[kind == END] = 0
            got += word
            out[place[ok]] = got[ok]
        lost = (places.slot == self.n - 1) & (places.kind != END)
        out[lost] -= np.float32(np.log(self.unseen))
        return out

    def learn(self, places: Places, rng: np.random.Generator) -> None:
        """One pass of adaptive gradient steps over all windows of these places, in a random order."""
        if self.sums is None:
            self.sums = {n: np.full_like(getattr(self, n), 0.1 if n in self.rows else 1e-3) for n in (*self.rows, *self.dense)}
            self.steps, self.met, self.asked = 0, np.zeros(self.n + 1), np.zeros(self.n)
        x, live, at, end = places.windows()
        order = rng.permutation(len(x))
        s = 0
        while s < len(order):
            size = min(BATCH, FIRST_BATCH + 2 * self.steps)
            self._step(places, *(y[order[s : s + size]] for y in (x, live, at, end)))
            s += size
            self.steps += 1

    def _down(self, name: str, g: np.ndarray, at=None) -> None:
        """One adaptive step down the gradient g of a table, or of its rows `at`."""
        w, seen = getattr(self, name), self.sums[name]
        rate = RATE if name in self.rows else DENSE_RATE
        if at is None:
            seen += g * g
            w -= rate * g / np.sqrt(seen)
        else:
            new = seen[at] + g * g
            seen[at] = new
            w[at] -= rate * g / np.sqrt(new)

    def _pull(self, h: np.ndarray, w: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the loss, each place counting as its share: of w and of the vectors h without their last 1."""
        z = h @ w.T
        self._powers(z)
        total = z @ self.ones[: z.shape[1]]
        z[np.arange(len(z)), target] -= total
        scale = (share / total)[:, None]
        return z.T @ (h * scale), (z @ w[:, :SIZE]) * scale

    def _step(self, places: Places, x: np.ndarray, live: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        back, n = WINDOW - STEP, len(x)
        h3, (ctx, a, norm, q, k, v, e) = self._attend(x, live)
        place = (at[:, None] + np.arange(STEP)).reshape(-1)
        ok = place < np.repeat(end, STEP)
        place = np.minimum(place, len(places.slot) - 1)
        kind, target = places.kind[place], places.slot[place]
        mean = np.float32(1 / ok.sum())
        h = h3.reshape(-1, SIZE)
        ones = np.ones(len(h), dtype=np.float32)
        # what comes
        z = self._next(h, places.first[place])
        self._powers(z)
        total = z @ self.ones[:3]
        z[np.arange(len(z)), kind - 1] -= total
        z *= ((ok & (kind != INSIDE)) / total).astype(np.float32)[:, None]
        gh = z @ self.wn[:, :SIZE]
        down = {"wn": np.concatenate([z.T @ h, (ones @ z)[:, None]], axis=1) * mean}
        # which id
        share = (ok & (kind != END)).astype(np.float32)
        hw = self._seen(h, kind)
        c = self.cls[target]
        g, gw = self._pull(hw, self.wc, c, share)
        down["wc"] = g * mean
        order, pieces = self._by_class(c)
        ho, to, so = hw[order], target[order], share[order]
        inner = np.empty((len(h), SIZE), dtype=np.float32)
        for i, s, t in pieces:
            lo, hi = self.off[i], self.off[i + 1]
            g, inner[s:t] = self._pull(ho[s:t], self.o[lo:hi], to[s:t] - lo, so[s:t])
            self._down("o", g, slice(lo, hi))
        gw[order] += inner
        self.asked += np.bincount(target, weights=share, minlength=self.n)
        gh += gw
        down["kinds"] = (np.eye(4, dtype=np.float32)[kind].T @ gw)[:3] * mean
        # back through the attention
        gctx = gh.reshape(n, STEP, SIZE)
        gs = np.matmul(gctx, v[:, :, :SIZE].transpose(0, 2, 1))
        gs -= ((gctx * ctx).reshape(-1, SIZE) @ self.ones[:SIZE]).reshape(n, STEP, 1)
        a *= norm
        gs *= a
        scale = np.float32(1 / np.sqrt(SIZE))
        fq = np.matmul(gs, k).reshape(-1, SIZE) * scale
        fk, fv = np.matmul(gs.transpose(0, 2, 1), q).reshape(-1, SIZE), np.matmul(a.transpose(0, 2, 1), gctx).reshape(-1, SIZE)  # q is scaled already
        flat = e.reshape(-1, SIZE)
        down |= {"wq": np.ascontiguousarray(e[:, back:]).reshape(-1, SIZE).T @ fq * mean, "wk": flat.T @ fk * mean, "wv": flat.T @ fv * mean}
        down["near"] = np.bincount(self.back.reshape(-1), weights=gs.sum(axis=0).reshape(-1) * (self.mask.reshape(-1) == 0), minlength=WINDOW).astype(np.float32) * mean
        ge = (fk @ self.wk.T + fv @ self.wv.T).reshape(n, WINDOW, SIZE)
        ge[:, back:] += gctx + (fq @ self.wq.T).reshape(n, STEP, SIZE)
        slot = x.reshape(-1).copy()
        slot[live.reshape(-1) < 0] = self.n + 1  # places before a text stand last and are left out
        met = np.bincount(slot, minlength=self.n + 2)[: self.n + 1]
        self.met += met
        order = np.argsort(slot.astype(np.uint16) if self.n + 1 < 1 << 16 else slot, kind="stable")[: met.sum()]
        first = (np.cumsum(met) - met)[met > 0]
        self._down("e", np.add.reduceat(ge.reshape(-1, SIZE)[order], first, axis=0), np.flatnonzero(met))
        for name, g in down.items():
            self._down(name, g)

    def copy(self) -> AttentionModel:
        new = object.__new__(AttentionModel)
        new.__dict__ |= self.__dict__
        for n in (*self.rows, *self.dense):
            setattr(new, n, getattr(self, n).copy())
        return new

    def flat(self, old: AttentionModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `learn` changed since `old`: rows (row number, weight, SIZE values), matrices after the rows of slots."""
        rows, weight, value = [], [], []

        def put(first: int, change: np.ndarray, w: np.ndarray) -> None:
            some = np.flatnonzero(w > 0)
            rows.append(first + some)
            weight.append(w[some])
            value.append(change[some])

        put(0, self.e - old.e, self.met)
        put(self.n + 1, self.o[:, :SIZE] - old.o[:, :SIZE], self.asked)
        bias = np.zeros((self.n, SIZE), dtype=np.float32)
        bias[:, 0] = self.o[:, SIZE] - old.o[:, SIZE]
        put(2 * self.n + 1, bias, self.asked)
        rest = np.concatenate([(getattr(self, n) - getattr(old, n)).reshape(-1) for n in self.dense])
        rest = np.r_[rest, np.zeros(-len(rest) % SIZE, dtype=np.float32)].reshape(-1, SIZE)
        put(3 * self.n + 1, rest, np.full(len(rest), float(max(self.asked.sum(), 1))))
        return np.concatenate(rows), np.concatenate(weight), np.concatenate(value)

    def add(self, row: np.ndarray, value: np.ndarray) -> None:
        """Add averaged changes, as `flat` numbers them."""
        parts = np.searchsorted(row, [0, self.n + 1, 2 * self.n + 1, 3 * self.n + 1, 1 << 62])
        a, b, c, d, _ = parts
        self.e[row[a:b]] += value[a:b]
        self.o[row[b:c] - (self.n + 1), :SIZE] += value[b:c]
        self.o[row[c:d] - (2 * self.n + 1), SIZE] += value[c:d, 0]
        rest, at = value[d:].reshape(-1), 0
        for n in self.dense if len(rest) else ():
            w = getattr(self, n)
            w += rest[at : at + w.size].reshape(w.shape)
            at += w.size


class Encoder:
    """What a worker needs to spell texts and to add up the base scores of their words: the top words and their counts, N and V."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, types: int, ends: int, tokenizer: str):
        self.words, self.counts = {w: i for i, w in enumerate(words)}, counts
        self.total, self.types, self.ends, self.tokenizer = total, types, ends, tokenizer
        self.table: WordTable | None = None

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.total + ADD * (self.types + 1)))

    def _open(self) -> None:
        speller = _speller(self.tokenizer)
        self._base = np.r_[self.base(self.counts), 0.0]
        self.table = WordTable(speller.spell, speller.dtype, REMEMBERED)
        self.top = np.array([], dtype=np.int64)

    def close(self) -> None:
        self.table = self.top = None

    def encode(self, raw: list[bytes]) -> tuple[list[int], list[int], list[float], pa.Array, list[bytes]]:
        """For each text: tokens, known top words, their base score and the end's, the other words, and the sequence."""
        if self.table is None:
            self._open()
        words, n_words = split([lower(t) for t in raw])
        idx, fresh, old = self.table.look_up(words)
        common = len(self.words)
        self.top = np.r_[self.top[old], np.fromiter((self.words.get(w, common) for w in fresh), np.int64, len(fresh))]
        n = len(n_words)
        doc = np.repeat(np.arange(n), n_words)
        top = self.top[idx]
        rare = np.flatnonzero(top == common)
        known = np.bincount(doc, minlength=n) - np.bincount(doc[rare], minlength=n) + (self.ends > 0)
        base = np.bincount(doc, weights=self._base[top], minlength=n) + self.base(np.array([self.ends]))[0]
        others = words.take(pa.array(rare)).cast(pa.large_binary()).cast(pa.binary())
        others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[rare], minlength=n))], pa.int32()), others)
        return (n_words + 1).tolist(), known.tolist(), base.tolist(), others, self.table.sequences(idx, n_words)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, c) over all words of all texts; each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "c"])

        for batch in chunks(batches):
            for t in texts(batch):
                total.update(lower(t).split())
            if len(total) >= COUNTED:
                yield out()
                total.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def top_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words above the least count that at most `most` words reach, told from a histogram of the counts, of at most TOP_BYTES bytes each."""
    level = F.floor(F.log2("c") * 16).cast("int")
    found, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # some hundred rows at most
        found += r["n"]
        if found > most:
            break
        least = r["level"]
    if least is None:
        return [], np.array([])
    got = counts.where((level >= least) & (F.octet_length("word") <= TOP_BYTES)).toArrow()
    return got["word"].to_pylist(), np.array(got["c"].to_pylist(), dtype=np.float64)


def _encoded(docs: DataFrame, encoder: Encoder) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(encoder)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("rare", pa.list_(pa.binary())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, most=3 << 20):
            n, known, base, rare, ids = sent.value.encode(texts(batch))
            names = batch.column("doc_id")
            yield record_batch(schema, list(range(row, row + len(n))), names.cast(pa.int64()), held_out_of(names.to_pylist(), FOLDS), n, known, base, rare, ids)
            row += len(n)
        sent.value.close()  # the worker lives on

    return docs.mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<binary>, ids binary")


def id_counts(sequences: DataFrame, speller: Speller) -> np.ndarray:
    """How often each id of the vocabulary occurs; a task sends its sums alone."""
    size, dtype = speller.size, speller.dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for s in batch.column("ids").to_pylist():
                ids = np.frombuffer(s, dtype=dtype)
                total += np.bincount(ids[ids < size], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    got = sequences.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(size)
    freq[got["id"].to_numpy()] = got["n"].to_numpy()
    return freq


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Sequences of the batches, some at a time; one that is longer than HELD comes alone."""
    held, size = [], 0
    for batch in batches:
        for s in batch.column("ids").to_pylist():
            if size + len(s) > HELD and held:
                yield held
                held, size = [], 0
            held.append(s)
            size += len(s)
    if held:
        yield held


def train(sequences: DataFrame, model: AttentionModel, rounds: int = ROUNDS) -> AttentionModel:
    """The model after `rounds` passes over all sequences: every task learns from its partition, changes are averaged."""
    names = [f"v{i}" for i in range(SIZE)]
    for turn in range(rounds):
        sent = sequences.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            mine, rng = sent.value.copy(), np.random.default_rng(turn)
            for held in _held(batches):
                mine.learn(Places(mine, held), rng)
            if mine.sums is None:
                return
            row, weight, value = mine.flat(sent.value)
            for a in range(0, len(row), 20_000):
                part = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(row[part], pa.int32()), pa.array(weight[part].astype(np.float32)), *[pa.array(np.ascontiguousarray(c)) for c in value[part].T]], names=["row", "w", *names])

        changes = sequences.select("ids").mapInArrow(run, "row int, w float, " + ", ".join(f"{n} float" for n in names))
        mean = changes.groupBy("row").agg(*[(F.sum(F.col(n) * F.col("w")) / F.sum("w")).cast("float").alias(n) for n in names]).toArrow().sort_by("row")  # one row for each weight row
        model = model.copy()
        if mean.num_rows:
            model.add(mean["row"].to_numpy(), np.stack([mean[n].to_numpy() for n in names], axis=1))
    return model


def score(docs: DataFrame, tokenizer: str, most_words: int = TOP_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    A null text is empty: its only token is the end. Rows with a null doc_id count as held out; repeated ids keep their own
    rows. Other columns are not read. The counts of at most `most_words` common words are sent to every executor; all other words of
    a text meet their counts in a join, so no table that grows with the corpus is sent and every word counts in full. `score` is the
    log10 probability of the text by the model alone, which learns from all training documents; without any it is uniform over ids."""
    docs = docs.select("doc_id", "text")
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS))
    counts = materialize(word_counts(learn), "word-counts")
    total = counts.agg(F.count("*"), F.sum("c")).first()
    ends = learn.count()
    encoder = Encoder(*top_words(counts, most_words), int(total[1] or 0) + ends, int(total[0]) + (ends > 0), ends, tokenizer)
    encoded = materialize(_encoded(docs, encoder), "sequences")
    speller = Speller(tokenizer)
    known = encoded.where("not held_out")
    model = train(known, AttentionModel(id_counts(known, speller), speller.closes, speller.dtype.str), rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in chunks(batches, "ids", HELD):
            places = Places(sent.value, batch.column("ids").to_pylist())
            first = np.cumsum(places.length) - places.length
            value = np.add.reduceat(sent.value.logs(places).astype(np.float64), first) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("key", "doc_id", "held_out", "n_tokens", "n_known", "base_score")], pa.array(value)], names=[*names, "score"])

    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    found = encoded.select(*names, "ids").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    floor = encoder.total + ADD * (encoder.types + 1)
    rest = encoded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("key").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + ADD) / F.lit(floor))).alias("rest"), F.count("c").alias("more"))
    known_words = (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known")
    return found.join(rest, "key", "left").select("doc_id", "held_out", "n_tokens", known_words, F.lit(encoder.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


#: The columns that SQL can express; the log10 probability of words by their counts is rounded to 4 places.
BASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, fold FROM documents JOIN fold USING (doc_id)),
word AS (SELECT k, fold, unnest(w) AS word FROM t), c AS (SELECT word, count(*) AS c FROM word WHERE fold <> 0 GROUP BY word),
e AS (SELECT count(*) FILTER (fold <> 0) AS ends FROM t), n AS (SELECT (SELECT sum(c) FROM c) + ends AS total, (SELECT count(*) FROM c) + CAST(ends > 0 AS BIGINT) AS types, ends FROM e),
s AS (SELECT k, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (types + 1)))) AS base, count(c) AS known FROM word LEFT JOIN c USING (word), n GROUP BY k)
SELECT doc_id, fold = 0 AS held_out, CAST(len(w) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + CAST(ends > 0 AS BIGINT) AS BIGINT) AS n_known, CAST(total AS BIGINT) AS train_tokens,
  round(coalesce(base, 0) + log10((ends + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (types + 1))), 4) AS base_score FROM t LEFT JOIN s USING (k), n
"""
