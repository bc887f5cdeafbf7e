"""String metrics. Edit distance, q-grams, Hamming and Hausdorff are columns of built-in functions; the Jaro family and
optimal string alignment, which Spark lacks, are Arrow-batched UDFs on distinct pairs of a batch."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .normalize import text

#: Returned for an edit distance over the threshold where a caller wants a number.
FAR = 100


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edit_distance(a, b) -> Column:
    return F.levenshtein(text(a), text(b)).cast("long")


def edit_within(a, b, t: int) -> Column:
    """Edit distance up to t, else -1; lengths that differ by more are not compared."""
    return F.levenshtein(text(a), text(b), t).cast("long")


def edit_or_far(a, b, t: int, far: int = FAR) -> Column:
    d = edit_within(a, b, t)
    return F.when(d < 0, far).otherwise(d)


def signature(*cols: str | Column) -> Column:
    """The characters of the attributes as bits of one number, 64 / n of them for each of n attributes; a character counts as its code modulo that."""
    width = 64 // len(cols)
    bit = lambda s, i, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(s.substr(i, F.lit(1))), F.lit(width)) + F.lit(k * width))
    held = lambda s, k: F.when(F.length(s) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(bit(s, i, k))))
    out = F.lit(0).cast("long")
    for k, c in enumerate(cols):
        out = out.bitwiseOR(held(text(c), k))
    return F.coalesce(out, F.lit(0).cast("long"))  # never null, so no filter for that takes it a second time


def near_signatures(a, b, t: int) -> Column:
    """False only if the edit distances of the signed attributes add up to more than t: an edit takes at most one character away from each side, so
    it changes at most one bit that one side has alone."""
    a, b = _col(a), _col(b)
    return (F.bit_count(a.bitwiseAND(F.bitwise_not(b))) <= t) & (F.bit_count(b.bitwiseAND(F.bitwise_not(a))) <= t)


def weighted_edit(pairs: list[tuple[str, str, float]], total: float) -> Column:
    """Weighted sum of edit distances, null once it is over `total`; an attribute that is empty on one side is skipped."""
    left, parts = F.lit(float(total)), F.lit(0.0)
    for a, b, w in pairs:
        d = F.when((text(a) == "") | (text(b) == ""), 0.0).otherwise(F.lit(float(w)) * edit_distance(a, b))
        parts = parts + d
    return F.when(parts <= left, parts)


def reversal(a1, a2, b1, b2) -> Column:
    """The smaller of straight and swapped distance of two attributes."""
    return F.least(edit_distance(a1, b1) + edit_distance(a2, b2), edit_distance(a1, b2) + edit_distance(a2, b1))


def truncation(a, b, n: int | None = None) -> Column:
    """Edit distance of the first n characters; without n, of as many as the shorter has."""
    a, b = text(a), text(b)
    if n is not None:
        return edit_distance(F.substring(a, 1, n), F.substring(b, 1, n))
    size = F.least(F.length(a), F.length(b))
    return edit_distance(a.substr(F.lit(1), size), b.substr(F.lit(1), size))


def kmers(c, k: int | Column) -> Column:
    """All windows of k characters; the whole string if it is no longer than k."""
    s = text(c)
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.length(s) <= k, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: s.substr(i, k)))


def hamming(a, b) -> Column:
    """Positions at which two strings differ, over those that both have."""
    a, b = text(a), text(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))))).cast("long")


def _near_lengths(a, b, x: Column) -> Column:
    return F.when(F.abs(F.length(text(a)) - F.length(text(b))) > 1, F.lit(0.0)).otherwise(x)


def qgram_dice(a, b) -> Column:
    """Dice coefficient over sets of k-mers, k about a third of the shorter string; 0 if the lengths differ by more than 1."""
    short = F.least(F.length(text(a)), F.length(text(b)))
    k = F.greatest(F.floor(short * 0.35).cast("int"), F.lit(1))
    x, y = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    return _near_lengths(a, b, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def qgram_jaccard(a, b, k: int = 3) -> Column:
    x, y = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    both = F.size(F.array_intersect(x, y))
    return _near_lengths(a, b, both / (F.size(x) + F.size(y) - both).cast("double"))


def qgram_positional(a, b, k: int = 3) -> Column:
    """Share of k-mers of a that stand in b at most one place away, as a Jaccard coefficient of counts."""
    x, y = kmers(a, k), kmers(b, k)
    hit = F.size(F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_contains(F.slice(y, F.greatest(i - 1, F.lit(1)), i + 1 - F.greatest(i - 1, F.lit(1)) + 1), F.element_at(x, i))))
    return _near_lengths(a, b, hit / (F.size(x) + F.size(y) - hit).cast("double"))


def char_jaccard(a, b) -> Column:
    """Equal characters at equal places over all places."""
    a, b = text(a), text(b)
    n = F.least(F.length(a), F.length(b))
    same = (n - hamming(a, b)).cast("double")
    return F.when((F.length(a) + F.length(b)) == 0, F.lit(1.0)).otherwise(same / (F.length(a) + F.length(b) - same))


def _kmer_pair(x: Column, y: Column, k: int) -> Column:
    n = F.least(F.length(x), F.length(y))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: (i <= n) & (x.substr(i, F.lit(1)) == y.substr(i, F.lit(1))))).cast("double")
    total = F.length(x) + F.length(y) - same
    return F.when(total == 0, F.lit(1.0)).otherwise(same / total)


def hausdorff(a, b, k: int = 3) -> Column:
    """Directed Hausdorff similarity: the worst k-mer of a at its best match in b."""
    x, y = kmers(a, k), kmers(b, k)
    return F.array_min(F.transform(x, lambda p: F.array_max(F.transform(y, lambda q: _kmer_pair(p, q, k)))))


def hausdorff_positional(a, b, k: int = 3) -> Column:
    """The worst of the k-mers at equal places."""
    x, y = kmers(a, k), kmers(b, k)
    n = F.least(F.size(x), F.size(y))
    return F.array_min(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: _kmer_pair(p, q, k)))


def hausdorff_fast(a, b, k: int = 3) -> Column:
    """The worse of the first and the last k-mer."""
    x, y = kmers(a, k), kmers(b, k)
    return F.least(_kmer_pair(F.element_at(x, 1), F.element_at(y, 1), k), _kmer_pair(F.element_at(x, -1), F.element_at(y, -1), k))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum of similarities over their number."""
    return sum((F.lit(float(w)) * c for c, w in parts), F.lit(0.0)) / len(parts)


def jaro_value(s: str, t: str, whole: bool = True) -> float:
    """Jaro similarity. Matches are looked for from the left within half the longer length; `whole`: half of the
    transpositions is rounded down."""
    if s == t:
        return 1.0
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    first = []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                first.append(ch)
                break
    k = len(first)
    if not k:
        return 0.0
    second = [ch for ch, u in zip(t, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(first, second, strict=True))
    half = moved // 2 if whole else moved / 2
    return (k / n + k / m + (k - half) / k) / 3


def winkler_value(s: str, t: str) -> float:
    """Jaro with a boost for up to 4 common first characters; 0.2 if the lengths differ by more than 1."""
    if abs(len(s) - len(t)) > 1:
        return 0.2
    j = jaro_value(s, t)
    p = 0
    for x, y in zip(s[:4], t[:4], strict=False):
        if x != y:
            break
        p += 1
    return j + 0.1 * p * (1 - j)


def osa_value(s: str, t: str) -> int:
    """Edit distance of two strings in which two neighbours may change places, each part of the string being edited once."""
    if s == t:
        return 0
    before, row = [], list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b))
            if i > 1 and j > 1 and a == t[j - 2] and s[i - 2] == b:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


#: Pairs times letters, and pairs times characters, that are compared in one step.
CELLS = 1 << 17


class JaroTable:
    """Strings as codes, compared pair by pair for many pairs at once.

    Up to 64 characters, the places of each letter of a string are the bits of a number, and a step looks at one character of all
    pairs. For longer ones the places of each letter stand in a row; a step looks at one place of all pairs and letters, so a pair takes
    as many steps as its commonest letter has places, and the work is linear in the lengths."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        self.short = self.length <= 64
        flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
        letters, code = np.unique(flat, return_inverse=True)
        self.letters = len(letters)
        width = max(int(self.length.max(initial=0)), 1)
        row = np.repeat(np.arange(len(strings)), self.length)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes = np.zeros((len(strings), width), dtype=np.uint16 if self.letters < 1 << 16 else np.int32)
        self.codes[row, at] = code + 1
        some = self.short[row]
        self.places = np.zeros((len(strings), self.letters + 1), dtype=np.uint64) if self.short.any() else None
        if self.places is not None:
            np.bitwise_or.at(self.places.reshape(-1), row[some] * (self.letters + 1) + code[some] + 1, np.uint64(1) << at[some].astype(np.uint64))
            self.flat = self.places.reshape(-1)
        if not self.short.all():
            order = np.argsort(row * np.int64(self.letters) + code, kind="stable")
            self.at = at[order].astype(np.int32)
            count = np.bincount(row * np.int64(self.letters) + code, minlength=len(strings) * self.letters)
            self.stop = np.cumsum(count).reshape(len(strings), self.letters)
            self.count = count.reshape(len(strings), self.letters)

    def compare(self, a: np.ndarray, b: np.ndarray, whole: bool = True, least: float = 0.0) -> np.ndarray:
        """Jaro similarity of the strings numbered a and b, pair by pair. Pairs that cannot reach `least`, by their lengths or by the letters that
        both have, may get 0 instead."""
        out = np.zeros(len(a))
        both = self.short[a] & self.short[b]
        for wanted, step, size in ((both, self._compare, 1 << 15), (~both, self._long, max(1, CELLS // max(self.letters, self.codes.shape[1])))):
            at = np.flatnonzero(wanted)
            if least > 0 and len(at):
                at = at[self._bound(a[at], b[at]) >= least - 1e-12]
            for start in range(0, len(at), size):
                part = at[start : start + size]
                out[part] = step(a[part], b[part], whole)
        return out

    def _bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No similarity is above this: as many matches as the shorter string has characters, all in order."""
        n, m = self.length[a], self.length[b]
        k = np.minimum(n, m)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, (k / n + k / m + 1) / 3, np.where(n == m, 1.0, 0.0))

    def _long(self, a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
        n, m = self.length[a], self.length[b]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0).astype(np.int32)
        ca, cb = self.count[a], self.count[b]
        pair, letter = np.nonzero((ca > 0) & (cb > 0))
        je, ie = self.stop[b[pair], letter], self.stop[a[pair], letter]
        i, j = ie - ca[pair, letter], je - cb[pair, letter]
        # how many places are left rather than where they end; all fits 32 bits, as a step holds CELLS
        ie, je = (ie - i).astype(np.int32), (je - j).astype(np.int32)
        width = self.codes.shape[1]
        mine, used = np.zeros((len(a), width), dtype=bool), np.zeros((len(a), width), dtype=bool)
        fm, fu = mine.reshape(-1), used.reshape(-1)
        base, r = (pair * width).astype(np.int32), reach[pair]
        order = np.argsort(-np.minimum(ie, je), kind="stable")  # those of the fewest steps stand last
        i, j, ie, je, base, r = (v[order] for v in (i, j, ie, je, base, r))
        # places of one letter in both strings, from the left: one that is too far left for the other is passed by
        while len(i):
            x, y = self.at[i], self.at[j]
            d = y - x
            left, right = d >= -r, d <= r
            met = np.flatnonzero(left & right)
            at = base[met]
            fm[at + x[met]] = True
            fu[at + y[met]] = True
            i += left
            j += right
            ie -= left
            je -= right
            live = np.flatnonzero(np.minimum(ie, je) > 0)
            if len(live) < len(i):
                i, j, ie, je, base, r = (v.take(live) for v in (i, j, ie, je, base, r))
        k = np.count_nonzero(mine, axis=1)
        row, at = np.nonzero(mine)
        row2, at2 = np.nonzero(used)
        moved = np.bincount(row, weights=self.codes[a[row], at] != self.codes[b[row2], at2], minlength=len(a)).astype(np.int64)
        return self._value(a, b, n, m, k, moved, whole)

    @staticmethod
    def _value(a, b, n, m, k, moved, whole: bool) -> np.ndarray:
        half = moved // 2 if whole else moved / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            v = (k / n + k / m + (k - half) / k) / 3
        return np.where(a == b, 1.0, np.where(k > 0, v, 0.0))

    def _compare(self, a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
        n, m = self.length[a], self.length[b]
        one = np.uint64(1)
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        used, mine = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
        row = b * self.places.shape[1]
        codes = np.ascontiguousarray(self.codes[a, : max(int(n.max(initial=0)), 1)].T)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        # the places within reach of place i: bits up to i + reach, without those below i - reach
        top = reach.astype(np.uint64)
        for i in range(int(n.max(initial=0))):
            hi = np.minimum(top + np.uint64(i + 1), np.uint64(64))
            window = np.where(hi >= 64, full, (one << np.minimum(hi, np.uint64(63))) - one)
            low = np.minimum(np.maximum(i - reach, 0), 63).astype(np.uint64)
            x = self.flat[row + codes[i]] & window & (full << low) & ~used
            x &= ~x + one  # the lowest place
            used |= x
            mine |= np.where(x != 0, one << np.uint64(i), np.uint64(0))
        k = np.bitwise_count(used).astype(np.int64)
        moved = np.zeros(len(a), dtype=np.int64)
        at = np.flatnonzero(k > 0)
        s, t = mine[at], used[at]
        while len(at):
            ls, lt = s & (~s + one), t & (~t + one)
            i, j = np.bitwise_count(ls - one), np.bitwise_count(lt - one)
            moved[at] += self.codes[a[at], i] != self.codes[b[at], j]
            s, t = s ^ ls, t ^ lt
            left = s != 0
            at, s, t = at[left], s[left], t[left]
        return self._value(a, b, n, m, k, moved, whole)

    def winkler(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaro with a boost for up to 4 common first characters; 0.2 if the lengths differ by more than 1."""
        out = np.full(len(a), 0.2)
        near = np.flatnonzero(np.abs(self.length[a] - self.length[b]) <= 1)
        a, b = a[near], b[near]
        j = self.compare(a, b)
        head = self.codes[:, :4]
        same = (head[a] == head[b]) & (head[a] > 0)
        out[near] = j + 0.1 * np.logical_and.accumulate(same, axis=1).sum(axis=1) * (1 - j)
        return out

    def osa(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edit distance in which two neighbours may change places, each part of the string being edited once: a row of the table at a time, for
        many pairs. Within a row the best way from the left is a running minimum."""
        out = np.zeros(len(a), dtype=np.int64)
        order = np.lexsort((self.length[b], self.length[a]))  # pairs of about the same lengths go together
        size = max(1, CELLS // (self.codes.shape[1] + 1))
        for start in range(0, len(order), size):
            part = order[start : start + size]
            out[part] = self._osa(a[part], b[part])
        return out

    def _osa(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.length[a], self.length[b]
        wide = int(m.max(initial=0))
        s, t = self.codes[a], self.codes[b, : max(wide, 1)]
        step = np.arange(wide + 1, dtype=np.int32)
        before, row = None, np.broadcast_to(step, (len(a), wide + 1)).copy()
        out = np.where(n == 0, m, 0)
        for i in range(1, int(n.max(initial=0)) + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            if wide:
                np.minimum(row[:, 1:] + 1, row[:, :-1] + (t != s[:, i - 1 : i]), out=new[:, 1:])
                if i > 1 and wide > 1:
                    swap = (t[:, :-1] == s[:, i - 1 : i]) & (t[:, 1:] == s[:, i - 2 : i - 1])
                    np.minimum(new[:, 2:], np.where(swap, before[:, :-2] + 1, new[:, 2:]), out=new[:, 2:])
                new -= step
                np.minimum.accumulate(new, axis=1, out=new)
                new += step
            done = np.flatnonzero(n == i)
            out[done] = new[done, m[done]]
            before, row = row, new
        return out


def _table(a: pd.Series, b: pd.Series) -> tuple[JaroTable, np.ndarray, np.ndarray]:
    codes, strings = pd.factorize(pd.concat([a, b], ignore_index=True).fillna(""))
    codes = codes.astype(np.int64)
    return JaroTable(list(strings)), codes[: len(a)], codes[len(a) :]


def _jaro_series(a: pd.Series, b: pd.Series, whole: bool, least: float = 0.0) -> pd.Series:
    table, a, b = _table(a, b)
    return pd.Series(table.compare(a, b, whole, least))


@F.pandas_udf(DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _jaro_series(a, b, True)


@F.pandas_udf(DoubleType())
def _jaro_fraction(a: pd.Series, b: pd.Series) -> pd.Series:
    return _jaro_series(a, b, False)


@F.pandas_udf(DoubleType())
def _winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    table, a, b = _table(a, b)
    return pd.Series(table.winkler(a, b))


@F.pandas_udf(LongType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    table, a, b = _table(a, b)
    return pd.Series(table.osa(a, b))


def jaro(a, b, whole: bool = True) -> Column:
    return (_jaro if whole else _jaro_fraction)(_col(a), _col(b))


def jaro_winkler(a, b) -> Column:
    return _winkler(_col(a), _col(b))


#: Strings of a block of `all_pairs_jaro`.
BLOCK = 500


def all_pairs_jaro(df: DataFrame, col: str, least: float, key: str = "id", whole: bool = True, block: int = BLOCK) -> DataFrame:
    """Rows (l, r, jaro) of all pairs with l < r whose similarity is at least `least`, for any number of strings.

    The strings are dealt to blocks by a hash, and every two blocks meet in a cell of their own: a string travels once for each block, and a
    cell holds two blocks, whatever their number. The work is that of all pairs, which this metric cannot avoid; block first where a rule allows it."""
    rows = df.select(F.col(key).cast("long").alias("id"), text(col).alias("s"))
    blocks = max(1, -(-rows.count() // block))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.least(i, mine).alias("x"), F.greatest(i, mine).alias("y")))
    dealt = rows.select("id", "s", mine.alias("mine"), F.explode(cells).alias("cell"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, table = part["id"].to_numpy(), JaroTable(part["s"].tolist())
        one = np.flatnonzero(part["mine"].to_numpy() == part["cell"].iloc[0]["x"])
        two = np.flatnonzero(part["mine"].to_numpy() == part["cell"].iloc[0]["y"])
        same = part["cell"].iloc[0]["x"] == part["cell"].iloc[0]["y"]
        out = []
        for start in range(0, len(one), max(1, (1 << 18) // max(len(two), 1))):
            rows = one[start : start + max(1, (1 << 18) // max(len(two), 1))]
            a, b = np.repeat(rows, len(two)), np.tile(two, len(rows))
            if same:
                a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
            else:
                a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            v = table.compare(a, b, whole, least)
            # equal strings have different numbers here
            hit = v >= least
            out.append(pd.DataFrame({"l": ids[a[hit]], "r": ids[b[hit]], "jaro": v[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"l": [], "r": [], "jaro": []})

    # few bytes and much work: adaptive execution would put all cells into a few tasks, unless their number is given
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 4 * spark.sparkContext.defaultParallelism))
    return dealt.repartition(tasks, "cell").groupBy("cell").applyInPandas(run, "l long, r long, jaro double")


def scaled(similarity: Column, factor: int = 1000) -> Column:
    """A similarity as a whole number of thousandths (or hundredths)."""
    return F.floor(similarity * factor + 1e-9).cast("int")


def osa(a, b) -> Column:
    return _osa(_col(a), _col(b))


def jaro_bound(a, b) -> Column:
    """No Jaro similarity is above this; cheap, so it goes before the UDF."""
    n, m = F.length(text(a)), F.length(text(b))
    k = F.least(n, m).cast("double")
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise((k / n + k / m + 1) / 3)


def jaro_cap(a, b, x, y, k: int, n: int) -> Column:
    """No Jaro similarity of attribute k of n signed ones is above this; x and y are the signatures. A character whose bit the other side lacks has no match."""
    p, q = F.length(text(a)), F.length(text(b))
    mask = F.lit(((1 << 64 // n) - 1 << k * (64 // n)) - (1 << 64 if k == n - 1 else 0))
    alone = lambda u, v: F.bit_count(_col(u).bitwiseAND(F.bitwise_not(_col(v))).bitwiseAND(mask))
    m = F.least(p - alone(x, y), q - alone(y, x)).cast("double")
    return F.when((p == 0) & (q == 0), 1.0).when(m <= 0, 0.0).otherwise((m / p + m / q + 1) / 3)


def jaro_reaches(x, y, p, q, k: int, n: int, least: float) -> Column:
    """Whether `jaro_cap` of attribute k of n signed ones is at least `least`, from the lengths p and q, which are there; true where one is empty."""
    mask = F.lit(((1 << 64 // n) - 1 << k * (64 // n)) - (1 << 64 if k == n - 1 else 0))
    alone = lambda u, v: F.bit_count(_col(u).bitwiseAND(F.bitwise_not(_col(v))).bitwiseAND(mask))
    p, q = _col(p), _col(q)
    return F.least(p - alone(x, y), q - alone(y, x)) * (p + q) >= (3 * least - 1 - 1e-9) * (p * q)


def jaro_at_least(a, b, least: float) -> Column:
    """Jaro similarity where the bounds allow `least`, else 0; below `least` also 0."""

    @F.pandas_udf(DoubleType())
    def bounded(x: pd.Series, y: pd.Series) -> pd.Series:
        return _jaro_series(x, y, True, least)

    j = F.when(jaro_bound(a, b) >= least, bounded(_col(a), _col(b))).otherwise(0.0)
    return F.when(j >= least, j).otherwise(0.0)


#: Metrics by the number that a configuration gives them.
EDIT, REVERSAL, TRUNCATION, QGRAM, HAUSDORFF, WINKLER = 0, 1, 2, 5, 6, 7


def by_number(method: int, a, b, **options) -> Column:
    """The metric with this number, as a column; similarities and distances keep their own direction."""
    if method == EDIT:
        return edit_distance(a, b)
    if method == REVERSAL:
        return reversal(a, options["a2"], b, options["b2"])
    if method == TRUNCATION:
        return truncation(a, b, options.get("n"))
    if method == QGRAM:
        return qgram_jaccard(a, b, options.get("k", 3))
    if method == HAUSDORFF:
        return hausdorff(a, b, options.get("k", 3))
    if method == WINKLER:
        return jaro_winkler(a, b)
    raise ValueError(f"no metric has number {method}")


def register(spark: SparkSession) -> None:
    """Names for SQL: jaro_sim, jaro_fraction_sim, jaro_winkler_sim, osa_distance."""
    for name, f in (("jaro_sim", _jaro), ("jaro_fraction_sim", _jaro_fraction), ("jaro_winkler_sim", _winkler), ("osa_distance", _osa)):
        spark.udf.register(name, f)


# edit distance of many with many ---------------------------------------------------------------------------------------


class Names(NamedTuple):
    """Different strings: their characters' code points, a row for each with -1 behind its end, the different ones of these and each one's place
    among them, the strings' lengths, and for each record the place of its string."""

    chars: np.ndarray
    letters: np.ndarray
    places: np.ndarray
    size: np.ndarray
    of: np.ndarray


def names(values: list[str], of: np.ndarray | None = None) -> Names:
    size = np.array([len(v) for v in values], dtype=np.int64)
    chars = np.full((len(values), max(int(size.max(initial=0)), 1)), -1, dtype=np.int32)
    chars[np.arange(chars.shape[1]) < size[:, None]] = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    if chars.max(initial=0) < 256:
        there = np.bincount(chars.ravel() + 1, minlength=257) > 0
        letters, places = np.flatnonzero(there) - 1, (np.cumsum(there) - 1)[chars + 1]
    else:
        letters, places = np.unique(chars, return_inverse=True)
    return Names(chars, letters, places.reshape(chars.shape), size, np.arange(len(values)) if of is None else of)


def _word(size: int) -> np.dtype:
    """The smallest numbers with a bit for each of so many places; above 64, Python's."""
    return next((np.dtype(t) for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if size <= n), np.dtype(object))


class EditGrid:
    """Edit distances of each of many strings (rows) to each of many (columns), by Hyyrö's bit-parallel form of Myers' method: a bit for each place
    of a column's string, a step for each place of a row's, all rows and columns at once. After step j the bits hold how the distance between
    the first j places of a row's string and the first i places of a column's grows with i. So the distances of all their prefixes can be read."""

    def __init__(self, rows: Names, columns: Names):
        self.rows, self.columns = rows, columns
        most = int(columns.size.max(initial=0))
        self.word = _word(most)
        self.count = np.uint8 if max(most, int(rows.size.max(initial=0))) < 128 else np.int64  # two of them are added
        self.held = np.zeros((len(rows.letters), len(columns.size)), dtype=self.word)
        for i in range(most):  # what stands behind an end is -1 on both sides, and read by nobody
            self.held |= (rows.letters[:, None] == columns.chars[None, :, i]).astype(self.word) << (i if self.word == object else self.word.type(i))

    def _below(self, size: np.ndarray) -> np.ndarray:
        """The first `size` bits of each."""
        if self.word == object:
            return np.array([(1 << n) - 1 for n in size.tolist()], dtype=object)
        return np.array([(1 << i) - 1 for i in range(self.word.itemsize * 8 + 1)], dtype=self.word)[size]

    def _steps(self, last: int):
        """(j, up, down) after step 0 to `last`; the arrays are used again by the next step."""
        shape = (len(self.rows.size), len(self.columns.size))
        one, full = (1, -1) if self.word == object else (self.word.type(1), np.iinfo(self.word).max)
        up, down = np.full(shape, full, dtype=self.word), np.full(shape, 0, dtype=self.word)
        same, x, h = (np.empty(shape, dtype=self.word) for _ in range(3))
        yield 0, up, down
        for j in range(1, last + 1):
            np.take(self.held, self.rows.places[:, j - 1], axis=0, out=same, mode="clip")
            np.bitwise_and(same, up, out=x)
            np.add(x, up, out=x)
            np.bitwise_xor(x, up, out=x)
            np.bitwise_or(x, same, out=x)
            np.bitwise_or(x, down, out=x)  # where the diagonal does not grow
            np.bitwise_or(x, up, out=h)
            np.invert(h, out=h)
            np.bitwise_or(h, down, out=h)
            np.bitwise_and(x, up, out=same)
            np.add(h, h, out=h)  # one place on; numpy shifts bytes many times slower
            np.bitwise_or(h, one, out=h)
            np.add(same, same, out=same)
            np.bitwise_and(h, x, out=down)
            np.bitwise_or(x, h, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, same, out=up)
            yield j, up, down

    def _read(self, j: int, up: np.ndarray, down: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Distances of the first j places of rows to the places of columns that `below` has."""
        grown = np.bitwise_count(up & below).astype(self.count, copy=False) - np.bitwise_count(down & below).astype(self.count, copy=False)
        return grown + self.count(j)

    def _spread(self, grid: np.ndarray) -> np.ndarray:
        """Of different strings to all records."""
        for axis, of in enumerate((self.rows.of, self.columns.of)):
            if len(of) != grid.shape[axis] or (of != np.arange(len(of))).any():
                grid = np.take(grid, of, axis=axis, mode="clip")
        return grid

    def distances(self, head: int | None = None, shorter: bool = False) -> list[np.ndarray]:
        """The distances; with `head`, those of the first `head` places too; with `shorter`, those of as many places as the shorter string has too."""
        size, size2 = self.rows.size, self.columns.size
        whole = np.zeros((len(size), len(size2)), dtype=self.count)
        start, cut = (whole.copy() if head is not None else None), (whole.copy() if shorter else None)
        ends, places = set(size.tolist()), set(size.tolist()) | set(size2.tolist())
        least = np.minimum(size.astype(self.count)[:, None], size2.astype(self.count)[None, :]) if shorter else None
        for j, up, down in self._steps(max(ends, default=0)):
            if j in ends:
                at = size == j
                whole[at] = self._read(j, up[at], down[at], self._below(size2))
            if head is not None and (j == head or (j < head and j in ends)):
                at = size >= j if j == head else size == j
                start[at] = self._read(j, up[at], down[at], self._below(np.minimum(size2, head)))
            if shorter and j in places:
                cut += self._read(j, up, down, self._below(np.minimum(size2, j))) * (least == j)
        return [self._spread(x) for x in (whole, start, cut) if x is not None]


def reversals_truncations(rows: list[Names], columns: list[Names], head: int = 4) -> list[np.ndarray]:
    """`reversal` of first and last names, and `truncation` of last names to `head` places and to the shorter, of all rows with all columns."""
    (first, last), (first2, last2) = rows, columns
    straight, start, shorter = EditGrid(last, last2).distances(head, shorter=True)
    straight = straight + EditGrid(first, first2).distances()[0]
    crossed = EditGrid(first, last2).distances()[0]
    crossed = crossed + (crossed.T if rows is columns else EditGrid(last, first2).distances()[0])
    return [np.minimum(straight, crossed), start, shorter]
