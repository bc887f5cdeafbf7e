"""Operator 1: weak supervision. Rules vote or abstain; expectation-maximisation finds how far each
rule can be trusted; a document stays if the posterior probability of good quality is high enough."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..runtime import materialize
from .common import chunks, free_name, record_batch, texts

GOOD, BAD, ABSTAIN = 2, 1, 0
#: A document is kept from this posterior probability of good quality on.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
#: All but ASCII letters and the bytes of other scripts.
_NOT_LETTER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_NOT_SHOUT = bytes(b for b in range(256) if b not in b"!?")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_LONE_MARKS = re.compile(rb"(?:^|(?<=\s))[!-/:-@\[-`{-~]+(?=\s|$)").findall
_CONTINUED = bytes(range(128, 192))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= len(raw) - len(raw.translate(None, _CONTINUED))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words)


def votes(raw: bytes, c: tuple[int, int, int, int, int]) -> list[int]:
    """The vote of each rule; every threshold is a share of the text itself. A rule that looks for a fault
    abstains where it finds none, as the text may have another; the last two look for what good prose has."""
    n, chars, symbols, dup, repeats = c
    if not n:
        return [BAD] + [ABSTAIN] * (RULES - 1)
    letters = len(raw.translate(None, _NOT_LETTER))
    upper = len(raw.translate(None, _NOT_UPPER))
    shout = len(raw.translate(None, _NOT_SHOUT))
    digits = len(raw.translate(None, _NOT_DIGIT))
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    mean = chars / n
    dense = len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    fault = [
        n < 20,
        symbols >= 0.2 * n,
        dup >= 0.3 * (raw.count(b"\n") + 1),
        repeats >= 0.5 * n,
        upper >= 0.5 * letters,
        shout >= 0.3 * n,
        mean < 2.5 or mean > 15,
        digits >= 0.25 * chars,
        len(_LONE_MARKS(raw)) >= 0.15 * n,
    ]
    return [BAD if f else ABSTAIN for f in fault] + [
        GOOD if letters >= 0.82 * dense and upper < 0.2 * letters else ABSTAIN,
        GOOD if 0.02 * n <= stops <= 0.25 * n else ABSTAIN,
    ]


RULES = 11


def pattern(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def unpack(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (RULES - 1 - j) % 3 for j in range(RULES)], axis=1)


def fit(codes: np.ndarray, n: np.ndarray, rounds: int = 60) -> dict[int, float]:
    """Posterior probability of good quality for each vote pattern, by expectation-maximisation over
    how often each pattern occurs.

    For good and for bad documents each rule has its own chances to vote good, vote bad and abstain;
    its accuracy is what these say together, and abstaining may tell something too. The first guess, that
    a document with a vote for bad is bad, fixes which class is which."""
    if not len(codes):
        return {}
    v = unpack(codes)
    vote = np.stack([v == k for k in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)
    p = np.where((v == BAD).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        logs = []
        for w in (n * p, n * (1 - p)):
            chance = np.einsum("i,ijk->jk", w, vote) + 0.5
            logs.append((math.log(w.sum() + 1), np.log(chance / chance.sum(axis=1, keepdims=True))))
        up, down = (c + np.einsum("ijk,jk->i", vote, t) for c, t in logs)
        p = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def _judged(batches: Iterator[pa.RecordBatch]):
    for batch in chunks(batches):
        found = []
        for raw in texts(batch):
            c = counts(raw)
            found.append((*c, pattern(votes(raw, c))))
        yield batch, found


def posteriors(judged: DataFrame, code: str = "code") -> DataFrame:
    """Rows (code, posterior): the vote patterns of all documents, fitted. There are at most 3 ** RULES of them, and their counts are all that
    reaches the driver and all that is sent back."""
    rows = judged.groupBy(F.col(code).alias("code")).count().orderBy("code").collect()
    known = fit(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float))
    return judged.sparkSession.createDataFrame(sorted(known.items()), "code long, posterior double")


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def judge(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior), one for each row of `docs`.
    A null or empty text has no words and fails the base rule. Null and repeated ids keep their own rows; other columns
    are not read. Texts are read once: their counts and vote patterns are written, and meet the fitted posteriors there."""
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", *counted, "code")] + [("base_failed", pa.bool_())])

    def run(batches):
        for batch, found in _judged(batches):
            yield record_batch(schema, batch.column("doc_id").cast(pa.int64()), *[[x[k] for x in found] for k in range(6)], [base_failed(x[0], x[4]) for x in found])

    found = materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*counted, "code")) + ", base_failed boolean"), "judged")
    known = found.join(F.broadcast(posteriors(found)), "code", "left")  # a row for each vote pattern
    return known.select("doc_id", *counted, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_from)).alias("kept"), "posterior")


def keep(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    code, failed = free_name("_code", docs.columns), free_name("_failed", docs.columns)

    def run(batches):
        for batch, found in _judged(batches):
            more = [pa.array([x[5] for x in found], pa.int64()), pa.array([base_failed(x[0], x[4]) for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, code, failed])

    types = StructType([*docs.schema.fields, StructField(code, LongType()), StructField(failed, BooleanType())])
    found = materialize(docs.mapInArrow(run, types), "judged")
    known = F.broadcast(posteriors(found, code).select(F.col("code").alias(free_name("_pattern", docs.columns)), F.col("posterior").alias(free_name("_posterior", docs.columns))))
    pattern_of, posterior = known.columns
    return found.join(known, found[code] == known[pattern_of]).where(~F.col(failed) & (F.col(posterior) >= keep_from)).select(*[found[c] for c in docs.columns])


#: The columns that SQL can express, rule by rule of their definition.
BASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
grams AS (SELECT k, i, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
twice AS (SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
again AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT k, sum(n - 1) AS n FROM (SELECT k, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (k) LEFT JOIN again USING (k)
"""
