import math
import re

import numpy as np
from llm_help import SF, make_docs

from linkwright.llm import quality_rules as q

PROSE = ". ".join(" ".join(f"{a}{b}ing" for b in "bcd fgh kel mop rst tuv wex yz".split()) for a in "An Be Co Du El Fo Gi".split()) + "."


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_counts_as_brute_force(spark):
    texts = ["", None, " \n\t ", "a b c a b c", "é ü a|b <x>\nline\nline\n\n\n", "a " * 30, "same\nsame\nsame", "x" * 50_000, PROSE, "a\x0bb\x0cc\r\nd"]
    got = {r.doc_id: r for r in q.judge(make_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_table_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    short = [r for r in docs.collect() if len(r.text or "") < 3000]
    for r in short[:80]:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute(r.text)


def test_fit_separates_classes():
    good = q.pattern([0] * 9 + [2, 2])
    bad = q.pattern([0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0])
    p = q.fit(np.array([good, bad]), np.array([900.0, 100.0]))
    assert p[good] > 0.9 and p[bad] < 0.1
    assert q.fit(np.array([], dtype=np.int64), np.array([])) == {}


def test_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_columns_in_order_and_the_verdict_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = q.judge(docs).collect()
    assert list(rows[0].asDict()) == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    texts_ = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    code = {i: q.pattern(q.votes(t, q.counts(t))) for i, t in texts_.items()}
    codes, n = np.unique(list(code.values()), return_counts=True)
    # expectation-maximisation one document at a time
    p = {i: 0.05 if (q.unpack(np.array([c])) == q.BAD).any() else 0.95 for i, c in code.items()}
    votes = {i: q.unpack(np.array([c]))[0] for i, c in code.items()}
    for _ in range(60):
        chance, prior = {}, {}
        for side in (0, 1):
            w = {i: x if side else 1 - x for i, x in p.items()}
            prior[side] = math.log(sum(w.values()) + 1)
            table = np.full((q.RULES, 3), 0.5)
            for i, v in votes.items():
                table[np.arange(q.RULES), v] += w[i]
            chance[side] = np.log(table / table.sum(axis=1, keepdims=True))
        for i, v in votes.items():
            up, down = (prior[side] + chance[side][np.arange(q.RULES), v].sum() for side in (1, 0))
            p[i] = 1 / (1 + math.exp(min(max(down - up, -500), 500)))
    for r in rows:
        assert abs(r.posterior - p[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and r.posterior >= q.KEEP_FROM)


def test_keep_has_the_columns_of_documents(spark):
    docs = make_docs(spark, [PROSE, "junk", (None, PROSE), (0, PROSE)]).selectExpr("*", "1 AS n_words", "true AS kept", "7 AS _code", "map(1, 2) AS _failed", "'p' AS _posterior")
    kept = q.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "0", "None"]
    assert q.keep(docs.limit(0)).count() == 0 and q.judge(docs.limit(0)).count() == 0
