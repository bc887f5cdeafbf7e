"""The learned operators: exactness against brute force, held-out accuracy, and edge cases."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_help import SF, make_docs

from linkwright.llm import attention_lm as lm
from linkwright.llm import factorisation as fm
from linkwright.llm import language_crf as crf
from linkwright.llm import toxicity as tox

WORDS = public_tokenizers.path("word_bpe_49k.json")
BIG = "/root/testdata/sf0.1"
EDGE = ["", None, " \n ", "123 456 !!", "x" * 20_000, "same words here", "same words here", "ünï çödé", (None, "no id"), (3, "again")]


def toy_model(seed=0):
    """A model of a vocabulary of 12 ids, a third of which may end a word, with weights that are not those of its counts."""
    rng = np.random.default_rng(seed)
    counts, closes = np.r_[rng.integers(1, 50, 9), 0, 0, 0].astype(float), np.arange(12) % 3 == 0
    m = lm.AttentionModel(counts, closes)
    for n in (*m.rows, *m.dense):
        getattr(m, n)[...] += rng.normal(0, 0.5, getattr(m, n).shape)
    return m, rng


def toy_text(m, rng, n):
    """A sequence of n ids with marks where a word goes on after an id that may end it."""
    out, closed = [], False
    for i in rng.integers(0, 12, n).tolist():
        if closed and rng.random() < 0.4:
            out.append(65535)
        out.append(i)
        closed = bool(m.closes[i])
    return np.array(out, dtype="<u2").tobytes()


def brute_logs(m, sequence):
    """Log probability of each place, one by one."""
    ids, on = [], []
    for x in np.frombuffer(sequence, dtype="<u2").tolist():
        if x == 65535:
            on.append(len(ids))
        else:
            ids.append(x)
    x = [m.begin, *[m.slot[i] for i in ids]]
    out = []
    for i in range(len(ids) + 1):
        first = max(0, i // lm.STEP * lm.STEP - (lm.WINDOW - lm.STEP))
        keys = m.e[x[first : i + 1]]
        a = (keys @ m.wk) @ (m.e[x[i]] @ m.wq) / np.sqrt(lm.SIZE) + m.near[i - np.arange(first, i + 1)]
        a = np.exp(a - a.max())
        h = m.e[x[i]] + (a / a.sum()) @ (keys @ m.wv)
        kind = lm.END if i == len(ids) else lm.ON if i in on else lm.NEW if i == 0 or m.closes[ids[i - 1]] else lm.INSIDE
        p = 0.0
        if kind != lm.INSIDE:
            z = m.wn @ np.r_[h, 1]
            if i == 0:
                z = z[1:]
            p += z[kind - 1 - (i == 0)] - np.log(np.exp(z).sum())
        if kind != lm.END:
            g, y = h + m.kinds[kind], m.slot[ids[i]]
            z = m.wc @ np.r_[g, 1]
            c = m.cls[y]
            p += z[c] - np.log(np.exp(z).sum())
            z = m.o[m.off[c] : m.off[c + 1]] @ np.r_[g, 1]
            p += z[y - m.off[c]] - np.log(np.exp(z).sum()) - (np.log(m.unseen) if y == m.n - 1 else 0)
        out.append(p)
    return out


def test_attention_scores_as_one_by_one():
    m, rng = toy_model()
    texts_ = [toy_text(m, rng, n) for n in (0, 1, 4, 15, 16, 17, 24, 25, 60)]
    got = m.logs(lm.Places(m, texts_))
    want = [x for t in texts_ for x in brute_logs(m, t)]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-3


def test_all_that_may_come_next_sums_to_one():
    m, rng = toy_model(3)
    for n in (0, 1, 5, 16, 30):
        text = toy_text(m, rng, n)
        ids = np.frombuffer(text, dtype="<u2")
        closed = not len(ids) or bool(m.closes[ids[-1]])
        unit = lambda *x: np.array(x, dtype="<u2").tobytes()
        nexts = [text + unit(i) for i in range(12)]
        if closed:
            nexts += [text + unit(65535, i) for i in range(12)] * (n > 0)
        at = len(brute_logs(m, text)) - 1
        total = sum(math.exp(m.logs(lm.Places(m, [t]))[at]) for t in nexts)
        if closed:
            total += math.exp(m.logs(lm.Places(m, [text]))[at])
        assert abs(total - 1) < 1e-4


def test_different_words_have_different_sequences():
    sp = lm.Speller(WORDS)
    rng = np.random.default_rng(5)
    some = ["don't", "foo,", ",foo", "É", "é", "e\u0301", "\u00a0", "a\u00a0b", "ab", "<|endoftext|>", "<|endoftext|>x", "ǅ", "İ", "ﬁ", "x" * 300, "日本語", "12.5%", "'s", "l'été", "\u200b"]
    some += ["".join(rng.choice(list("aé'É.,1日 ́"), rng.integers(1, 6))).replace(" ", "") or "z" for _ in range(3000)]
    words = sorted({lm.lower(w.encode()) for w in some})
    got = sp.spell(words)
    assert len(set(got)) == len(words)
    texts_ = {(w, v) for w in words[:60] for v in words[:60]}
    assert len({sp.spell([w])[0] + sp.spell([v])[0] for w, v in texts_}) == len(texts_)  # where one word ends can be told
    for w, s in zip(words, got, strict=True):
        ids = [i for i in np.frombuffer(s, dtype=sp.dtype).tolist() if i != sp.mark]
        assert b"".join(sp.bytes_of[i] for i in ids) == w and sp.closes[ids[-1]]


def test_gradients_as_differences():
    m, rng = toy_model(7)
    places = lm.Places(m, [toy_text(m, rng, n) for n in (3, 20, 40)])
    text_windows = places.windows()
    got = {}
    m._down = lambda name, g, at=None: got.setdefault(name, []).append((g, at))
    m.met, m.asked = np.zeros(m.n + 1), np.zeros(m.n)
    m._step(places, *text_windows)
    n = len(places.slot)
    lost = (places.slot == m.n - 1) & (places.kind != lm.END)
    words = n
    for name, parts in got.items():
        w = getattr(m, name)
        whole = np.zeros(w.shape)
        for g, at in parts:
            whole[slice(None) if at is None else at] += g * (1 if name in m.rows else words)
        for _ in range(4):
            i = tuple(int(rng.integers(0, k)) for k in w.shape)
            old, ends = w[i], []
            for d in (1e-2, -1e-2):
                w[i] = old + d
                ends.append(-float(m.logs(places).astype(float).sum()) - lost.sum() * np.log(m.unseen))
            w[i] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - whole[i]) < 0.02 + 0.03 * abs(whole[i]), name


def brute_base(rows, fold=10):
    count, ends = collections.Counter(), 0
    split = lambda t: (t or "").encode().lower().split()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % fold:
            count.update(split(t))
            ends += 1
    total, types = sum(count.values()) + ends, len(count) + (ends > 0)
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
    return {(i, t): (len(split(t)) + 1, sum(count[w] > 0 for w in split(t)) + (ends > 0), sum(log(count[w]) for w in split(t)) + log(ends)) for i, t in rows}, total


@pytest.mark.parametrize("top", [5, lm.TOP_WORDS])
def test_lm_base_as_brute_force(spark, top):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, total = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    by_id = {i: v for (i, _), v in want.items()}
    rows = lm.score(docs, WORDS, most_words=top, rounds=0).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, known, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0


def test_lm_beats_frequencies_of_ids_on_held_out_documents(spark):
    """`score`, which is normalised over texts, against a unigram of the same places: what comes, and which id, each by its frequency."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id: r.score for r in lm.score(docs, WORDS).collect() if r.held_out}
    sp = lm.Speller(WORDS)
    train, test = [], []
    for r in docs.collect():
        words = lm.lower((r.text or "").encode()).split()
        (test if r.doc_id in held else train).append(b"".join(sp.spell(words)))
    flat = np.frombuffer(b"".join(train), dtype=sp.dtype)
    m = lm.AttentionModel(np.bincount(flat[flat < sp.size], minlength=sp.size).astype(float), sp.closes)
    kinds = np.bincount(lm.Places(m, train).kind, minlength=4)
    share = np.log((kinds + 1) / (kinds[1:].sum() + 3))
    share[lm.INSIDE] = 0
    p = lm.Places(m, test)
    ids = m.wc[m.cls[p.slot], lm.SIZE] + m.o[p.slot, lm.SIZE] - np.where(p.slot == m.n - 1, np.log(m.unseen), 0)
    unigram = float((share[p.kind] + np.where(p.kind == lm.END, 0, ids)).sum() / np.log(10))
    assert sum(held.values()) > 0.85 * unigram


def test_lm_edge_cases(spark):
    docs = make_docs(spark, EDGE).selectExpr("*", "1 AS n_tokens", "'k' AS key")
    rows = lm.score(docs, WORDS).collect()
    assert len(rows) == len(EDGE) and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert lm.score(docs.limit(0), WORDS).count() == 0


def test_machine_pairs_as_brute_force():
    rng = np.random.default_rng(2)
    m = fm.Machine()
    m.w = rng.normal(0, 1, m.w.shape)
    flat, n, s = fm.features([b"a b c a", b"", b"one two"])
    x = np.zeros((3, fm.BUCKETS + fm.STRUCTURE))
    at = 0
    for i, k in enumerate(n):
        for f in flat[at : at + k]:
            assert x[i, f] == 0
            x[i, f] = 1 / math.sqrt(k)
        at += k
        x[i, fm.BUCKETS :] = s[i]
    for i in range(3):
        on = np.flatnonzero(x[i])
        pairs = sum(m.v[a] @ m.v[b] * x[i, a] * x[i, b] for k, a in enumerate(on) for b in on[:k])
        assert abs(m.sums(flat, n, s)[0][i] - (m.bias[0] + m.w @ x[i] + pairs)) < 1e-9


def held_out_rows(spark, result, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", column)
    return result.join(labels, "doc_id").where("held_out").collect()


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = held_out_rows(spark, fm.classify(docs, spark.read.parquet(f"{BIG}/labels.parquet")), "quality")
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = held_out_rows(spark, tox.classify(docs, spark.read.parquet(f"{BIG}/labels.parquet")), "toxic")
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.65 * sum(r.toxic for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("f", [fm.classify, tox.classify])
def test_classifier_edge_cases(spark, f):
    docs = make_docs(spark, EDGE).selectExpr("*", "0 AS score", "1 AS quality", "1 AS toxic")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)] + [(None, 1, 1), (2, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = f(docs, lab).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert f(docs.limit(0), labels).count() == 0


def test_language_edge_cases(spark):
    docs = make_docs(spark, EDGE).selectExpr("*", "1 AS score", "'q' AS lang_pred")
    rows = {r.doc_id: r for r in crf.identify(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2))
    none = crf.identify(docs.withColumn("lang", crf.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(EDGE)
    assert crf.identify(docs.limit(0)).count() == 0


def test_words_of_code_switched_text(spark):
    """Documents of held-out texts in stretches of 12 words of one language after the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = crf.train(docs)
    assert field.lexicon and np.abs(field.start).max() > 0
    held = [r for r in docs.where(~docs.lang.isNull()).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and len(r.text or "") > 400]
    by = {lang: [r.text.split() for r in held if r.lang == lang] for lang in field.langs}
    rng, texts_, want = np.random.default_rng(4), [], []
    for _ in range(40):
        words, langs = [], []
        for lang in rng.permutation([x for x in field.langs if by[x]]).tolist():
            d = by[lang][int(rng.integers(len(by[lang])))]
            a = int(rng.integers(max(1, len(d) - 12)))
            part = [w for w in d[a : a + 12] if crf.letters(w.lower())]
            words += part
            langs += [lang] * len(part)
        texts_.append(" ".join(words))
        want.append(langs)
    got = {(r.doc_id, r.place): r.lang for r in crf.label_words(make_docs(spark, texts_), field).collect()}
    right = [got[(i, j)] == lang for i, langs in enumerate(want) for j, lang in enumerate(langs)]
    assert len(got) == len(right) and sum(right) >= 0.93 * len(right)


def test_distances_as_brute_force():
    """Gains of windows against compressing each with a dictionary of the same bytes, one by one."""
    import zstandard

    toxic = [f"you are a {w} and what a {w} it is to say so {i}".encode() for i in range(60) for w in ("grumbler", "snorkel")]
    ordinary = [f"the day was warm and number {i} went out to see the garden again".encode() for i in range(120)]
    d = tox.fit(toxic, ordinary, 0.5)
    text = b"They say what a Grumbler he is but the day was warm and we went out to see it again, and again"
    words = text.lower().split()
    parts = [b" " + b" ".join(words[i : i + tox.WINDOW]) + b" " for i in range(0, max(1, len(words) - tox.WINDOW + tox.STEP), tox.STEP)]

    def length(part, tail):
        c = zstandard.ZstdCompressor(level=tox.LEVEL, dict_data=zstandard.ZstdCompressionDict(d.parts[0] + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(part))

    assert d.gains(text).tolist() == [length(p, d.parts[2]) - length(p, d.parts[1]) for p in parts]
    assert d.gains(text).max() > 0 and d.score([toxic[0], ordinary[0]])[0] > 0.5 > d.score([toxic[0], ordinary[0]])[1]


def test_marginals_as_brute_force():
    rng = np.random.default_rng(0)
    length = np.array([1, 64, 65, 200, 3, 128])
    e, t, start = rng.normal(0, 2, (length.sum(), 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    got, at = crf.marginals(e, length, t, start), 0
    for n in length:
        x = np.exp(e[at : at + n])
        a, b = [np.exp(start) @ np.exp(t) * x[0]], [np.ones(3)]
        for i in range(1, n):
            v = a[-1] @ np.exp(t) * x[i]
            a.append(v / v.sum())
            w = np.exp(t) @ (x[n - i] * b[-1])
            b.append(w / w.sum())
        p = np.array(a) * np.array(b[::-1])
        assert np.abs(got[at : at + n] - p / p.sum(axis=1, keepdims=True)).max() < 1e-9
        at += n
