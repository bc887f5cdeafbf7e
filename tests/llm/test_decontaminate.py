import hashlib
import random

import duckdb
import pytest
from llm_help import SF, make_docs

from linkwright.llm import decontaminate as d
from linkwright.llm.queries import OP6_SQL


def brute(raw, items):
    windows = []
    for name, t in items:
        w = d.words_of(t)
        windows.append((name, {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()))
    out = []
    for t in raw:
        w, got = d.words_of(t), set()
        hit = [False] * len(w)
        for name, ws in windows:
            for x in ws:
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        got.add(name)
                        hit[i : i + len(x)] = [True] * len(x)
        out.append((len(w), sum(hit), sorted(got)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_index_as_brute_force(seed):
    rng = random.Random(seed)
    vocab = [b"a", b"bb", b"c", b"d", b"e1"][: rng.randint(1, 5)]
    make = lambda n: b" ".join(rng.choice(vocab + ([b"zz"] if rng.random() < 0.1 else [])) for _ in range(n))
    items = [(str(i), make(rng.choice([0, 1, 3, 8, 9, 12, 20] if seed % 2 else [8, 9, 12, 30]))) for i in range(6)]
    raw = [make(rng.choice([0, 1, 5, 40, 200])) for _ in range(10)]
    raw += [raw[-1], b"x " + items[3][1] + b" y", items[4][1] * 2]
    s = d.Shard(raw, d.Phrases(items))
    for k, (n, hits, names) in enumerate(brute(raw, items)):
        assert (s.n_words[k], int(s.hit[s.start[k] : s.start[k + 1] - 1].sum()), sorted(s.items[k])) == (n, hits, names)


@pytest.mark.parametrize("most", [1, 60, d.BLOCK_BYTES])
def test_blocks_of_items_change_nothing(spark, most):
    items = [("1", "the quick brown fox jumps over the lazy dog today"), ("2", "Short ITEM"), ("10", "the quick brown fox jumps over the lazy dog today"), ("3", None), (None, "one two three")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["And the Quick, brown fox jumps over the lazy dog! short-item", None, "", "short item short", "one two three", "é" * 10]
    got = {r.doc_id: r for r in d.find(make_docs(spark, texts).selectExpr("*", "1 AS n_hit"), bench, most=most).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (12, 11, 3, True)
    assert got[0].items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
    assert (got[1].n_words, got[1].n_items, got[1].items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert (got[3].n_hit, got[3].contaminated) == (2, False) and got[4].n_items == 0


def test_table_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(OP6_SQL).fetchall())
    got = d.find(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_remove(spark):
    bench = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7 h8 i9")], "item_id long, text string")
    texts = ["start A1 b2, c3 d4 e5 f6 g7 h8 i9 end", "clean text", None, "a1 b2 c3 d4 e5 f6 g7 h8 i9"]
    docs = make_docs(spark, texts)
    got = {r.doc_id: r for r in d.remove(docs, bench).collect()}
    assert got[0].text == "start  end" and got[0].n_chars == 10
    assert got[1].text == "clean text" and got[2].text is None and got[3].text == ""
    assert d.remove(docs, bench).columns == docs.columns
    assert d.remove(docs, bench.limit(0)).collect() == docs.collect()
    assert d.remove(docs.limit(0), bench).count() == 0
