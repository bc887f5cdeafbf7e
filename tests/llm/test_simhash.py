import random
import re

import numpy as np
import pytest
import xxhash
from llm_help import SF, make_docs

from linkwright.llm import simhash as s


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_pairs_have_the_components_of_all_pairs(spark, parts):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({0, *base, *(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(5))})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in s.near_pairs(df, 4, parts).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want = brute_components(fps, fps)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(find(f))
    assert all(len(g) == 1 for g in groups.values()) and len({find(f) for f in fps}) == len(groups)


def test_large_buckets(monkeypatch):
    monkeypatch.setattr(s, "LARGE_BUCKET", 8)
    rng = np.random.default_rng(0)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, 60).astype(np.uint64)), np.uint64(7) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))]))
    pairs = s.link(np.zeros(len(fp), dtype=np.uint64), fp)
    root = {int(f): int(f) for f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs.tolist():
        assert bin(a ^ b).count("1") <= 4
        root[find(a)] = find(b)
    want = brute_components([int(f) for f in fp], [int(f) for f in fp])
    assert len(set(want)) == len({find(int(f)) for f in fp})


def test_documents_and_edge_cases(spark):
    texts = ["one two three four five six seven eight nine ten"] * 2 + ["", None, "  ", "A b", "a B", "x" * 20_000, (None, "lone words here for once"), (3, "a b")]
    docs = make_docs(spark, texts).selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted(((r.doc_id, r.component_id) for r in s.components(docs).collect()), key=str)
    assert (1, 0) in got and (0, 0) in got
    assert {(2, 2), (3, 2), (4, 2)} <= set(got)  # texts without words link
    assert (6, 3) in got and (5, 3) in got and (None, None) in got
    assert s.components(docs.limit(0)).count() == 0


def test_table_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in s.components(docs).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    for i, f, c in zip(ids, fps, brute_components(ids, fps), strict=True):
        assert int(np.int64(got[i].fp).astype(np.uint64)) == f and got[i].component_id == c


def test_one_of_each(spark):
    docs = make_docs(spark, ["a b c d e f"] * 3 + ["other words stand in this one", (None, "a b c d e f"), (9, "q w e r t z"), (9, "q w e r t z")]).withColumn("fp", s.F.lit(1))
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "9", "None"]
    assert s.one_of_each(docs.limit(0)).count() == 0
