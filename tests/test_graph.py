import random

import pytest

from linkwright.operators import pairs, refine
from linkwright.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 60)], [(random.Random(7).randrange(40) + 0 * i, random.Random(i).randrange(200)) for i in range(150)]])
def test_components(spark, edges):
    rows = [*edges, (None, 3), (4, None)]
    df = spark.createDataFrame(rows, "src long, dst long")
    got = connected_components(df).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    flipped = [(b, a) for a, b in edges]
    rng.shuffle(flipped)
    a, b = (sorted(connected_components(spark.createDataFrame(e, "src long, dst long")).collect()) for e in (edges, flipped))
    assert a == b


@pytest.mark.parametrize("part", [3, 1000])
def test_pairs_within_blocks(spark, part):
    rows = [("x", i) for i in range(14)] + [("y", i) for i in range(10, 17)] + [("z", 1)]
    got = pairs.within_blocks(spark.createDataFrame(rows, "block string, rec long"), part).collect()
    want = {(a, b) for k in "xyz" for c, a in rows for d, b in rows if c == d == k and a < b}
    assert sorted((r.l, r.r) for r in got) == sorted(want)


def test_pairs_carry_attributes(spark):
    blocks = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 3)], "block string, rec long")
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "rec_idx long, v string")
    got = pairs.candidate_pairs(blocks, records, ["v"]).collect()
    assert sorted((r.l, r.r, r.l_v, r.r_v or "") for r in got) == [(1, 2, "a", "b"), (1, 3, "a", ""), (2, 3, "b", "")]


@pytest.mark.parametrize("t", [0, 1, 2])
def test_all_pairs_within(spark, t):
    rng = random.Random(t)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(words)), "rec_idx long, v string")

    def lev(s, u):
        row = list(range(len(u) + 1))
        for i, x in enumerate(s, 1):
            new = [i]
            for j, y in enumerate(u, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and lev(a or "", b or "") <= t}
    assert {(r.l, r.r) for r in pairs.all_pairs_within(df, "v", t).collect()} == want


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS rec_idx").repartition(5)
    rows = pairs.number_rows(df, "rec_idx").collect()
    assert [r.row for r in sorted(rows, key=lambda r: r.rec_idx)] == list(range(1000))


def test_number_a_million_rows(spark):
    df = spark.range(1_000_000).selectExpr("(id * 7919) % 1000003 AS rec_idx", "xxhash64(id) AS h").repartition(8, "h").select("rec_idx")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = pairs.number_rows(df, "rec_idx").toPandas().sort_values("rec_idx")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows["row"].tolist() == list(range(1_000_000))


@pytest.mark.parametrize("small", [1, 64])
def test_threshold_coverage_asks_for_connection(spark, small, monkeypatch):
    from linkwright.operators import diagnostics as d

    monkeypatch.setattr(d, "SMALL_ENTITY", small)
    # a chain whose ends are far apart is joined by its short links; entity 3 has one record, entity 4 two that are far apart
    rows = [(1, 1, "aaaa"), (2, 1, "aaab"), (3, 1, "aabb"), (4, 2, "x"), (5, 2, "y"), (6, 3, "solo"), (7, 4, "far"), (8, 4, "away!")]
    r = spark.createDataFrame(rows, "rec_idx long, entity_id long, v string")
    got = d.grid_coverage(d.entity_distances(r, ["v"]), ["v"], [([0], 0), ([1], 1), ([5], 5)], r).orderBy("point").collect()
    assert [(x.pairs, x.entities, x.records, x.entity_share, x.record_share) for x in got] == [(0, 1, 1, 0.25, 0.125), (3, 3, 6, 0.75, 0.75), (5, 4, 8, 1.0, 1.0)]
    assert [x.point for x in d.first_covering(d.grid_coverage(d.entity_distances(r, ["v"]), ["v"], [([0], 0), ([5], 5)], r), 0.999).collect()] == [1]


def test_refinements():
    path = {(1, 2): 1.0, (2, 3): 1.0, (3, 4): 1.0}
    nodes = [1, 2, 3, 4]
    assert refine.star(nodes, path) == [[1, 2], [3, 4]]
    assert refine.clique(nodes, {**path, (1, 3): 1.0}) == [[1, 2, 3], [4]]
    assert refine.complete(nodes, {**path, (1, 3): 2.0}, limit=2) == [[1, 2], [3, 4]]
    assert refine.agglomerative([1, 2], {(1, 2): 0.5}) == [[1, 2]]
    assert refine.agglomerative(nodes, {(1, 2): 0.9, (2, 3): 0.95, (3, 4): 0.5}) == [[1], [2, 3], [4]]
    assert refine.bottleneck(nodes, {(1, 2): 1.0, (2, 3): 5.0, (1, 3): 2.0, (3, 4): 3.0}) == 3.0
    assert refine.bottleneck(nodes, {(1, 2): 1.0}) is None


@pytest.mark.parametrize("seed", range(10))
def test_source_constraints(seed):
    rng = random.Random(seed)
    nodes = list(range(12))
    source = {n: rng.randrange(4) for n in nodes}
    edges = {(a, b): float(rng.randint(0, 8)) for a in nodes for b in nodes if a < b and source[a] != source[b]}
    for got in (refine.source_consistent(nodes, edges, source=source), refine.source_complete(nodes, edges, source=source, repeats=3), refine.source_complete(nodes, edges, source=source, most=False, repeats=3)):
        assert sorted(x for c in got for x in c) == nodes
        assert all(len({source[x] for x in c}) == len(c) for c in got)
    for c in refine.source_complete(nodes, edges, source=source):
        assert all(edges[(a, b)] <= 5 for a in c for b in c if a < b)
