"""Clusters inside connected components.

Input is a table of matching pairs within components, rows (component, l, r, w), w being a distance or a similarity; it is
made by joins (`component_pairs`), so no metric runs in Python here. Each component's pairs come to one task, as the
refinements look at them in order; a component is bounded by what single linkage joins, and its pairs that do not match never travel."""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import apart
from .pairs import candidate_pairs

Edges = dict[tuple[int, int], float]


def component_pairs(records: DataFrame, components: DataFrame, cols: list[str], match: Column, weight: Column, rec: str = "rec_idx") -> DataFrame:
    """Rows (component, l, r, w) of all matching pairs of records in the same component. `components`: (node, component)."""
    blocks = components.select(F.col("node").alias("rec"), F.col("component").alias("block"))
    travels = records.join(apart(components.select(F.col("node").alias(rec), F.col("component").alias("_component"))), rec)
    met = candidate_pairs(blocks, travels, [*cols, "_component"], rec, single=True).where(match)
    return met.select(F.col("l__component").alias("component"), "l", "r", weight.cast("double").alias("w"))


def nearest_edges(pairs: DataFrame, k: int, similar: bool = False) -> DataFrame:
    """The rows of (component, l, r, w) that are among the k nearest of one of their records, by distance or, with `similar`, by similarity; ties go by (l, r)."""
    both = pairs.select("component", "l", "r", "w", F.explode(F.array("l", "r")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w") if similar else F.asc("w"), "l", "r"))
    return both.withColumn("place", place).where(F.col("place") <= k).select("component", "l", "r", "w").distinct()


def _edges(rows: Iterable[tuple[int, int, float]]) -> tuple[list[int], Edges]:
    e = {(min(a, b), max(a, b)): w for a, b, w in rows}
    return sorted({x for p in e for x in p}), e


def star(nodes: list[int], edges: Edges, **_) -> list[list[int]]:
    """The lowest free record takes all free records that match it; they need not match each other."""
    free, out = set(nodes), []
    beside: dict[int, list[int]] = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    for n in nodes:
        if n in free:
            got = [n, *sorted(x for x in beside.get(n, []) if x in free and x != n)]
            free.difference_update(got)
            out.append(got)
    return out


def clique(nodes: list[int], edges: Edges, **_) -> list[list[int]]:
    """The lowest free record takes free records in order if they match all that it has taken."""
    free, out = set(nodes), []
    for n in nodes:
        if n in free:
            got = [n]
            for x in nodes:
                if x in free and x != n and all((min(x, y), max(x, y)) in edges for y in got):
                    got.append(x)
            free.difference_update(got)
            out.append(got)
    return out


def _merge(nodes: list[int], queue: list, cross: Callable[[list[int], list[int]], float | None], limit: Callable[[float], bool]) -> list[list[int]]:
    """Join the two clusters at the head of the queue (key, a, b) while `cross` allows it; joined clusters queue again."""
    member = {n: [n] for n in nodes}
    heapq.heapify(queue)
    while queue:
        key, a, b = heapq.heappop(queue)
        if a not in member or b not in member:
            continue
        d = cross(member[a], member[b])
        if d is None or not limit(d):
            continue
        if d > key + 1e-12:
            heapq.heappush(queue, (d, a, b))
            continue
        low, high = min(a, b), max(a, b)
        member[low] = sorted(member[low] + member.pop(high))
        for c in list(member):
            if c != low and (e := cross(member[low], member[c])) is not None and limit(e):
                heapq.heappush(queue, (e, min(low, c), max(low, c)))
    return [member[n] for n in sorted(member)]


def agglomerative(nodes: list[int], edges: Edges, **_) -> list[list[int]]:
    """Join by falling similarity, only where every cross pair matches; the similarity of two clusters is that of their least pair.
    A component of two is one cluster."""
    if len(nodes) < 3:
        return [nodes]

    def cross(x: list[int], y: list[int]) -> float | None:
        got = [edges.get((min(a, b), max(a, b))) for a in x for b in y]
        return None if None in got else -min(got)

    return _merge(nodes, [(-w, a, b) for (a, b), w in edges.items()], cross, lambda d: True)


def complete(nodes: list[int], edges: Edges, limit: float = 5, **_) -> list[list[int]]:
    """Complete linkage: join the nearest clusters while their farthest pair is within the limit; a pair without a distance is farther."""

    def cross(x: list[int], y: list[int]) -> float | None:
        got = [edges.get((min(a, b), max(a, b))) for a in x for b in y]
        return None if None in got else max(got)

    return _merge(nodes, [(w, a, b) for (a, b), w in edges.items()], cross, lambda d: d <= limit)


def _held(source: dict) -> dict[int, frozenset]:
    """The sources of each node, which may be one or, of a group of copies, several."""
    return {n: frozenset(x if isinstance(x, (list, tuple, set, frozenset)) or hasattr(x, "tolist") else [x]) for n, x in source.items()}


def source_consistent(nodes: list[int], edges: Edges, source: dict, limit: float = 5, **_) -> list[list[int]]:
    """Pairs of different sources by rising distance, joined if the two clusters have no source in common."""
    held = _held(source)
    root, have = {n: n for n in nodes}, {n: set(held[n]) for n in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items() if w <= limit and not held[a] & held[b]):
        x, y = find(a), find(b)
        if x != y and not have[x] & have[y]:
            low, high = min(x, y), max(x, y)
            root[high] = low
            have[low] |= have.pop(high)
    out: dict[int, list[int]] = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return [out[k] for k in sorted(out)]


def _complete_runs(nodes: list[int], edges: Edges, source: dict, fits: Callable[[float], bool], worse: Callable, sign: int, nearest: int | None, refill: bool, repeats: int, seed: int, most: bool | None, shuffle: bool) -> list[list[int]]:
    """Complete linkage without two records of one source in a cluster, `repeats` times. `sign` is 1 for distances and -1 for similarities, `worse` the
    value of two clusters from those of their pairs. Of each record the `nearest` pairs are queued (all if None); with `refill` a record
    whose pairs are used up queues its next ones. Ties are broken at random with `shuffle`."""
    held = _held(source)
    near: dict[int, list[tuple[float, int, int]]] = {}
    for (a, b), w in edges.items():
        if fits(w) and not held[a] & held[b]:
            near.setdefault(a, []).append((sign * w, a, b))
            near.setdefault(b, []).append((sign * w, a, b))
    near = {n: sorted(es) for n, es in near.items()}
    width = nearest or max((len(es) for es in near.values()), default=0)

    def cross(x: list[int], y: list[int]) -> float | None:
        if frozenset().union(*(held[a] for a in x)) & frozenset().union(*(held[b] for b in y)):
            return None
        got = [edges.get((min(a, b), max(a, b))) for a in x for b in y]
        return None if None in got or not all(map(fits, got)) else sign * worse(got)

    best = None
    rng = random.Random(seed)
    for _ in range(max(1, repeats)):
        member = [[n] for n in nodes]
        at = 0
        while True:
            start = sorted({e for es in near.values() for e in es[at : at + width]})
            noise = {e: rng.random() * 1e-9 for e in start} if shuffle else dict.fromkeys(start, 0.0)
            of = {x: c[0] for c in member for x in c}
            queue = [(e[0] - noise[e], min(of[e[1]], of[e[2]]), max(of[e[1]], of[e[2]])) for e in start if of[e[1]] != of[e[2]]]
            member = _merge_from(member, queue, cross)
            at += width
            if not refill or not width or at >= max((len(es) for es in near.values()), default=0):
                break
        got = [member[i] for i in sorted(range(len(member)), key=lambda i: member[i][0])]
        if best is None or (most is not None and (len(got) > len(best) if most else len(got) < len(best))):
            best = got
    return best or []


def _merge_from(member: list[list[int]], queue: list, cross: Callable) -> list[list[int]]:
    """`_merge` from clusters that exist already; a cluster goes by its lowest record."""
    cluster = {c[0]: c for c in member}
    by_head = lambda f: lambda x, y: f([r for h in x for r in cluster[h]], [r for h in y for r in cluster[h]])
    return [sorted(r for h in heads for r in cluster[h]) for heads in _merge(sorted(cluster), queue, by_head(cross), lambda d: True)]


def source_complete(nodes: list[int], edges: Edges, source: dict, limit: float = 5, nearest: int | None = 20, repeats: int = 1, seed: int = 0, most: bool = True, refill: bool = False, **_) -> list[list[int]]:
    """Complete linkage by distance without two records of one source in a cluster, over each record's `nearest` pairs.

    Ties are broken at random, `repeats` times; the run with the most clusters (or the fewest) is kept."""
    return _complete_runs(nodes, edges, source, lambda w: w <= limit, max, 1, nearest, refill, repeats, seed, most, repeats > 1)


def random_complete(nodes: list[int], edges: Edges, source: dict, limit: float = 5, seed: int = 0, **_) -> list[list[int]]:
    """As `source_complete` over all pairs, each time taking one of the least at random."""
    return _complete_runs(nodes, edges, source, lambda w: w <= limit, max, 1, None, False, 1, seed, None, True)


def similar_complete(nodes: list[int], edges: Edges, source: dict, least: float = 0, nearest: int | None = None, repeats: int = 1, seed: int = 0, most: bool = True, **_) -> list[list[int]]:
    """Complete linkage by whole-number similarity without two records of one source in a cluster: a pair of the highest value goes first, one of
    equal ones at random; two clusters are as similar as their least similar pair, and every pair has to be above `least`."""
    return _complete_runs(nodes, edges, source, lambda w: w > least, min, -1, nearest, False, repeats, seed, most, True)


def spanning_edge(nodes: list[int], edges: Edges) -> tuple[float, int, int] | None:
    """The last edge (w, l, r) of the minimum spanning tree, edges being taken in this order; its weight is the threshold that single
    linkage needs. None if these edges do not join all."""
    root = {n: n for n in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, last = len(nodes) - 1, None
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            last, left = (w, a, b), left - 1
    return last if not left else None


def bottleneck(nodes: list[int], edges: Edges) -> float | None:
    """The largest edge of the minimum spanning tree. None if it takes more than these edges."""
    last = spanning_edge(nodes, edges)
    return last and last[0]


def by_key(pairs: DataFrame, key: str, f: Callable[[dict[str, list]], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """f of the columns of all rows of each key. Rows of a key stand together in their partition, so a task takes its keys from whole
    Arrow batches, without a frame for each; only the key at the end of a batch is carried on."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            column = {c: rows[c].tolist() for c in rows}
            k = rows[key].to_numpy()
            edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            out = [x for a, b in zip(edge, edge[1:], strict=False) for x in f({c: v[a:b] for c, v in column.items()})]
            return pd.DataFrame(out, columns=names)

        for batch in batches:
            if not len(batch):
                continue
            k = batch[key].to_numpy()
            if held and held[-1][key].iloc[-1] != k[0]:
                yield done(pd.concat(held))
                held = []
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if last:
                yield done(pd.concat([*held, batch.iloc[:last]]))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield done(pd.concat(held))

    return pairs.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def bottleneck_edges(pairs: DataFrame) -> DataFrame:
    """The rows of `pairs`, (entity, l, r, w, ...), that are the last edge of the spanning tree of their entity."""

    def last(rows: dict[str, list]) -> list[tuple]:
        e = spanning_edge(*_edges(zip(rows["l"], rows["r"], rows["w"], strict=True)))
        return [(rows["entity"][0], e[1], e[2])] if e else []

    found = by_key(pairs.select("entity", "l", "r", "w"), "entity", last, ["entity", "l", "r"], "entity long, l long, r long")
    return pairs.join(found, ["entity", "l", "r"])


METHODS = {"star": star, "clique": clique, "agglomerative": agglomerative, "complete": complete, "source_consistent": source_consistent, "source_complete": source_complete, "random_complete": random_complete, "similar_complete": similar_complete}


def refine(pairs: DataFrame, nodes: DataFrame, method: str, sources: DataFrame | None = None, **options) -> DataFrame:
    """Rows (rec, cluster), cluster being the smallest record in it. `pairs`: `component_pairs`; `nodes`: (node, component); `sources`: (rec, source).

    Records without a matching pair are clusters of their own and never leave the JVM."""
    f = METHODS[method]
    if sources is not None:
        s = sources.select("rec", "source")
        pairs = pairs.join(s.select(F.col("rec").alias("l"), F.col("source").alias("sl")), "l").join(s.select(F.col("rec").alias("r"), F.col("source").alias("sr")), "r").select("component", "l", "r", "w", "sl", "sr")

    def clusters(rows: dict[str, list]) -> list[tuple]:
        names, edges = _edges(zip(rows["l"], rows["r"], rows["w"], strict=True))
        more = {}
        if "sl" in rows:
            more["source"] = dict(zip(rows["l"], rows["sl"], strict=True)) | dict(zip(rows["r"], rows["sr"], strict=True))
        return [(x, min(c)) for c in f(names, edges, **more, **options) for x in c]

    got = by_key(pairs, "component", clusters, ["rec", "cluster"], "rec long, cluster long")
    return nodes.select(F.col("node").alias("rec")).join(got, "rec", "left").select("rec", F.coalesce("cluster", "rec").alias("cluster"))


def mst_bottlenecks(pairs: DataFrame) -> DataFrame:
    """Rows (component, records, bottleneck) over pairs (component, l, r, w)."""

    def top(rows: dict[str, list]) -> list[tuple]:
        names, edges = _edges(zip(rows["l"], rows["r"], rows["w"], strict=True))
        return [(rows["component"][0], len(names), bottleneck(names, edges))]

    return by_key(pairs, "component", top, ["component", "records", "bottleneck"], "component long, records long, bottleneck double")


def move_by_votes(records: DataFrame, clusters: DataFrame, priority: list[str], rec: str = "rec_idx") -> DataFrame:
    """Each record goes to the cluster of its component of clusters that agrees most with its priority attributes.

    An attribute is worth more the earlier it stands; a cluster's votes for a value are the records that have it. `clusters`: (rec, component, cluster).
    Ties leave the record where it is, then the smaller cluster. Values and votes meet in joins, no pairs of records are made."""
    rows = clusters.join(apart(records.select(F.col(rec).alias("rec"), *[F.coalesce(c, F.lit("")).alias(c) for c in priority])), "rec")
    votes = None
    for i, c in enumerate(priority):
        weight = (len(priority) - i) * 100
        have = rows.where(F.col(c) != "").groupBy("component", "cluster", c).agg(F.count("*").alias("n"))
        part = rows.where(F.col(c) != "").select("rec", "component", c).join(apart(have), ["component", c]).select("rec", "cluster", (F.col("n") * weight).alias("vote"))
        votes = part if votes is None else votes.unionAll(part)
    best = votes.groupBy("rec", "cluster").agg(F.sum("vote").alias("vote")).join(apart(clusters.select("rec", F.col("cluster").alias("now"))), "rec")
    best = best.groupBy("rec").agg(F.max_by("cluster", F.struct("vote", (F.col("cluster") == F.col("now")).alias("stay"), (-F.col("cluster")).alias("low"))).alias("to"))
    moved = clusters.join(apart(best), "rec", "left").select("rec", "component", F.coalesce("to", "cluster").alias("cluster"))
    lacking = rows.where(" AND ".join(f"`{c}` = ''" for c in priority)).select("rec").withColumn("_alone", F.lit(True))
    return moved.join(apart(lacking), "rec", "left").select("rec", "component", F.when(F.col("_alone"), F.col("rec")).otherwise(F.col("cluster")).alias("cluster"))
