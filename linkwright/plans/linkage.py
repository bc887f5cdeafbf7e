"""Whole linkages: exact groups, blocks, pairs, components, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import by_number
from ..operators import blocking, grouping, pairs, predicates, refine
from ..operators.graph import connected_components
from ..runtime import apart, materialize
from ..spec import LinkageSpec

KINDS = {
    "sliding": lambda c, k: blocking.sliding(c, k),
    "circular": lambda c, k: blocking.circular(c, k),
    "super": lambda c, k: blocking.compound(blocking.sliding(c, k), c),
    "super_circular": lambda c, k: blocking.compound(blocking.circular(c, k), c),
    "prefix": lambda c, k: blocking.prefix(c, k),
}


def unique_records(records: DataFrame, spec: LinkageSpec) -> DataFrame:
    """The first record of each exact group, with its columns to compare."""
    return records.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in spec.compare]).agg(F.min(spec.rec).alias(spec.rec))


def edges(records: DataFrame, spec: LinkageSpec, match: Column | None = None) -> DataFrame:
    """Edges (l, r) between unique records: pairs of the blocks that match, and headless ones if asked for."""
    unique = unique_records(records, spec)
    index = blocking.index(unique, KINDS[spec.block_kind](spec.block, spec.k), spec.rec)
    limits = [(spec.compare, spec.total)] if match is None else []
    match = match if match is not None else predicates.sum_within(spec.compare, spec.total, spec.limits or None)
    if spec.headless:
        # the headless keys are blocks like the others, marked so that none is taken for one of them
        again = pairs.headless_index(unique, [spec.block, *[c for c in spec.compare if c != spec.block]], spec.rec)
        index = index.select("rec", F.concat(F.lit("k:"), "block").alias("block")).unionAll(again.select("rec", F.concat(F.lit("h:"), "block").alias("block")))
    return pairs.near_pairs(index, unique, spec.compare, limits, match, spec.rec)


def link(records: DataFrame, spec: LinkageSpec, match: Column | None = None) -> DataFrame:
    """Rows (rec, component) for every record: single linkage over the edges, exact copies joined to their first record."""
    label = connected_components(edges(records, spec, match), "l", "r")
    return grouping.expand(label, grouping.membership(records, spec.compare, spec.rec))


def link_and_refine(records: DataFrame, spec: LinkageSpec, match: Column | None = None, weight: Column | None = None, **options) -> DataFrame:
    """Rows (rec, cluster). Refinement works on all records, with exact copies, inside the components."""
    match = match if match is not None else predicates.sum_within(spec.compare, spec.total, spec.limits or None)
    weight = weight if weight is not None else predicates.total_distance(spec.compare)
    nodes = materialize(link(records, spec, match).select(F.col("rec").alias("node"), "component"), "nodes")
    cols = [*spec.compare, *([spec.source] if spec.source else [])]
    met = refine.component_pairs(records, nodes, cols, match & predicates.other_source(spec.source) if spec.source else match, weight, spec.rec)
    sources = records.select(F.col(spec.rec).alias("rec"), F.col(spec.source).alias("source")) if spec.source else None
    return refine.refine(met, nodes, spec.refinement or "star", sources, **options)


def configured_edges(records: DataFrame, spec: LinkageSpec, names: list[str]) -> DataFrame:
    """Edges of a configured linkage: typed blocks over several fields, a weighted sum of configured metrics, and its threshold."""
    keys = blocking.typed([(names[i], kind, k) for i, kind, k in spec.block_fields])
    met = pairs.candidate_pairs(blocking.index(records, keys, spec.rec), records, names, spec.rec)
    total = F.lit(0.0)
    for c in spec.comparisons:
        a, b = names[c.attributes[0]], names[c.attributes[0]]
        options = {"n": c.truncate}
        if len(c.attributes) > 1:
            options |= {"a2": f"l_{names[c.attributes[1]]}", "b2": f"r_{names[c.attributes[1]]}"}
        value = by_number(c.method, f"l_{a}", f"r_{b}", **options)
        empty = (F.col(f"l_{a}") == "") | (F.col(f"r_{b}") == "")
        total = total + F.when(empty, 0.0).otherwise(F.lit(c.weight) * value)
    return met.where(predicates.configured(total, spec.threshold)).select("l", "r")


def generalised(records: DataFrame, clusters: DataFrame, spec: LinkageSpec, most: int, loose: Column, total: int | None = None) -> DataFrame:
    """A second pass: records of small clusters are compared with each other and with those of large ones under a looser rule.
    Rows (rec, component). `clusters`: (rec, cluster). `total`: what the edit distances add up to at most under that rule, if it bounds them."""
    small = blocking.residual(records, clusters, most, KINDS[spec.block_kind](spec.block, spec.k), True, spec.rec).withColumn("small", F.lit(True))
    large = blocking.residual(records, clusters, most, KINDS[spec.block_kind](spec.block, spec.k), False, spec.rec).withColumn("small", F.lit(False))
    few = small.select(F.col("rec").alias("s")).distinct()
    # which records are of small clusters travels with them, so pairs of two large ones are dropped where they are made
    marked = records.join(apart(few.withColumnRenamed("s", spec.rec).withColumn("_few", F.lit(True))), spec.rec, "left").withColumn("_few", F.coalesce("_few", F.lit(False)))
    limits = [] if total is None else [(spec.compare, total)]
    more = pairs.near_pairs(small.unionAll(large).select("rec", "block"), marked, [*spec.compare, "_few"], limits, (F.col("l__few") | F.col("r__few")) & loose, spec.rec)
    first = clusters.groupBy("cluster").agg(F.min("rec").alias("l"))
    held = clusters.join(apart(first), "cluster").select("l", F.col("rec").alias("r"))
    label = connected_components(held.unionAll(more), "l", "r")
    return label.select(F.col("node").alias("rec"), "component")


def complete_clusters(records: DataFrame, components: DataFrame, spec: LinkageSpec, sources: int, match: Column, weight: Column, method: str = "source_complete", **options) -> DataFrame:
    """Rows (rec, cluster): clusters without two records of one source, in which all records match, inside components (node, component).

    Records that agree with another of their own source in all attributes are clusters of their own. Of the others, exact groups with one record
    of each of the `sources` are final. What is left is refined with an exact group as one unit, which has the sources of all its records."""
    rows = records.join(components.select(F.col("node").alias(spec.rec), "component"), spec.rec)
    key = ["component", *spec.compare]
    rows = rows.select(F.col(spec.rec).alias("rec"), F.col(spec.source).alias("source"), "component", *[F.coalesce(c, F.lit("")).alias(c) for c in spec.compare])
    twice = rows.groupBy(*key, "source").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alone = rows.join(twice, [*key, "source"], "left_semi").select("rec", F.col("rec").alias("cluster"))
    free = rows.join(twice, [*key, "source"], "left_anti")
    units = free.groupBy(*key).agg(F.min("rec").alias(spec.rec), F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("held"))
    left = units.where(F.col("n") < sources)
    nodes = left.select(F.col(spec.rec).alias("node"), "component")
    met = refine.component_pairs(left, nodes, spec.compare, match, weight, spec.rec)
    found = refine.refine(met, nodes, method, left.select(F.col(spec.rec).alias("rec"), F.col("held").alias("source")), **options)
    of = free.join(units.select(*key, F.col(spec.rec).alias("unit")), key).select("rec", "unit")
    member = of.join(found.select(F.col("rec").alias("unit"), "cluster"), "unit", "left").select("rec", F.coalesce("cluster", "unit").alias("cluster"))
    return alone.unionAll(member)
