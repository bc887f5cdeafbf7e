"""How well blocks and thresholds cover the known entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import jaro
from ..runtime import apart
from .graph import connected_components
from .pairs import within_entity
from .refine import bottleneck_edges


def reduction(blocks: DataFrame, records: int) -> DataFrame:
    """One row: comparisons within blocks, those of all with all, and the part that is saved."""
    c = blocks.groupBy("block").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("comparisons"))
    every = records * (records - 1) // 2
    return c.select("comparisons", F.lit(every).cast("long").alias("all_pairs"), F.round(1 - F.col("comparisons") / F.lit(float(max(every, 1))), 6).alias("reduction_ratio"))


def coverage(edges: DataFrame, records: DataFrame, entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """One row: entities, those whose records the edges (l, r) join within the entity, and their records."""
    own = records.select(F.col(rec).alias("rec"), F.col(entity).alias("entity"))
    inside = edges.join(apart(own.select(F.col("rec").alias("l"), F.col("entity").alias("a"))), "l").join(apart(own.select(F.col("rec").alias("r"), F.col("entity").alias("b"))), "r").where("a = b")
    label = connected_components(inside, "l", "r")
    per = own.join(apart(label), own.rec == label.node, "left").select("entity", "rec", F.coalesce("component", "rec").alias("component")).groupBy("entity").agg(F.count("*").alias("n"), (F.min("component") == F.max("component")).alias("joined"))
    return per.agg(F.count("*").alias("entities"), F.count_if("joined").alias("joined_entities"), F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("joined"), F.col("n"))), F.lit(0)).alias("joined_records"))


def entity_distances(records: DataFrame, cols: list[str], entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """Rows (entity, l, r, d_<col>...): edit distances of all attributes between records of the same entity."""
    p = within_entity(records, entity, rec, cols)
    return p.select(F.col(entity).alias("entity"), "l", "r", *[F.levenshtein(f"l_{c}", f"r_{c}").cast("long").alias(f"d_{c}") for c in cols])


def entity_similarities(records: DataFrame, cols: list[str], entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """Rows (entity, l, r, s_<col>...): Jaro similarities, to 9 places, of all attributes between records of the same entity."""
    p = within_entity(records, entity, rec, cols)
    return p.select(F.col(entity).alias("entity"), "l", "r", *[F.round(jaro(f"l_{c}", f"r_{c}"), 9).alias(f"s_{c}") for c in cols])


def histogram(distances: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (attribute, distance, pairs, up_to): pairs with each distance and with no greater one."""
    long = distances.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', d_{c}" for c in cols) + ") as (attribute, distance)")
    n = long.groupBy("attribute", "distance").agg(F.count("*").alias("pairs"))  # a row for each distance, so the window is small
    w = Window.partitionBy("attribute").orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.withColumn("up_to", F.sum("pairs").over(w))


def maxima(distances: DataFrame, cols: list[str]) -> DataFrame:
    return distances.groupBy("entity").agg(*[F.max(f"d_{c}").alias(f"max_{c}") for c in cols])


#: Entities of more records are looked at by rounds over a table of edges instead of within one row; conditions that fit one number.
SMALL_ENTITY, BITS = 16, 62


def connected_points(pairs: DataFrame, records: DataFrame, tests: list[Column], entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """Rows (point, pairs, entities, entity_share, records, record_share): for each condition the pairs that meet it, the entities whose records
    these pairs join into one component, their records, and the shares of both in all. `pairs`: (entity, l, r) and what the
    conditions read. An entity of one record is joined whatever the condition.

    For all conditions at once, as the bits of a number, a record knows those under which the first of its entity reaches it; each pair
    passes on what it meets, as often as there are records. Entities of more than SMALL_ENTITY records go through `connected_components`
    instead, on nodes (record, condition)."""
    points = len(tests)
    words = [tests[i : i + BITS] for i in range(0, points, BITS)]
    sizes = records.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    bits = F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(w)]) for w in words])
    fits = pairs.select("entity", "l", "r", bits.alias("fit"))
    met_points = lambda c: F.filter(F.array(*[F.when(F.element_at(c, i // BITS + 1).bitwiseAND(F.lit(1 << i % BITS)) != 0, F.lit(i)) for i in range(points)]), lambda x: x.isNotNull())
    small = sizes.where((F.col("n") > 1) & (F.col("n") <= SMALL_ENTITY))
    members = records.select(F.col(entity).alias("entity"), F.col(rec).alias("rec")).join(small, "entity").groupBy("entity").agg(F.sort_array(F.collect_list("rec")).alias("recs"))
    row = members.join(fits.join(small.select("entity"), "entity").groupBy("entity").agg(F.collect_list(F.struct("l", "r", "fit")).alias("edges")), "entity")
    place = lambda c: (F.array_position("recs", c) - 1).cast("int")
    row = row.withColumn("edges", F.transform("edges", lambda e: F.struct(place(e["l"]).alias("i"), place(e["r"]).alias("j"), e["fit"].alias("fit"))))
    row = row.withColumn("edges", F.flatten(F.array_repeat("edges", F.size("recs") - 1)))

    def reached(k):
        start = F.transform("recs", lambda _, i: F.when(i == 0, F.lit(-1)).otherwise(F.lit(0)).cast("long"))

        def step(acc, e):
            passed = lambda at: F.get(acc, at).bitwiseAND(F.element_at(e["fit"], k + 1))
            return F.transform(acc, lambda x, i: F.when(i == e["i"], x.bitwiseOR(passed(e["j"]))).when(i == e["j"], x.bitwiseOR(passed(e["i"]))).otherwise(x))

        return F.aggregate(F.aggregate("edges", start, step), F.lit(-1).cast("long"), lambda a, x: a.bitwiseAND(x))

    whole = row.select("entity", F.size("recs").cast("long").alias("n"), F.array(*[reached(k) for k in range(len(words))]).alias("all")).select("entity", "n", F.explode(met_points("all")).alias("point"))
    large = sizes.where(F.col("n") > SMALL_ENTITY)
    if large.limit(1).count():
        rest = fits.join(large, "entity").select("entity", "n", F.explode(met_points("fit")).alias("point"), "l", "r")
        label = connected_components(rest.select((F.col("l") * points + F.col("point")).alias("a"), (F.col("r") * points + F.col("point")).alias("b")), "a", "b")
        at = records.select(F.col(entity).alias("entity"), F.col(rec).alias("rec")).join(large, "entity")
        met = label.select(F.floor(F.col("node") / points).cast("long").alias("rec"), (F.col("node") % points).cast("int").alias("point"), "component").join(at, "rec")
        met = met.groupBy("entity", "n", "point").agg(F.count("*").alias("m"), F.count_distinct("component").alias("c")).where("m = n AND c = 1")
        whole = whole.unionByName(met.select("entity", "n", "point"))
    one = sizes.where("n = 1").agg(F.count("*").alias("single"))
    every = sizes.agg(F.count("*").alias("all_entities"), F.sum("n").alias("all_records"))
    grid = records.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    met = fits.select(F.explode(met_points("fit")).alias("point")).groupBy("point").agg(F.count("*").alias("pairs"))
    per = whole.groupBy("point").agg(F.count("*").alias("entities"), F.sum("n").alias("records"))
    # tables of one row for each point, or of one row
    out = grid.join(met, "point", "left").join(per, "point", "left").crossJoin(one).crossJoin(every)
    count = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("point", count("pairs").alias("pairs"), (count("entities") + F.col("single")).alias("entities"), (count("records") + F.col("single")).alias("records"), "all_entities", "all_records")
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return out.select("point", "pairs", "entities", share("entities", "all_entities").alias("entity_share"), "records", share("records", "all_records").alias("record_share"))


def grid_coverage(distances: DataFrame, cols: list[str], grid: list[tuple[list[int], int]], records: DataFrame, entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """`connected_points` of a grid of (limits, total): each distance within its limit, their sum within the total. `distances`: `entity_distances`."""
    total = reduce(lambda a, b: a + b, [F.col(f"d_{c}") for c in cols])
    tests = [reduce(lambda a, b: a & b, [F.col(f"d_{c}") <= t for c, t in zip(cols, limits, strict=True)]) & (total <= cap) for limits, cap in grid]
    return connected_points(distances, records, tests, entity, rec)


def similarity_grid(similarities: DataFrame, cols: list[str], grid: list[tuple[list[float], float]], records: DataFrame, entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """`connected_points` of a grid of (least similarities, mean): each s_<col> at least its bound, their mean above the mean."""
    mean = reduce(lambda a, b: a + b, [F.col(f"s_{c}") for c in cols]) / len(cols)
    tests = [reduce(lambda a, b: a & b, [F.col(f"s_{c}") >= t for c, t in zip(cols, least, strict=True)]) & (mean > cap) for least, cap in grid]
    return connected_points(similarities, records, tests, entity, rec)


def first_covering(coverage: DataFrame, share: float) -> DataFrame:
    """The first point of a grid whose entities and records are both covered by more than `share`: where a sweep stops. No row if none is."""
    return coverage.where((F.col("entity_share") > share) & (F.col("record_share") > share)).orderBy("point").limit(1)


def threshold_validity(distances: DataFrame, cols: list[str], limits: list[int], total: int, records: DataFrame, entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """One row (entities, valid, invalid, valid_records): an entity is valid if the edge at which single linkage joins all its records, the last of
    its spanning tree by (sum of distances, l, r), is within the limits and the total. An entity of one record is."""
    last = bottleneck_edges(distances.select("entity", "l", "r", reduce(lambda a, b: a + b, [F.col(f"d_{c}") for c in cols]).cast("double").alias("w"), *[f"d_{c}" for c in cols]))
    within = reduce(lambda a, b: a & b, [F.col(f"d_{c}") <= t for c, t in zip(cols, limits, strict=True)]) & (F.col("w") <= total)
    sizes = records.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    seen = sizes.join(last.select("entity", within.alias("ok")), "entity", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    return seen.agg(F.count("*").alias("entities"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("valid_records"))


def chunk_balance(sizes: DataFrame, chunks: int) -> DataFrame:
    """Rows (chunk, comparisons, least, most, imbalance) of blocks dealt to chunks by the first 60 bits of the md5 of their name; the last three are of all
    chunks, imbalance being the most over the mean. A chunk without a block has no comparisons."""
    chunk = F.conv(F.substring(F.md5(F.col("block").cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % chunks
    dealt = sizes.groupBy(chunk.cast("int").alias("chunk")).agg(F.sum("comparisons").alias("comparisons"))
    every = sizes.sparkSession.range(chunks).select(F.col("id").cast("int").alias("chunk")).join(dealt, "chunk", "left").withColumn("comparisons", F.coalesce("comparisons", F.lit(0)))
    w = Window.partitionBy()  # one row for each chunk
    return every.select("chunk", "comparisons", F.min("comparisons").over(w).alias("least"), F.max("comparisons").over(w).alias("most"), F.round(F.max("comparisons").over(w) / F.greatest(F.avg("comparisons").over(w), F.lit(1e-9)), 6).alias("imbalance"))
