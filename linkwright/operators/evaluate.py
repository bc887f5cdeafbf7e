"""Linkage against known entities. Input: rows (rec, entity, cluster). Nothing is expanded into pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame) -> DataFrame:
    """Rows (cluster, entity, n)."""
    return rows.groupBy("cluster", "entity").agg(F.count("*").alias("n"))


def links(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn links. The counts by cluster and entity, by each alone and of all come from one pass."""
    n = rows.groupingSets([["cluster", "entity"], ["cluster"], ["entity"], []], "cluster", "entity").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long")
    one = n.agg(of(0).alias("tp"), of(1).alias("found"), of(2).alias("true"), of(3).alias("every"))
    return one.select("tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"), (F.col("every") - F.col("found") - F.col("true") + F.col("tp")).alias("tn"))


def scores(rows: DataFrame) -> DataFrame:
    """One row: the links and precision, recall, accuracy, f1, to 6 places; 0 where nothing is divided."""
    r = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return links(rows).select("tp", "fp", "fn", "tn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cluster_types(rows: DataFrame) -> DataFrame:
    """Rows (type, clusters): 1 all of one entity, 2 some of one, 3 all of at least one with others, 4 parts of several."""
    size = rows.groupBy("entity").agg(F.count("*").alias("whole"))
    c = contingency(rows).join(size, "entity")
    per = c.groupBy("cluster").agg(F.count("*").alias("entities"), F.count_if(F.col("n") == F.col("whole")).alias("full"))
    kind = F.when((F.col("entities") == 1) & (F.col("full") == 1), 1).when(F.col("entities") == 1, 2).when(F.col("full") > 0, 3).otherwise(4)
    return per.groupBy(kind.alias("type")).agg(F.count("*").alias("clusters"))


def sizes(rows: DataFrame) -> DataFrame:
    """One row: records, clusters, the mean size of clusters and the mean of the different sizes."""
    n = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("records"), F.count("*").alias("clusters"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg_distinct("n") if hasattr(F, "avg_distinct") else F.sum_distinct("n") / F.count_distinct("n"), 6).alias("mean_distinct_size"))


def large_mixed(rows: DataFrame, over: int) -> DataFrame:
    """Records of clusters of more than `over` records of several entities."""
    wide = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("entity").alias("a"), F.max("entity").alias("b")).where((F.col("n") > over) & (F.col("a") != F.col("b"))).select("cluster")
    return rows.join(wide, "cluster", "left_semi").select("rec", "entity", "cluster")


def homogeneous(rows: DataFrame) -> DataFrame:
    """One row: clusters of a single entity, and all clusters."""
    per = rows.groupBy("cluster").agg((F.min("entity") == F.max("entity")).alias("one"))
    return per.agg(F.count_if("one").alias("homogeneous"), F.count("*").alias("clusters"))
