"""Exact duplicates, conflicts and other groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import apart


def exact_groups(df: DataFrame, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """Rows (rep, n) of groups that agree in all columns; rep is the first record. Sizes are aggregated before the shuffle."""
    return df.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in cols]).agg(F.min(rec).alias("rep"), F.count("*").alias("n"))


def representatives(df: DataFrame, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """One record of each exact group, whole."""
    others = [c for c in df.columns if c not in cols]
    least = df.groupBy(*cols).agg(F.min_by(F.struct(*others), rec).alias("_first"))
    return least.select(*cols, "_first.*").select(*df.columns)


def membership(df: DataFrame, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """Rows (rec, rep). Keys are compared as null-safe strings; a hot key is split by the skew join."""
    key = [F.coalesce(c, F.lit("")).alias(c) for c in cols]
    return df.select(F.col(rec).alias("rec"), *key).join(apart(exact_groups(df, cols, rec)), cols).select("rec", "rep")


def expand(labels: DataFrame, members: DataFrame) -> DataFrame:
    """Components of representatives, given to all their records: (rec, component)."""
    return members.join(apart(labels.select(F.col("node").alias("rep"), "component")), "rep", "left").select("rec", F.coalesce("component", "rep").alias("component"))


def conflicts(df: DataFrame, cols: list[str], source: str = "source", rec: str = "rec_idx") -> DataFrame:
    """Records whose attributes and source another record has too."""
    twice = df.groupBy(*cols, source).count().where("count > 1").drop("count")
    return df.join(twice, [*cols, source]).select(rec)


def full_groups(df: DataFrame, cols: list[str], size: int, rec: str = "rec_idx") -> DataFrame:
    """Exact groups with the mark whether they have `size` records, one for each source."""
    return exact_groups(df, cols, rec).select("rep", "n", (F.col("n") == size).alias("is_full"))


def entity_groups(df: DataFrame, entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("n"), F.min(rec).alias("first_rec"), F.max(rec).alias("last_rec"))


def with_count(df: DataFrame, entity: str, n: int) -> DataFrame:
    """Records whose id occurs exactly n times."""
    return df.join(df.groupBy(entity).count().where(F.col("count") == n).select(entity), entity, "left_semi")


def size_histogram(groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows (size, groups): how many groups have each size."""
    return groups.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def adjacent_mismatch(df: DataFrame, cols: list[str], entity: str = "entity_id", rec: str = "rec_idx") -> DataFrame:
    """How often each attribute differs from the record before with the same id."""
    w = Window.partitionBy(entity).orderBy(rec)
    marked = df.select(*[(F.col(c) != F.lag(c).over(w)).cast("long").alias(c) for c in cols], F.lag(rec).over(w).isNotNull().cast("long").alias("pairs"))
    return marked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_changes") for c in cols], F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def kmer_count(df: DataFrame, col: str, k: int = 3) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.greatest(F.length(col) - k + 1, F.lit(0))), F.lit(0)).cast("long").alias("kmers"))


def partners(pairs: DataFrame, once: bool = False) -> DataFrame:
    """Rows (rec, partners): for each record how many smaller ones it is compared with. `once`: each pair is there once, as candidate pairs are; then
    they are counted where they are made and only counts are shuffled."""
    return pairs.groupBy(F.col("r").alias("rec")).agg((F.count("*") if once else F.countDistinct("l")).alias("partners"))


def block_shares(sizes: DataFrame, top: int = 100) -> DataFrame:
    """The blocks with the most comparisons and their part of all, in percent."""
    total = sizes.agg(F.sum("comparisons").alias("_all"))
    return sizes.crossJoin(F.broadcast(total)).select("block", "n", "comparisons", F.round(100.0 * F.col("comparisons") / F.col("_all"), 6).alias("percent")).orderBy(F.desc("comparisons"), "block").limit(top)
