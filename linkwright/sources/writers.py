"""Sinks of clusters, statistics and logs. Each writes a folder, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_lines(clusters: DataFrame, member: str = "member", cluster: str = "cluster") -> DataFrame:
    """One line for each cluster: its members in order, a comma after each."""
    return clusters.groupBy(cluster).agg(F.sort_array(F.collect_list(F.col(member).cast("string"))).alias("m")).select(F.concat(F.array_join("m", ","), F.lit(",")).alias("value"))


def write_clusters(clusters: DataFrame, path: str, member: str = "member", cluster: str = "cluster", mode: str = "errorifexists") -> None:
    cluster_lines(clusters, member, cluster).write.mode(mode).text(path)


def write_clusters_with(clusters: DataFrame, path: str, member: str, extra: str, mode: str = "errorifexists") -> None:
    """As `write_clusters`, each member as id:attribute."""
    both = clusters.withColumn("_m", F.format_string("%s:%s", F.col(member).cast("string"), F.col(extra).cast("string")))
    write_clusters(both, path, "_m", mode=mode)


def write_components(components: DataFrame, records: DataFrame, path: str, entity: str, rec: str = "rec_idx", mode: str = "errorifexists") -> None:
    """Components twice: by entity id under by_id and by record number under by_index. `components`: (rec, component)."""
    c = components.withColumnRenamed("component", "cluster")
    write_clusters(c, f"{path}/by_index", "rec", mode=mode)
    write_clusters(c.join(records.select(F.col(rec).alias("rec"), F.col(entity).alias("member")), "rec"), f"{path}/by_id", mode=mode)


def cluster_text(clusters: DataFrame, columns: list[str]) -> DataFrame:
    """Verbose form: a line 'cluster n:', a line for each record, fields parted by tabs, and an empty line."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    per = clusters.groupBy("cluster").agg(F.sort_array(F.collect_list(line)).alias("m"))
    return per.select(F.concat(F.lit("cluster "), F.col("cluster").cast("string"), F.lit(":\n"), F.array_join("m", "\n"), F.lit("\n")).alias("value"))


def write_cluster_text(clusters: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    cluster_text(clusters, columns).write.mode(mode).text(path)


def write_statistics(one_row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Names and values, a line each."""
    cols = ", ".join(f"'{c}', cast(`{c}` as string)" for c in one_row.columns)
    one_row.selectExpr(f"stack({len(one_row.columns)}, {cols}) as (name, value)").select(F.concat_ws(": ", "name", F.coalesce("value", F.lit(""))).alias("value")).write.mode(mode).text(path)


def append_log(one_row: DataFrame, path: str) -> None:
    """A row more in a CSV log with a header."""
    one_row.write.mode("append").csv(path, header=True)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=False, quote="")
