"""Streams of records: exact duplicates within a watermark, and linkage against a table of known records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocking
from ..spec import LinkageSpec


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Records for each window of event time and key; late ones are counted until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("records"))


def against_known(stream: DataFrame, known: DataFrame, keys: Column, rule: Column, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """Pairs (l known, r new) that share a block and match: a join of the stream with a static block index, without state."""
    index = known.select(F.col(rec).alias("l"), *[F.col(c).alias(f"l_{c}") for c in cols], F.explode(keys).alias("block"))
    new = stream.select(F.col(rec).alias("r"), *[F.col(c).alias(f"r_{c}") for c in cols], F.explode(keys).alias("block"))
    return new.join(index, "block").where(rule).select("l", "r")


def linking_batches(known_path: str, spec: LinkageSpec, rule: Column, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: it links a batch against the records kept at `known_path`, hands the pairs to `sink`, and keeps the batch, under its
    number, so that a batch that comes again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{known_path}/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        mine = spark.read.parquet(own)
        all_known = spark.read.parquet(known_path).where(F.col("batch") <= number).drop("batch")
        keys = blocking.compound(blocking.circular(spec.block, spec.k), spec.block)
        pairs = against_known(mine, all_known, keys, rule, spec.compare, spec.rec).where("l <> r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
        sink(pairs, number)

    return run
