"""Blocking keys and the block index: rows (block, rec), each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import interlaced, text
from ..runtime import apart

#: Kinds of characters that a typed blocking field may keep.
KINDS = {"alpha": "[^a-z]", "digit": "[^0-9]", "alnum": "[^a-z0-9]", "any": ""}


def _windows(s: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: s.substr(i, F.lit(k)))


def sliding(c: str | Column, k: int = 3) -> Column:
    """Different k-mers; a shorter string is repeated until it has k characters, an empty one gives 'aaa'."""
    s = text(c)
    s = F.when(F.length(s) == 0, F.lit("a" * k)).when(F.length(s) < k, F.substring(F.repeat(s, k), 1, k)).otherwise(s)
    return F.array_distinct(_windows(s, k))


def circular(c: str | Column, k: int = 3) -> Column:
    """Different k-mers of the string closed to a ring."""
    s = text(c)
    s = F.when(F.length(s) == 0, F.lit("a" * k)).otherwise(s)
    ring = F.concat(s, F.substring(F.repeat(s, k), 1, k - 1))
    return F.array_distinct(_windows(ring, k))


def compound(keys: Column, c: str | Column) -> Column:
    """Superblocking: each key joined with the first character, so two records must share both."""
    head = F.substring(text(c), 1, 1)
    return F.transform(keys, lambda x: F.concat(head, F.lit("|"), x))


def left_padded(c: str | Column, k: int = 4) -> Column:
    """k-mers of the letters alone, padded with 'a' on the left."""
    s = F.lower(F.regexp_replace(text(c), "[^A-Za-z]", ""))
    return F.array_distinct(_windows(F.when(F.length(s) < k, F.lpad(s, k, "a")).otherwise(s), k))


def prefix(c: str | Column, k: int = 3) -> Column:
    """The first k characters; none for a shorter string."""
    s = text(c)
    return F.when(F.length(s) >= k, F.array(F.substring(s, 1, k))).otherwise(F.array().cast("array<string>"))


def _marked(keys: Column, i: int) -> Column:
    mark = F.lit(f"{i}:")
    return F.transform(keys, lambda x: F.concat(mark, x))


def typed(fields: list[tuple[str, str, int]]) -> Column:
    """k-mers of each field after dropping characters of other kinds, marked with the field's place. Fields: (column, kind, k)."""
    parts = []
    for i, (c, kind, k) in enumerate(fields):
        s = F.lower(text(c))
        if KINDS[kind]:
            s = F.regexp_replace(s, KINDS[kind], "")
        keys = F.when(F.length(s) >= k, _windows(s, k)).otherwise(F.array().cast("array<string>"))
        parts.append(_marked(keys, i))
    return F.array_distinct(F.concat(*parts))


def hashed(number: Column, x: int, y: int, p1: int, p2: int) -> Column:
    """((number * x + y) mod p1) mod p2."""
    return F.pmod(F.pmod(number * F.lit(x).cast("long") + F.lit(y).cast("long"), F.lit(p1).cast("long")), F.lit(p2).cast("long"))


def kmer_number(k: Column, base: int = 26) -> Column:
    """A k-mer of letters as a number, its first character counting least."""
    chars = F.filter(F.split(k, ""), lambda c: c != "")
    return F.aggregate(F.reverse(chars), F.lit(0).cast("long"), lambda acc, c: acc * base + (F.ascii(c) - 97).cast("long"))


def index(df: DataFrame, keys: Column, rec: str = "rec_idx") -> DataFrame:
    """The block index of a table. Only the key and the record's number travel."""
    return df.select(F.col(rec).alias("rec"), F.explode(F.array_distinct(keys)).alias("block"))


def interlaced_index(df: DataFrame, cols: list[str], k: int = 3, rec: str = "rec_idx") -> DataFrame:
    """Superblocking over first characters of all attributes, as a ring."""
    s = interlaced(cols, k)
    return index(df, compound(circular(s, k), s), rec)


def multi_pass(df: DataFrame, passes: list[Column], rec: str = "rec_idx") -> DataFrame:
    """Several kinds of blocks in one index, marked by their pass."""
    out = None
    for i, keys in enumerate(passes):
        part = index(df, _marked(keys, i), rec)
        out = part if out is None else out.unionByName(part)
    return out


def sizes(blocks: DataFrame) -> DataFrame:
    """Rows (block, n, comparisons) of blocks."""
    return blocks.groupBy("block").agg(F.count("*").alias("n")).withColumn("comparisons", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def members(blocks: DataFrame) -> DataFrame:
    """Rows (rec, blocks): the record's blocks in order; a record is in few blocks, so the lists are short."""
    return blocks.groupBy("rec").agg(F.sort_array(F.collect_set("block")).alias("blocks"))


def residual(df: DataFrame, clusters: DataFrame, most: int, keys: Column, small: bool, rec: str = "rec_idx") -> DataFrame:
    """Block index of the records in clusters of at most `most` records (or, with small=False, of more). `clusters`: (rec, cluster)."""
    n = clusters.groupBy("cluster").count()
    wanted = clusters.join(apart(n.where(F.col("count") <= most if small else F.col("count") > most)), "cluster").select(F.col("rec").alias(rec))
    return index(df.join(apart(wanted), rec, "left_semi"), keys, rec)
