"""Sampling, and records with planted differences. Everything random depends on a seed and the record alone, so a task
that runs again makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _order(col: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(col).cast("string"), F.lit(f":{seed}"))), F.col(col)]


def sample_entities(df: DataFrame, n: int, entity: str = "entity_id", seed: int = 0) -> DataFrame:
    """All records of n ids, the first in the order of a hash."""
    chosen = df.select(entity).distinct().orderBy(*_order(entity, seed)).limit(n)
    return df.join(chosen, entity, "left_semi")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(*_order(key, seed)).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(*_order(key, seed))


def in_parts(df: DataFrame, n: int, key: str) -> DataFrame:
    """Column part, 0 to n - 1, about equal in size."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def copies(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with column copy from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _drawn(key: Column, what: str, below: Column | int) -> Column:
    """A number from 0 to below - 1: the first 60 bits of md5 of '<key>:<what>', modulo below."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{what}")).cast("binary")), 1, 15), 16, 10).cast("long")
    return (h % (F.lit(below) if isinstance(below, int) else below)).cast("int")


def _other(c: Column, letters: str, n: Column) -> Column:
    """A letter besides c, the n-th after it; any one if c is none of them."""
    return F.lit(letters).substr((F.greatest(F.position(c, F.lit(letters)), F.lit(1)) + n) % F.lit(len(letters)) + 1, F.lit(1))


def with_edits(df: DataFrame, col: str, d: int, seed: int = 0) -> DataFrame:
    """d drawn insertions, deletions and substitutions of letters, one after the other; an empty string takes insertions. Null is empty."""
    key = "_edited"
    out = df.withColumn(key, F.concat(F.coalesce(F.col(col), F.lit("")), F.lit(f":{seed}"))).withColumn(col, F.coalesce(F.col(col), F.lit("")))
    for k in range(d):
        s, n = F.col(col), F.length(col)
        kind = F.when(n == 0, 0).otherwise(_drawn(F.col(key), f"{k}:kind", 3))
        out = out.withColumn("_kind", kind)
        kind = F.col("_kind")
        out = out.withColumn("_place", _drawn(F.col(key), f"{k}:place", n + F.when(kind == 0, 1).otherwise(0)))
        at = F.col("_place")
        head, tail = s.substr(F.lit(1), at), s.substr(at + 2, n)
        new = F.lit(LETTERS).substr(_drawn(F.col(key), f"{k}:letter", 26) + 1, F.lit(1))
        other = _other(s.substr(at + 1, F.lit(1)), LETTERS, _drawn(F.col(key), f"{k}:other", 25))
        out = out.withColumn(col, F.when(kind == 0, F.concat(head, new, s.substr(at + 1, n))).when(kind == 1, F.concat(head, tail)).otherwise(F.concat(head, other, tail)))
    return out.drop(key, "_kind", "_place")


def with_digit_edits(df: DataFrame, col: str, d: int, seed: int = 0) -> DataFrame:
    """d drawn places, different ones, take another digit; all places if there are fewer. Null is empty."""
    s = F.coalesce(F.col(col), F.lit(""))
    key = F.concat(s, F.lit(f":{seed}"))
    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    drawn = F.transform(places, lambda i: F.struct(F.md5(F.concat(key, F.lit(":"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))
    chosen = F.transform(F.slice(F.sort_array(drawn), 1, d), lambda x: x["i"]) if d else F.array().cast("array<int>")
    digit = "0123456789"
    by = lambda i: (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"), F.lit(":by")).cast("binary")), 1, 15), 16, 10).cast("long") % 9).cast("int")
    letters = F.transform(places, lambda i: F.when(F.array_contains(chosen, i), _other(s.substr(i, F.lit(1)), digit, by(i))).otherwise(s.substr(i, F.lit(1))))
    return df.withColumn(col, F.array_join(letters, ""))


def with_digits(df: DataFrame, col: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """Digits before drawn characters, about `share` of them. Null is empty."""
    s = F.coalesce(F.col(col), F.lit(""))
    key = F.concat(s, F.lit(f":{seed}"))
    number = lambda i, what: F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"), F.lit(what)).cast("binary")), 1, 15), 16, 10).cast("long")
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.when(number(i, ":in") % 1000 < int(share * 1000), (number(i, ":digit") % 10).cast("string")).otherwise(""), s.substr(i, F.lit(1))))
    return df.withColumn(col, F.when(s == "", s).otherwise(F.array_join(letters, "")))


def fixed_width(c: str | Column, width: int) -> Column:
    """The string repeated and cut to a width."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.repeat(c, width), 1, width)


def random_strings(spark: SparkSession, n: int, length: int, alphabet: int, seed: int = 0) -> DataFrame:
    """Rows (id, value): letter i of a string is the one that md5 of '<id>:<seed>:<i>' draws, so built-in functions suffice."""
    chars = F.transform(
        F.sequence(F.lit(1), F.lit(length)),
        lambda i: F.lit(LETTERS[:alphabet]).substr((F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:"), i.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % alphabet).cast("int") + 1, F.lit(1)),
    )
    return spark.range(n).select("id", F.array_join(chars, "").alias("value"))


def k_distant(originals: DataFrame, name: str, dates: list[str], seed: int = 0) -> DataFrame:
    """Originals (tag 0), exact copies (01), one name edit (1), copies of those (011), two name edits (2), copies of those (21), two more edits on
    them (211), and a date edit on them (22) and on originals (02)."""
    tag = lambda df, t: df.withColumn("tag", F.lit(t))
    one, two = with_edits(originals, name, 1, seed), with_edits(originals, name, 2, seed + 1)
    out = tag(originals, "0")
    for part in (
        tag(originals, "01"),
        tag(one, "1"),
        tag(one, "011"),
        tag(two, "2"),
        tag(two, "21"),
        tag(with_edits(two, name, 2, seed + 2), "211"),
        tag(with_digit_edits(two, dates[0], 1, seed + 3), "22"),
        tag(with_digit_edits(originals, dates[0], 1, seed + 4), "02"),
    ):
        out = out.unionByName(part)
    return out


def chain(originals: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Tags 0, 01 and 2, each one edit from the one before: 0 and 2 are joined by 01 alone."""
    one = with_edits(originals, name, 1, seed)
    return originals.withColumn("tag", F.lit("0")).unionByName(one.withColumn("tag", F.lit("01"))).unionByName(with_edits(one, name, 1, seed + 1).withColumn("tag", F.lit("2")))


def first_of_clusters(clusters: DataFrame, records: DataFrame, rec: str = "rec_idx") -> DataFrame:
    """The first record of each cluster, whole."""
    first = clusters.groupBy("cluster").agg(F.min("rec").alias(rec)).select(rec)
    return records.join(first, rec, "left_semi")
