"""Normalisation of attributes and record keys, as columns of built-in functions.

Missing values are empty strings: every function gives '' for null, so no predicate meets a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII punctuation as a character class.
PUNCT = r"[!-/:-@\[-`{-~]"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_punct(c: str | Column) -> Column:
    """Lower case without punctuation; white space stays."""
    return F.lower(F.regexp_replace(text(c), PUNCT, ""))


def strip_digits_punct(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(text(c), r"[0-9!-/:-@\[-`{-~]", ""))


def letters_only(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(text(c), "[^a-zA-Z]", ""))


def alnum_only(c: str | Column) -> Column:
    """Letters and digits, case kept."""
    return F.regexp_replace(text(c), "[^A-Za-z0-9]+", "")


def strip_space(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(text(c), r"\s", ""))


def full_name(first: str | Column, last: str | Column) -> Column:
    """Both names without spaces, in lower case."""
    return F.lower(F.replace(F.concat(text(first), text(last)), F.lit(" "), F.lit("")))


def concat_key(*cols: str | Column) -> Column:
    """Attributes side by side without a mark between them: 'ab' + 'c' equals 'a' + 'bc'."""
    return F.concat(*[text(c) for c in cols])


def delimited_key(*cols: str | Column, mark: str = "#") -> Column:
    """Attributes with a mark after each."""
    return F.concat(*[x for c in cols for x in (text(c), F.lit(mark))])


def pad_key(df: DataFrame, cols: list[str], pad: str = "0", out: str = "key") -> DataFrame:
    """The joined attributes padded on the right to the longest one of the table."""
    key = concat_key(*cols)
    longest = df.agg(F.coalesce(F.max(F.length(key)), F.lit(0)).alias("_longest"))
    return df.crossJoin(F.broadcast(longest)).withColumn(out, F.rpad(key, F.col("_longest"), pad)).drop("_longest")


def headless(key: str | Column, width: Column | None = None) -> Column:
    """The key without its first character, a zero behind it."""
    return F.concat(F.substring(text(key), 2, 1 << 20), F.lit("0"))


def codes(c: str | Column) -> Column:
    """Letters as 0-25, digits as 26-35, others as 0, in an array."""
    chars = F.filter(F.split(F.lower(text(c)), ""), lambda x: x != "")
    return F.transform(chars, lambda x: F.when((x >= "a") & (x <= "z"), F.ascii(x) - 97).when((x >= "0") & (x <= "9"), F.ascii(x) - 48 + 26).otherwise(0))


def prefix_number(c: str | Column) -> Column:
    """First two letters as a number below 676; 0 for shorter strings."""
    s = F.lower(text(c))
    return F.when(F.length(s) < 2, 0).otherwise((F.ascii(F.substring(s, 1, 1)) - 97) + 26 * (F.ascii(F.substring(s, 2, 1)) - 97))


def interlaced(cols: list[str], k: int = 3) -> Column:
    """First characters of all attributes, those of the first attribute last, padded with 'a' to k characters."""
    heads = [F.substring(text(c), 1, 1) for c in [*cols[1:], cols[0]]]
    joined = F.concat(*heads)
    return F.rpad(joined, F.greatest(F.length(joined), F.lit(k)), "a")


def truncated_key(cols: dict[str, int | None], mark: str = "#") -> Column:
    """Attributes cut to so many characters each (None: whole), marked."""
    return delimited_key(*[text(c) if n is None else F.substring(text(c), 1, n) for c, n in cols.items()], mark=mark)


def longest_total(a: list[str | Column], b: list[str | Column]) -> Column:
    """The larger of the two records' total lengths."""
    total = lambda cols: sum((F.length(text(c)) for c in cols), F.lit(0))
    return F.greatest(total(a), total(b))


def length_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shortest non-empty, longest and mean length of each column, one row a column, in one pass."""
    n = len(cols)
    pairs = ", ".join(f"'{c}', length(coalesce(cast(`{c}` as string), ''))" for c in cols)
    long = df.selectExpr(f"stack({n}, {pairs}) as (column, len)")
    return long.groupBy("column").agg(F.min(F.when(F.col("len") > 0, F.col("len"))).cast("long").alias("min_len"), F.max("len").cast("long").alias("max_len"), F.round(F.avg("len"), 6).alias("mean_len"))
