"""Match rules over pairs with attributes l_* and r_*: columns of truth, cheapest parts first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import edit_within, jaro, jaro_at_least, jaro_bound, jaro_cap, jaro_reaches, scaled


def distances(cols: list[str], limits: list[int]) -> list[Column]:
    """Edit distance of each attribute up to its limit, else -1."""
    return [edit_within(f"l_{c}", f"r_{c}", t) for c, t in zip(cols, limits, strict=True)]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def each_within(cols: list[str], t: int) -> Column:
    """Every attribute within t."""
    return _all([d >= 0 for d in distances(cols, [t] * len(cols))])


def sum_within(cols: list[str], t: int, limits: list[int] | None = None) -> Column:
    """Every attribute within its limit (t if none is given) and the sum within t."""
    d = distances(cols, limits or [t] * len(cols))
    return _all([x >= 0 for x in d]) & (sum(d[1:], d[0]) <= t)


def block_and_rest(block: str, tb: int, rest: list[str], total: int) -> Column:
    """The blocking attribute within tb, the sum of the others within `total`."""
    return (edit_within(f"l_{block}", f"r_{block}", tb) >= 0) & sum_within(rest, total)


def rotating(block: str, tb: int, rest: list[str], total: int) -> Column:
    """As `block_and_rest`, but the blocking attribute's distance counts in the total."""
    d = edit_within(f"l_{block}", f"r_{block}", tb)
    e = distances(rest, [total] * len(rest))
    return (d >= 0) & _all([x >= 0 for x in e]) & (sum(e, d) <= total)


def other_source(source: str = "source") -> Column:
    return F.col(f"l_{source}") != F.col(f"r_{source}")


def total_distance(cols: list[str], cap: int | None = None, far: int = 99) -> Column:
    """Sum of edit distances; `far` if it is over the cap."""
    d = sum((F.levenshtein(f"l_{c}", f"r_{c}") for c in cols), F.lit(0)).cast("long")
    return d if cap is None else F.when(d > cap, far).otherwise(d)


def with_jaro(pairs: DataFrame, cols: list[str], least: float, mean: float | None = None, bounded: bool = False) -> DataFrame:
    """Pairs whose attributes all have a Jaro similarity of at least `least`, and on average `mean`, with column similarity.

    A bound from the lengths goes first, in a filter of its own, so the UDF sees few pairs. `bounded`: the pairs meet `jaro_near` already, which
    holds that bound; Spark would move the filter into the join that makes them, before the cheap tests that stand there."""
    if not bounded:
        pairs = pairs.where(_all([jaro_bound(f"l_{c}", f"r_{c}") >= least for c in cols]))
    for c in cols:
        pairs = pairs.withColumn(f"_j_{c}", jaro(f"l_{c}", f"r_{c}")).where(F.col(f"_j_{c}") >= least)
    pairs = pairs.withColumn("similarity", sum((F.col(f"_j_{c}") for c in cols), F.lit(0.0)) / len(cols)).drop(*[f"_j_{c}" for c in cols])
    return pairs if mean is None else pairs.where(F.col("similarity") >= mean)


def jaro_possible(cols: list[str], least: float, mean: float | None = None, sign: str = "sign") -> Column:
    """False only if an attribute's Jaro similarity is below `least`, or their mean below `mean`, by lengths and the signature of `cols` alone."""
    caps = [jaro_cap(f"l_{c}", f"r_{c}", f"l_{sign}", f"r_{sign}", k, len(cols)) for k, c in enumerate(cols)]
    ok = _all([x >= least - 1e-9 for x in caps])
    return ok if mean is None else ok & (sum(caps[1:], caps[0]) / len(cols) >= mean - 1e-9)


def jaro_near(cols: list[str], least: float, sign: str = "sign", size: str = "size") -> Column:
    """As `jaro_possible` without a mean, but true where one side is empty, from the signature and the lengths size_* of `cols`. It stands in a join, of which Java
    compiles nothing if it comes to over 8000 bytes: `jaro_possible` does."""
    return _all([jaro_reaches(f"l_{sign}", f"r_{sign}", f"l_{size}_{c}", f"r_{size}_{c}", k, len(cols), least) for k, c in enumerate(cols)])


def similarity_or_zero(similarities: list[Column], least: list[float], mean: float | None = None) -> Column:
    """The mean of similarities, 0 if one is below its bound or the mean is below `mean`; a whole number where the similarities are (hundredths, thousandths)."""
    value = sum(similarities[1:], similarities[0]) / len(similarities)
    ok = _all([s >= t for s, t in zip(similarities, least, strict=True)])
    return F.when(ok & (value >= mean) if mean is not None else ok, value).otherwise(0.0)


def scaled_similarity(similarities: list[Column], least: list[int], mean: int, factor: int = 1000) -> Column:
    """`similarity_or_zero` of similarities as whole numbers of 1 / factor, cut to a whole number itself."""
    return F.floor(similarity_or_zero([scaled(s, factor) for s in similarities], least, mean)).cast("long")


def thresholded_jaro(cols: list[str], least: float, mean: float) -> Column:
    """Every attribute reaches a Jaro similarity of `least`, and their mean is at least `mean`; the metric stops where its bounds rule it out."""
    parts = [jaro_at_least(f"l_{c}", f"r_{c}", least) for c in cols]
    return _all([x > 0 for x in parts]) & (sum(parts[1:], parts[0]) / len(parts) >= mean)


def configured(value: Column, threshold: float) -> Column:
    """A threshold of 1 or more bounds a distance from above, one below 1 a similarity from below."""
    return value <= threshold if threshold >= 1 else value >= threshold
