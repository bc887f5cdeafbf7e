"""Candidate pairs (l, r), l < r, each once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Names, names, near_signatures, signature
from ..runtime import apart, materialize

#: A block of more records is cut into parts of this size that are joined part by part.
PART = 512


def candidate_pairs(blocks: DataFrame, records: DataFrame | None = None, cols: list[str] | None = None, rec: str = "rec_idx", part: int = PART, single: bool = False, match: Column | None = None) -> DataFrame:
    """Pairs (l, r) of records that share a block, each once, with attributes l_* and r_* of `cols`.

    A record travels with its attributes and the list of its blocks, which is short, and a pair is made in its first
    common block alone. So pairs are neither shuffled to make them unique nor joined with attributes: a rule, as `match` or in a filter behind this,
    sees them where they are made; as `match` it goes before the look at the lists. `single`: no record is in two blocks, or the caller drops equal pairs, so the lists are left out.

    A block of n records makes about n * n / 2 comparisons, whatever the plan. A large one is dealt out: its records fall
    into parts by a hash of the record, each record is sent to one cell for every part, and a cell joins two
    parts. So no task meets a whole large block, and blocks of up to `part` records travel once."""
    cols = cols or []
    b = _dealt(blocks, records, cols, rec, part, single)
    # both sides are the same table, shuffled once: names are given behind the join
    met = apart(b).alias("l").join(b.alias("r"), (F.col("l.block") == F.col("r.block")) & (F.col("l.cell") == F.col("r.cell")))
    met = met.select(F.col("l.rec").alias("l"), F.col("r.rec").alias("r"), F.col("l.cell").alias("_cell"), *[F.col(f"{side}.{c}").alias(f"_{side}_{c}") for side in ("l", "r") for c in ("mine", "seen", "before")], *[F.col(f"{side}.of.{c}").alias(f"{side}_{c}") for side in ("l", "r") for c in cols])
    # one filter, cheapest parts first: tests of numbers, the rule, the lists
    rule = (F.col("l") < F.col("r")) & ((F.col("_l_mine") != F.col("_r_mine")) | (F.shiftright("_cell", 31) == F.col("_cell").bitwiseAND((1 << 31) - 1)))
    rule = rule if match is None else rule & match
    rule = rule if single else rule & ((F.col("_l_seen").bitwiseAND(F.col("_r_seen")) == 0) | ~F.arrays_overlap("_l_before", "_r_before"))
    met = met.where(rule)
    return met.select("l", "r", *[f"{side}_{c}" for side in ("l", "r") for c in cols])


def _dealt(blocks: DataFrame, records: DataFrame | None, cols: list[str], rec: str, part: int, single: bool) -> DataFrame:
    """Rows (rec, seen, before, block, mine, cell, of): the records of each cell, with the blocks before this one in their lists."""
    blocks = blocks.where("block is not null")
    n = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    # blocks of one record make no pair and go; no attributes travel yet. In the lists large blocks stand first, so that their rows, which are
    # the most, have the fewest blocks before them
    b = blocks.select("rec", "block").join(apart(n), "block").select("rec", F.struct((-F.col("parts")).alias("parts"), F.length("block").alias("size"), "block").alias("at"))
    if not single:
        b = b.groupBy("rec").agg(F.sort_array(F.collect_set("at")).alias("at"))
    if cols:
        b = b.join(apart(records.select(F.col(rec).alias("rec"), F.struct(*cols).alias("of"))), "rec")
    if single:
        b = b.withColumn("seen", F.lit(0).cast("long")).withColumn("before", F.array().cast("array<string>"))
    else:
        # of the blocks before this one a bit each: two records without a common bit have no common one, and the lists are not looked at
        b = b.select("*", F.posexplode("at").alias("place", "_at")).withColumn("before", F.slice(F.col("at.block"), F.lit(1), F.col("place")))
        b = b.withColumn("at", F.col("_at")).withColumn("seen", F.aggregate("before", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(_bit(F.xxhash64(x)))))
    b = b.select("rec", "seen", "before", F.col("at.block").alias("block"), (-F.col("at.parts")).alias("parts"), *(["of"] if cols else []))
    b = b.withColumn("mine", F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.least(i, F.col("mine")).cast("long") * (1 << 31) + F.greatest(i, F.col("mine")))
    return b.withColumn("cell", F.explode(cells)).drop("parts")


#: Cells of fewer records are compared together until they have so many.
TOGETHER = 256


def measured_pairs(blocks: DataFrame, records: DataFrame, cols: list[str], measure: Callable[[list[Names], list[Names]], list[np.ndarray]], out: list[str], rec: str = "rec_idx", part: int = PART) -> DataFrame:
    """All candidate pairs (l, r) with numbers (long), where no rule leaves few: `measure` takes the attributes of all rows and all columns of a cell and
    gives a number `out` for each of both, the same if rows and columns change places. The records of a cell travel once and are
    not joined, so a pair costs some operations on arrays and its row. Pairs are those of `candidate_pairs`, each in its first common block alone."""
    given = [f"of_{c}" for c in cols]
    dealt = _dealt(blocks, records, cols, rec, part, False)
    dealt = dealt.select("block", "cell", "mine", "rec", "before", *[F.col(f"of.{c}").alias(g) for c, g in zip(cols, given, strict=True)]).repartition("block", "cell").sortWithinPartitions("block", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, cells in _units(batches):
            yield from _measured(unit, cells, given, measure, out)

    # one row for each unit: Spark makes rows of arrays in compiled code for less than it takes to read them from Arrow one by one
    made = dealt.mapInArrow(run, "_recs array<long>, _at array<long>, " + ", ".join(f"{c} array<int>" for c in out))
    made = made.select("*", F.posexplode("_at").alias("_i", "_pair"))
    end = lambda place: F.get("_recs", place.cast("int"))
    return made.select(end(F.shiftright("_pair", 32)).alias("l"), end(F.col("_pair").bitwiseAND((1 << 32) - 1)).alias("r"), *[F.get(c, "_i").cast("long").alias(c) for c in out])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of one cell, or of several small ones, and the number of each row's cell; of batches sorted by cell. A cell is put together once, however many batches it has."""
    kept, tail = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = ((batch.column("block")[i].as_py(), batch.column("cell")[i].as_py()) for i in (0, batch.num_rows - 1))
        kept.append(batch)
        if tail is None or first != last or tail != last:
            rows, starts, number = _joined(kept)
            yield from _parcels(rows, starts[:-1], number)
            kept, tail = [rows.slice(starts[-2])], last  # the last cell may go on in the next batch
    if kept:
        yield from _parcels(*_joined(kept))


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[int], np.ndarray]:
    """One batch, where its cells start and the last ends, and the number of each row's cell."""
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    block, cell = rows.column("block"), rows.column("cell")
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = pc.or_(pc.not_equal(block[1:], block[:-1]), pc.not_equal(cell[1:], cell[:-1])).to_numpy(zero_copy_only=False)
    return rows, [*np.flatnonzero(new).tolist(), rows.num_rows], np.cumsum(new)


def _parcels(rows: pa.RecordBatch, starts: list[int], number: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Neighbouring cells up to TOGETHER rows, and larger ones alone; the last of `starts` is an end."""
    begin = starts[0]
    for start, end in zip(starts, starts[1:], strict=False):
        if end - begin > TOGETHER and start > begin:
            yield rows.slice(begin, start - begin), number[begin:start]
            begin = start
    if begin < starts[-1]:
        yield rows.slice(begin, starts[-1] - begin), number[begin : starts[-1]]


def _measured(unit: pa.RecordBatch, cells: np.ndarray, cols: list[str], measure: Callable, out: list[str]) -> Iterator[pa.RecordBatch]:
    """A unit's records, its pairs as places among them (l * 2^32 + r), and each pair's numbers, as arrays of one row. A cell of two parts alone is a grid of one with the other, all else one of all rows with themselves."""
    rec, cell, mine = (unit.column(c).to_numpy() for c in ("rec", "cell", "mine"))
    across = (cell >> 31) != (cell & ((1 << 31) - 1))
    one = cells[0] == cells[-1]
    rows = columns = np.argsort(rec)
    if one and across[0]:
        rows, columns = rows[mine[rows] == mine[0]], rows[mine[rows] != mine[0]]
    coded = [pc.fill_null(unit.column(c), "") for c in cols]

    def side(places: np.ndarray) -> list[Names]:
        different = [pc.dictionary_encode(c.take(pa.array(places))) for c in coded]
        return [names(d.dictionary.to_numpy(zero_copy_only=False).tolist(), d.indices.to_numpy()) for d in different]

    left = side(rows)
    right = left if rows is columns else side(columns)
    if rows is columns:
        place = np.arange(len(rows), dtype=np.int32)
        keep = place[:, None] < place[None, :]  # in the order of rec, so l is the row
        if not one:
            keep &= cells[rows][:, None] == cells[rows][None, :]
            keep &= ~across[rows][:, None] | (mine[rows][:, None] != mine[rows][None, :])
    else:
        keep = np.ones((len(rows), len(columns)), dtype=bool)
    keep[_met_before(unit.column("before"), rows, columns)] = False
    at, n = np.flatnonzero(keep), np.count_nonzero(keep, axis=1)
    first, second = np.repeat(rows, n), columns[at - np.repeat(np.arange(len(rows)) * len(columns), n)]
    if rows is not columns:
        swap = rec[first] > rec[second]
        first, second = np.where(swap, second, first), np.where(swap, first, second)
    parts = [rec, (first << 32) | second, *[x.ravel()[at].astype(np.int32) for x in measure(left, right)]]
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in parts], names=["_recs", "_at", *out])


def _met_before(before: pa.ListArray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of records that have an earlier block in common."""
    block, of = pc.dictionary_encode(before.flatten()).indices.to_numpy(), pc.list_parent_indices(before).to_numpy()

    def entries(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(before), -1)
        at[places] = np.arange(len(places))
        at = at[of]
        found, at = block[at >= 0], at[at >= 0]
        order = np.argsort(found, kind="stable")
        return found[order], at[order]

    found, row = entries(rows)
    found2, column = (found, row) if rows is columns else entries(columns)
    start = np.searchsorted(found2, found, "left")
    n = np.searchsorted(found2, found, "right") - start
    return np.repeat(row, n), column[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def near_pairs(blocks: DataFrame, records: DataFrame, cols: list[str], limits: list[tuple[list[str], int]], match: Column, rec: str = "rec_idx", many: bool = False) -> DataFrame:
    """The candidate pairs (l, r) that meet `match`, a rule that bounds edit distances: each of `limits` has attributes and what their distances add up to
    at most. A signature for each of them rules most pairs out by a few operations on numbers, before any distance is taken. What is left is
    few, so records travel without the lists of their blocks and equal pairs are dropped at the end; with `many`, the lists travel instead."""
    signed = records.select("*", *[signature(*c[:16]).alias(f"_s{i}") for i, (c, _) in enumerate(limits)])
    rule = reduce(lambda a, b: a & b, [near_signatures(f"l__s{i}", f"r__s{i}", t) for i, (_, t) in enumerate(limits)] + [match])
    met = candidate_pairs(blocks, signed, [*cols, *[f"_s{i}" for i in range(len(limits))]], rec, single=not many, match=rule).select("l", "r")
    return met if many else met.distinct()


def _bit(number: Column) -> Column:
    """One of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))


def within_blocks(blocks: DataFrame, part: int = PART) -> DataFrame:
    """Pairs of records that share a block, without attributes."""
    return candidate_pairs(blocks, part=part)


def attach(pairs: DataFrame, records: DataFrame, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """The attributes of both records of given pairs, as l_* and r_*."""
    left = records.select(F.col(rec).alias("l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = records.select(F.col(rec).alias("r"), *[F.col(c).alias(f"r_{c}") for c in cols])
    return pairs.join(left, "l").join(right, "r")


#: Values of up to so many characters meet on what is left of them after t deletions, longer ones on pieces.
CUT = {1: 32, 2: 12}


def _cut(s: Column) -> Column:
    """A value without each of its characters in turn."""
    return F.when(F.length(s) == 0, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s)))))


def all_pairs_within(records: DataFrame, col: str, t: int, rec: str = "rec_idx") -> DataFrame:
    """All pairs whose values are within edit distance t, without comparing all with all.

    Two values within t edits become the same by t deletions at most from each, so short values meet on what is left of them. Of long ones that is too
    much: a value cut into t + 1 pieces keeps one of them through t edits, moved by t places at most. So long values meet
    on (length, piece number, piece), where the longer one offers every moved piece. A short and a long value meet as two short ones. What meets is verified.
    Equal values are one row while they are compared; the values of records come back at the end."""
    every = records.select(F.coalesce(col, F.lit("")).alias("v")).distinct().withColumn("n", F.length("v"))
    short = CUT.get(t, -1)
    v = every.where(F.col("n") > short)
    piece = lambda s, n, i: s.substr((n * i / (t + 1)).cast("int") + 1, (n * (i + 1) / (t + 1)).cast("int") - (n * i / (t + 1)).cast("int"))
    own = v.select("v", "n", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("i"))
    own = own.withColumn("piece", piece(F.col("v"), F.col("n"), F.col("i"))).select(F.col("v").alias("a"), "n", "i", "piece")
    probe = v.select("v", F.explode(F.sequence(F.greatest(F.col("n") - t, F.lit(0)), F.col("n"))).alias("n"), F.col("n").alias("m"))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(t)))).withColumn("move", F.explode(F.sequence(F.lit(-t), F.lit(t))))
    start = (F.col("n") * F.col("i") / (t + 1)).cast("int")
    size = (F.col("n") * (F.col("i") + 1) / (t + 1)).cast("int") - start
    probe = probe.where(start + F.col("move") >= 0).withColumn("piece", F.col("v").substr(start + F.col("move") + 1, size)).select(F.col("v").alias("b"), "n", "i", "piece").distinct()
    met = own.join(apart(probe), ["n", "i", "piece"]).where("a <> b").select("a", "b").distinct().where(F.levenshtein("a", "b", t) >= 0)
    if short >= 0:
        left = F.array(F.col("v"))
        for _ in range(t):
            left = F.array_distinct(F.concat(left, F.flatten(F.transform(left, _cut))))
        cut = every.where(F.col("n") <= short + t).select("v", "n", F.explode(left).alias("left"))
        x, y = cut.select("left", F.col("v").alias("a"), F.col("n").alias("na")), cut.select("left", F.col("v").alias("b"), F.col("n").alias("nb"))
        met = met.unionAll(x.join(apart(y), "left").where((F.col("a") < F.col("b")) & (F.least("na", "nb") <= short) & (F.levenshtein("a", "b", t) >= 0)).select("a", "b"))
    near = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = records.select(F.col(rec).alias("rec"), F.coalesce(col, F.lit("")).alias("v"))
    x, y = rows.select(F.col("rec").alias("x"), F.col("v").alias("a")), rows.select(F.col("rec").alias("y"), F.col("v").alias("b"))
    different = near.join(apart(x), "a").join(apart(y), "b").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"))
    equal = x.join(apart(y), (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("l"), F.col("y").alias("r"))
    return different.unionAll(equal).distinct()


def star_edges(rows: DataFrame, key: str, rec: str = "rec_idx") -> DataFrame:
    """Edges from each record to the first one with its key: the components of all pairs, with n - 1 edges for n records."""
    first = rows.groupBy(key).agg(F.min(rec).alias("l"))
    return rows.join(first, key).where(F.col(rec) > F.col("l")).select("l", F.col(rec).alias("r")).distinct()


def headless_edges(records: DataFrame, key: str, rec: str = "rec_idx") -> DataFrame:
    """Edges between records whose keys agree once the first character of one or both is dropped."""
    full = records.select(rec, F.col(key).alias("_k"))
    cut = records.select(rec, F.expr(f"substring({key}, 2)").alias("_k"))
    return star_edges(full.unionAll(cut).where("length(_k) > 0").distinct(), "_k", rec)


def headless_index(records: DataFrame, cols: list[str], rec: str = "rec_idx") -> DataFrame:
    """A block index by the attributes with a mark after each, and the same without the first character: two records share a block if their keys
    agree once the first character of one or both is dropped. All members of a block are compared, so a rule behind it loses no pair."""
    key = F.concat(*[F.concat(F.coalesce(c, F.lit("")), F.lit("#")) for c in cols])
    return records.select(F.col(rec).alias("rec"), F.explode(F.array_distinct(F.array(key, F.substring(key, 2, 1 << 30)))).alias("block"))


def random_pairs(records: DataFrame, share: float, seed: int = 0, rec: str = "rec_idx") -> DataFrame:
    """Rows (draw, x, y): about `share` of all ordered pairs, drawn with replacement. Draw i takes the records whose places in the order of ids
    are the first 60 bits of md5 of '<i>:<seed>:x' and '<i>:<seed>:y' modulo their number, so no product is made and a repeated task draws the same."""
    numbered = materialize(number_rows(records.select(rec), rec), "numbered")
    n = numbered.count()
    drawn = lambda side: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{side}")).cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(max(n, 1))
    draw = records.sparkSession.range(int(share * n * n)).select(F.col("id").alias("draw"), drawn("x").alias("i"), drawn("y").alias("j"))
    a = numbered.select(F.col("row").alias("i"), F.col(rec).alias("x"))
    b = numbered.select(F.col("row").alias("j"), F.col(rec).alias("y"))
    return draw.join(a, "i").join(b, "j").select("draw", "x", "y")


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """Dense numbers `row` from 0 in the order of the columns, without one task sorting all.

    The ranges of a range shuffle are drawn anew each time it runs. So the sorted ranges are written once, with the number of
    their partition; what is counted and what is numbered is that table. Rows that tie in all columns are numbered in any order."""
    part, place, row = "_part", "_place", "row"
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = materialize(spread.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = spread.groupBy(part).agg(F.count("*").alias("_n"))  # one row for each partition, so the window is small and so is what is sent
    before = counts.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    return spread.join(F.broadcast(before), part).withColumn(row, F.col(place) + F.col("_before")).drop(part, place, "_before")


def within_entity(records: DataFrame, entity: str = "entity_id", rec: str = "rec_idx", cols: list[str] | None = None) -> DataFrame:
    """Pairs of records of the same entity, with attributes l_* and r_*."""
    cols = cols or []
    left = records.select(entity, F.col(rec).alias("l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = records.select(entity, F.col(rec).alias("r"), *[F.col(c).alias(f"r_{c}") for c in cols])
    return left.join(right, entity).where("l < r")


def shared_attributes(a: DataFrame, b: DataFrame, shared: list[str], rec: str = "rec_idx") -> DataFrame:
    """Exact matches between two sources on the attributes that both have."""
    key = [F.coalesce(c, F.lit("")).alias(c) for c in shared]
    return a.select(F.col(rec).alias("l"), *key).join(b.select(F.col(rec).alias("r"), *key), shared).select("l", "r")


def contained(a: DataFrame, b: DataFrame, names_a: list[str], names_b: list[str], rec: str = "rec_idx") -> DataFrame:
    """Exact matches (l in a, r in b) of two data sets where the attributes of one are all attributes of the other; no rows where neither contains the other."""
    shared = [c for c in names_a if c in names_b]
    if not shared or len(shared) < min(len(set(names_a)), len(set(names_b))):
        return a.select(F.col(rec).alias("l"), F.col(rec).alias("r")).where("false")
    return shared_attributes(a, b, shared, rec)


def appended(sets: list[tuple[DataFrame, list[str]]], rec: str = "rec_idx") -> DataFrame:
    """Edges (l, r) of exact matches between all data sets of which one's attributes contain the other's: their components append what matches by way
    of a third set. Numbers of records are unique over all sets."""
    out = None
    for i, (a, na) in enumerate(sets):
        for b, nb in sets[i + 1 :]:
            if set(na) <= set(nb) or set(nb) <= set(na):
                part = contained(a, b, na, nb, rec)
                out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no data set contains the attributes of another")
    return out


def lookup(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records of the ids; ids without a record stay, with nulls."""
    return ids.join(records, key, "left")


def only(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return records.join(ids, key, "left_semi")
