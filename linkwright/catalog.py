"""The registered queries of the record-linkage library, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as m
from .functions import normalize as n
from .operators import blocking as b
from .operators import diagnostics as d
from .operators import evaluate as e
from .operators import generate as g
from .operators import grouping as gr
from .operators import pairs as p
from .operators import predicates as pr
from .operators import refine as rf
from .operators.graph import connected_components
from .plans import linkage
from .runtime import apart, materialize
from .sources import writers
from .spec import LinkageSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COLS = ["first", "last", "suburb", "postcode"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.rstrip("_")] = f
        if sql:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records of each customer: the original, a copy, one letter of `last` dropped, one changed, the first one dropped."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789", "ghijklmnop").alias("b"))
    c = c.select("c_custkey", "b", F.substring("b", 7, 8).alias("l"), (F.col("c_custkey") % 8 + 1).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"))
    head, tail = F.expr("substring(l, 1, p - 1)"), F.expr("substring(l, p + 1)")
    last = F.when(F.col("s") == 2, F.concat(head, tail)).when(F.col("s") == 3, F.concat(head, F.lit("z"), tail)).when(F.col("s") == 4, F.expr("substring(l, 2)")).otherwise(F.col("l"))
    return c.select(
        (F.col("c_custkey") * 5 + F.col("s")).alias("rec_idx"),
        F.col("c_custkey").alias("entity_id"),
        F.col("s").cast("int").alias("source"),
        F.substring("b", 1, 6).alias("first"),
        last.alias("last"),
        F.substring("b", 15, 6).alias("suburb"),
        F.lpad((F.col("c_custkey") % 1000).cast("string"), 4, "0").alias("postcode"),
    )


PLANTED = """WITH RECURSIVE planted AS (
  SELECT c_custkey * 5 + s AS rec_idx, c_custkey AS entity_id, CAST(s AS INTEGER) AS source, substr(b, 1, 6) AS first,
    CASE s WHEN 2 THEN substr(l, 1, p - 1) || substr(l, p + 1) WHEN 3 THEN substr(l, 1, p - 1) || 'z' || substr(l, p + 1)
      WHEN 4 THEN substr(l, 2) ELSE l END AS last,
    substr(b, 15, 6) AS suburb, lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') AS postcode
  FROM (SELECT c_custkey, b, substr(b, 7, 8) AS l, CAST(1 + c_custkey % 8 AS INTEGER) AS p
        FROM (SELECT c_custkey, translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789', 'ghijklmnop') AS b FROM customer)),
       (SELECT unnest(range(5)) AS s))
"""
UNIQUE = PLANTED + """, uniq AS (SELECT first, last, suburb, postcode, min(rec_idx) AS rec_idx FROM planted GROUP BY ALL)
"""
SLIDING = "list_distinct([substr(last, i, 3) FOR i IN range(1, length(last) - 1)])"
BLOCKS = UNIQUE + f""", blocks AS (SELECT rec_idx AS rec, substr(last, 1, 1) || '|' || k AS block FROM (SELECT rec_idx, last, unnest({SLIDING}) AS k FROM uniq)),
cand AS (SELECT DISTINCT x.rec AS l, y.rec AS r FROM blocks x JOIN blocks y ON x.block = y.block AND x.rec < y.rec),
att AS (SELECT l, r, a.first AS l_first, a.last AS l_last, a.suburb AS l_suburb, a.postcode AS l_postcode, b.first AS r_first, b.last AS r_last, b.suburb AS r_suburb, b.postcode AS r_postcode
  FROM cand JOIN uniq a ON a.rec_idx = l JOIN uniq b ON b.rec_idx = r)
"""
_D = {c: f"levenshtein(l_{c}, r_{c})" for c in COLS}
_SUM = " + ".join(_D.values())


def super_index(records: DataFrame) -> DataFrame:
    return b.index(records, b.compound(b.sliding("last"), "last"))


def unique(spark, sf_dir) -> DataFrame:
    return planted(spark, sf_dir).groupBy(*COLS).agg(F.min("rec_idx").alias("rec_idx"))


def candidates(spark, sf_dir) -> DataFrame:
    u = unique(spark, sf_dir)
    return p.candidate_pairs(super_index(u), u, COLS)


def alike(spark, sf_dir, rule, many=True) -> DataFrame:
    """The candidates that meet a rule on lengths and signatures; with many=False, one that leaves few, so records travel without the lists of their blocks."""
    u = unique(spark, sf_dir)
    signed = u.select("*", m.signature(*COLS).alias("sign"), *[F.length(c).alias(f"size_{c}") for c in COLS])
    met = p.candidate_pairs(super_index(u), signed, [*COLS, "sign", *[f"size_{c}" for c in COLS]], single=not many, match=rule)
    # not distinct(): Spark would move a metric behind it into the join's tasks, which hold blocks, and take it of equal pairs again
    return met if many else met.select("l", "r", *[f"{side}_{c}" for side in ("l", "r") for c in COLS]).dropDuplicates(["l", "r"])


# normalisation -------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g')) AS value FROM documents""")
def norm_strip_punct(spark, sf_dir):
    # the two engines fold letters beyond ASCII alike in these texts
    return read(spark, sf_dir, "documents").select("doc_id", n.strip_punct("text").alias("value"))


@query(r"""SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[0-9!-/:-@\[-`{-~]', '', 'g')) AS value FROM documents""")
def norm_strip_digits_punct(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", n.strip_digits_punct("text").alias("value"))


@query("""SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) AS letters, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '', 'g') AS alnum FROM documents""")
def norm_letters_alnum(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", n.letters_only("text").alias("letters"), n.alnum_only("text").alias("alnum"))


@query("""SELECT p_partkey, lower(replace(p_name || p_brand, ' ', '')) AS name, p_name || '#' || p_brand || '#' || p_type || '#' AS key, lower(regexp_replace(p_type, '\\s', '', 'g')) AS tight FROM part""".replace("\\\\", "\\"))
def norm_concat_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", n.full_name("p_name", "p_brand").alias("name"), n.delimited_key("p_name", "p_brand", "p_type").alias("key"), n.strip_space("p_type").alias("tight"))


@query("""SELECT p_partkey, rpad(p_name || p_brand, (SELECT CAST(max(length(p_name || p_brand)) AS INTEGER) FROM part), '0') AS key,
  substr(rpad(p_name || p_brand, (SELECT CAST(max(length(p_name || p_brand)) AS INTEGER) FROM part), '0'), 2) || '0' AS headless FROM part""")
def norm_pad_key(spark, sf_dir):
    return n.pad_key(read(spark, sf_dir, "part"), ["p_name", "p_brand"]).select("p_partkey", "key", n.headless("key").alias("headless"))


@query(PLANTED + """SELECT rec_idx, rpad(substr(last, 1, 1) || substr(suburb, 1, 1) || substr(postcode, 1, 1) || substr(first, 1, 1), 4, 'a') AS interlaced,
  (ascii(substr(first, 1, 1)) - 97) + 26 * (ascii(substr(first, 2, 1)) - 97) AS prefix, substr(first, 1, 3) || '#' || last || '#' AS cut,
  greatest(length(first) + length(last), length(suburb) + length(postcode)) AS longest FROM planted""")
def norm_interlaced(spark, sf_dir):
    return planted(spark, sf_dir).select("rec_idx", n.interlaced(COLS, 4).alias("interlaced"), n.prefix_number("first").alias("prefix"), n.truncated_key({"first": 3, "last": None}).alias("cut"), n.longest_total(["first", "last"], ["suburb", "postcode"]).cast("long").alias("longest"))


@query(PLANTED + """SELECT rec_idx, list_sum([(CASE WHEN ch BETWEEN 'a' AND 'z' THEN ascii(ch) - 97 WHEN ch BETWEEN '0' AND '9' THEN ascii(ch) - 22 ELSE 0 END) FOR ch IN string_split(postcode || first, '')])::BIGINT AS code_sum FROM planted""")
def norm_codes(spark, sf_dir):
    c = n.codes(F.concat("postcode", "first"))
    return planted(spark, sf_dir).select("rec_idx", F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query("""SELECT 'p_name' AS "column", min(length(p_name)) FILTER (length(p_name) > 0) AS min_len, max(length(p_name)) AS max_len, round(avg(length(p_name)), 6) AS mean_len FROM part
UNION ALL SELECT 'p_type', min(length(p_type)) FILTER (length(p_type) > 0), max(length(p_type)), round(avg(length(p_type)), 6) FROM part""")
def col_length_stats(spark, sf_dir):
    return n.length_stats(read(spark, sf_dir, "part"), ["p_name", "p_type"])


# exact groups --------------------------------------------------------------------------------------------------------


@query("SELECT p_name, p_brand, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY p_name, p_brand")
def exact_dedup(spark, sf_dir):
    return gr.exact_groups(read(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey")


@query("SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1")
def dedup_rep(spark, sf_dir):
    return gr.representatives(read(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey")


@query("SELECT p_partkey AS rec, min(p_partkey) OVER (PARTITION BY p_name) AS rep FROM part")
def dedup_members(spark, sf_dir):
    return gr.membership(read(spark, sf_dir, "part"), ["p_name"], "p_partkey")


@query(PLANTED + "SELECT rec_idx FROM planted QUALIFY count(*) OVER (PARTITION BY suburb, postcode, source % 2) > 1")
def source_conflicts(spark, sf_dir):
    r = planted(spark, sf_dir).withColumn("source", F.col("source") % 2)
    return gr.conflicts(r, ["suburb", "postcode"])


@query(PLANTED + "SELECT min(rec_idx) AS rep, count(*) AS n, count(*) = 5 AS is_full FROM planted GROUP BY first, suburb, postcode")
def full_exact_clusters(spark, sf_dir):
    return gr.full_groups(planted(spark, sf_dir), ["first", "suburb", "postcode"], 5)


@query(PLANTED + "SELECT entity_id, count(*) AS n, min(rec_idx) AS first_rec, max(rec_idx) AS last_rec FROM planted GROUP BY entity_id")
def entity_groups(spark, sf_dir):
    return gr.entity_groups(planted(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 10")
def id_count_n(spark, sf_dir):
    return gr.with_count(read(spark, sf_dir, "orders"), "o_custkey", 10).select("o_orderkey", "o_custkey")


@query(PLANTED + """, x AS (SELECT CAST(first <> lag(first) OVER w AS BIGINT) AS a, CAST(last <> lag(last) OVER w AS BIGINT) AS b, CAST(suburb <> lag(suburb) OVER w AS BIGINT) AS c, CAST(lag(rec_idx) OVER w IS NOT NULL AS BIGINT) AS p FROM planted WINDOW w AS (PARTITION BY entity_id ORDER BY rec_idx))
SELECT CAST(sum(a) AS BIGINT) AS first_changes, CAST(sum(b) AS BIGINT) AS last_changes, CAST(sum(c) AS BIGINT) AS suburb_changes, CAST(sum(p) AS BIGINT) AS pairs FROM x""")
def adjacent_mismatch(spark, sf_dir):
    return gr.adjacent_mismatch(planted(spark, sf_dir), ["first", "last", "suburb"])


# blocking ------------------------------------------------------------------------------------------------------------


def _blocks_sql(expr: str) -> str:
    return PLANTED + f"SELECT DISTINCT rec_idx AS rec, unnest({expr}) AS block FROM planted"


@query(_blocks_sql(SLIDING))
def kmer_blocks(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.sliding("last"))


RING = "list_distinct([substr(last || substr(last, 1, 2), i, 3) FOR i IN range(1, length(last) + 1)])"


@query(_blocks_sql(RING))
def kmer_blocks_circular(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.circular("last"))


@query(_blocks_sql(f"[substr(last, 1, 1) || '|' || k FOR k IN {SLIDING}]"))
def super_blocks(spark, sf_dir):
    return super_index(planted(spark, sf_dir))


@query(_blocks_sql(f"[substr(last, 1, 1) || '|' || k FOR k IN {RING}]"))
def super_blocks_circular(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.compound(b.circular("last"), "last"))


@query(PLANTED + """, s AS (SELECT rec_idx, substr(last, 1, 1) || substr(suburb, 1, 1) || substr(postcode, 1, 1) || substr(first, 1, 1) AS t FROM planted)
SELECT DISTINCT rec_idx AS rec, substr(t, 1, 1) || '|' || unnest([substr(t || substr(t, 1, 2), i, 3) FOR i IN range(1, length(t) + 1)]) AS block FROM s""")
def interlaced_blocks(spark, sf_dir):
    return b.interlaced_index(planted(spark, sf_dir), COLS)


@query(PLANTED + """, s AS (SELECT rec_idx, rpad(substr(last, 1, 1) || substr(suburb, 1, 1) || substr(postcode, 1, 1) || substr(first, 1, 1), 4, 'a') AS t FROM planted)
SELECT rec_idx AS rec, '0:' || t AS block FROM s UNION SELECT rec_idx, '1:' || unnest([substr(t, i, 3) FOR i IN range(1, length(t) - 1)]) FROM s""")
def interlaced_exact_blocks(spark, sf_dir):
    s = n.interlaced(COLS, 4)
    return b.multi_pass(planted(spark, sf_dir), [F.array(s), b.sliding(s)])


@query(PLANTED + """SELECT (ascii(substr(first, 1, 1)) - 97) + 26 * (ascii(substr(first, 2, 1)) - 97) AS prefix, count(*) AS records, min(rec_idx) AS first_rec FROM planted GROUP BY 1""")
def prefix_partitions(spark, sf_dir):
    r = planted(spark, sf_dir).withColumn("prefix", n.prefix_number("first")).repartitionByRange("prefix").sortWithinPartitions("prefix", "rec_idx")
    return r.groupBy("prefix").agg(F.count("*").alias("records"), F.min("rec_idx").alias("first_rec"))


@query(_blocks_sql("list_distinct([substr(last, i, 4) FOR i IN range(1, length(last) - 2)])"))
def lmer4_blocks(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.left_padded("last", 4))


@query(_blocks_sql("[substr(last, 1, 3)]"))
def prefix_blocks(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.prefix("last"))


@query(_blocks_sql("list_distinct(list_concat(['0:' || substr(first, i, 4) FOR i IN range(1, length(first) - 2)], ['1:' || substr(postcode, i, 3) FOR i IN range(1, length(postcode) - 1)]))"))
def typed_blocks(spark, sf_dir):
    return b.index(planted(spark, sf_dir), b.typed([("first", "alpha", 4), ("postcode", "digit", 3)]))


@query("""SELECT p_partkey, ((p_partkey * 31 + 7) % 10007) % 97 AS block FROM part""")
def hashed_blocks(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", b.hashed(F.col("p_partkey"), 31, 7, 10007, 97).alias("block"))


@query(PLANTED + f"SELECT rec_idx, CAST(list_sum([ascii(substr(k, 1, 1)) - 97 + 26 * (ascii(substr(k, 2, 1)) - 97) + 676 * (ascii(substr(k, 3, 1)) - 97) FOR k IN {SLIDING}]) AS BIGINT) AS number_sum FROM planted")
def kmer_numbers(spark, sf_dir):
    ids = F.transform(b.sliding("last"), lambda k: b.kmer_number(k))
    return planted(spark, sf_dir).select("rec_idx", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("number_sum"))


@query(_blocks_sql(f"list_concat(['0:' || substr(last, 1, 1) || '|' || k FOR k IN {SLIDING}], ['1:' || substr(first, 1, 3)])"))
def multi_pass_blocks(spark, sf_dir):
    return b.multi_pass(planted(spark, sf_dir), [b.compound(b.sliding("last"), "last"), b.prefix("first")])


@query(BLOCKS + "SELECT block, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS comparisons FROM blocks GROUP BY block")
def block_sizes(spark, sf_dir):
    return b.sizes(super_index(unique(spark, sf_dir)))


@query(BLOCKS + "SELECT rec, list_sort(list_distinct(list(block))) AS blocks FROM blocks GROUP BY rec")
def record_blocks(spark, sf_dir):
    return b.members(super_index(unique(spark, sf_dir)))


@query(BLOCKS + """, s AS (SELECT block, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS comparisons FROM blocks GROUP BY block)
SELECT block, n, comparisons, round(100.0 * comparisons / (SELECT sum(comparisons) FROM s), 6) AS percent FROM s ORDER BY comparisons DESC, block LIMIT 100""")
def block_share_top100(spark, sf_dir):
    return gr.block_shares(b.sizes(super_index(unique(spark, sf_dir))))


@query(BLOCKS + """, s AS (SELECT count(*) AS n FROM blocks GROUP BY block), u AS (SELECT count(*) AS n FROM uniq)
SELECT CAST(sum(s.n * (s.n - 1) // 2) AS BIGINT) AS comparisons, CAST(max(u.n) * (max(u.n) - 1) // 2 AS BIGINT) AS all_pairs,
  round(1 - sum(s.n * (s.n - 1) // 2) / CAST(max(u.n) * (max(u.n) - 1) // 2 AS DOUBLE), 6) AS reduction_ratio FROM s, u""")
def reduction_ratio(spark, sf_dir):
    u = unique(spark, sf_dir)
    return d.reduction(super_index(u), u.count())


@query(PLANTED + "SELECT CAST(sum(greatest(length(last) - 2, 0)) AS BIGINT) AS kmers FROM planted")
def kmer_count(spark, sf_dir):
    return gr.kmer_count(planted(spark, sf_dir), "last")


@query(BLOCKS + "SELECT l, r FROM cand")
def distinct_pairs(spark, sf_dir):
    return p.within_blocks(super_index(unique(spark, sf_dir)))


@query(BLOCKS + "SELECT r AS rec, count(DISTINCT l) AS partners FROM cand GROUP BY r")
def pair_partners(spark, sf_dir):
    return gr.partners(p.within_blocks(super_index(unique(spark, sf_dir))), once=True)


# joins ---------------------------------------------------------------------------------------------------------------


def names(spark, sf_dir) -> DataFrame:
    """Different part names, numbered by their smallest key."""
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("rec_idx"))


NAMES = "WITH names AS (SELECT p_name, min(p_partkey) AS rec_idx FROM part GROUP BY p_name)\n"


@query(PLANTED + """, v AS (SELECT DISTINCT last FROM planted), near AS (SELECT x.last AS a, y.last AS b FROM v x, v y WHERE abs(length(x.last) - length(y.last)) <= 1 AND levenshtein(x.last, y.last) <= 1)
SELECT x.rec_idx AS l, y.rec_idx AS r FROM near JOIN planted x ON x.last = a JOIN planted y ON y.last = b WHERE x.rec_idx < y.rec_idx""")
def ed_all_pairs(spark, sf_dir):
    return p.all_pairs_within(planted(spark, sf_dir), "last", 1)


def name_pairs(spark, sf_dir) -> DataFrame:
    """All pairs of the different part names, which are few whatever the number of parts, dealt out as the records of one block."""
    u = names(spark, sf_dir)
    met = p.within_blocks(u.select(F.lit("all").alias("block"), F.col("rec_idx").alias("rec")))
    one = u.select(F.col("rec_idx").alias("l"), F.col("p_name").alias("a"))
    return met.join(one, "l").join(one.select(F.col("l").alias("r"), F.col("a").alias("b")), "r").select("l", "r", "a", "b")


PAIRS = NAMES + ", pairs AS (SELECT x.rec_idx AS l, y.rec_idx AS r, x.p_name AS a, y.p_name AS b FROM names x JOIN names y ON x.rec_idx < y.rec_idx)\n"


@query(PAIRS + "SELECT l, r, levenshtein(a, b) AS ed, CASE WHEN levenshtein(a, b) <= 3 THEN levenshtein(a, b) ELSE 100 END AS ed3 FROM pairs")
def ed_thresholded(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", m.edit_distance("a", "b").alias("ed"), m.edit_or_far("a", "b", 3).alias("ed3"))


@query(BLOCKS + f"SELECT l, r, CASE WHEN 0.5 * {_D['first']} + 2.0 * {_D['last']} + 1.0 * {_D['suburb']} <= 12 THEN 0.5 * {_D['first']} + 2.0 * {_D['last']} + 1.0 * {_D['suburb']} END::DOUBLE AS weighted FROM att")
def weighted_ed(spark, sf_dir):
    return candidates(spark, sf_dir).select("l", "r", m.weighted_edit([("l_first", "r_first", 0.5), ("l_last", "r_last", 2.0), ("l_suburb", "r_suburb", 1.0)], 12).alias("weighted"))


@query(BLOCKS + f"SELECT l, r, least({_D['first']} + {_D['last']}, levenshtein(l_first, r_last) + levenshtein(l_last, r_first)) AS reversal, levenshtein(substr(l_last, 1, 4), substr(r_last, 1, 4)) AS truncation, levenshtein(substr(l_last, 1, least(length(l_last), length(r_last))::INTEGER), substr(r_last, 1, least(length(l_last), length(r_last))::INTEGER)) AS truncation_min FROM att")
def reversal_truncation(spark, sf_dir):
    u = unique(spark, sf_dir)
    return p.measured_pairs(super_index(u), u, ["first", "last"], m.reversals_truncations, ["reversal", "truncation", "truncation_min"])


_HAM = "len([i FOR i IN range(1, least(length(a), length(b)) + 1) IF substr(a, i, 1) <> substr(b, i, 1)])"
_EQ = f"(least(length(a), length(b)) - {_HAM})"


@query(PAIRS + f"SELECT l, r, {_HAM} AS hamming, round(CAST({_EQ} AS DOUBLE) / (length(a) + length(b) - {_EQ}), 6) AS char_jaccard FROM pairs")
def hamming(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", m.hamming("a", "b").alias("hamming"), F.round(m.char_jaccard("a", "b"), 6).alias("char_jaccard"))


def _kl(c: str, k: str = "3") -> str:
    return f"[substr({c}, i, {k}) FOR i IN range(1, greatest(length({c}) - {k} + 2, 2))]"


@query(PAIRS + f""", q AS (SELECT l, r, a, b, greatest(CAST(floor(least(length(a), length(b)) * 0.35) AS INTEGER), 1) AS k FROM pairs),
s AS (SELECT l, r, abs(length(a) - length(b)) > 1 AS far, list_distinct({_kl('a', 'k')}) AS x, list_distinct({_kl('b', 'k')}) AS y, list_distinct({_kl('a')}) AS x3, list_distinct({_kl('b')}) AS y3 FROM q)
SELECT l, r, round(CASE WHEN far THEN 0.0 ELSE CAST(2.0 * len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y)) END, 6) AS dice,
  round(CASE WHEN far THEN 0.0 ELSE CAST(len(list_intersect(x3, y3)) AS DOUBLE) / (len(x3) + len(y3) - len(list_intersect(x3, y3))) END, 6) AS jaccard FROM s""")
def qgrams(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.qgram_dice("a", "b"), 6).alias("dice"), F.round(m.qgram_jaccard("a", "b"), 6).alias("jaccard"))


@query(PAIRS + f""", s AS (SELECT l, r, abs(length(a) - length(b)) > 1 AS far, {_kl('a')} AS x, {_kl('b')} AS y FROM pairs),
h AS (SELECT *, len([i FOR i IN range(1, len(x) + 1) IF list_contains(y[greatest(i - 1, 1):i + 1], x[i])]) AS n FROM s)
SELECT l, r, round(CASE WHEN far THEN 0.0 ELSE CAST(n AS DOUBLE) / (len(x) + len(y) - n) END, 6) AS positional FROM h""")
def qgram_positional(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.qgram_positional("a", "b"), 6).alias("positional"))


_SAME = "CAST(len([j FOR j IN range(1, 4) IF j <= least(length({p}), length({q})) AND substr({p}, j, 1) = substr({q}, j, 1)]) AS DOUBLE)"


def _sim(x: str, y: str) -> str:
    s = _SAME.format(p=x, q=y)
    return f"({s} / (length({x}) + length({y}) - {s}))"


@query(PAIRS + f""", s AS (SELECT l, r, {_kl('a')} AS x, {_kl('b')} AS y FROM pairs)
SELECT l, r, round(list_min([list_max([{_sim('p', 'q')} FOR q IN y]) FOR p IN x]), 6) AS hausdorff,
  round(list_min([{_sim('x[i]', 'y[i]')} FOR i IN range(1, least(len(x), len(y)) + 1)]), 6) AS positional,
  round(least({_sim('x[1]', 'y[1]')}, {_sim('x[-1]', 'y[-1]')}), 6) AS fast FROM s""")
def hausdorff_kmer(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.hausdorff("a", "b"), 6).alias("hausdorff"), F.round(m.hausdorff_positional("a", "b"), 6).alias("positional"), F.round(m.hausdorff_fast("a", "b"), 6).alias("fast"))


@query(PAIRS + "SELECT l, r, round(jaro_similarity(a, b), 6) AS jaro, CAST(floor(jaro_similarity(a, b) * 1000 + 1e-9) AS INTEGER) AS jaro_1000 FROM pairs")
def jaro_int(spark, sf_dir):
    return name_pairs(spark, sf_dir).withColumn("j", m.jaro("a", "b")).select("l", "r", F.round("j", 6).alias("jaro"), m.scaled(F.col("j")).alias("jaro_1000"))


_PRE = "len([i FOR i IN range(1, 5) IF substr(a, 1, i) = substr(b, 1, i) AND i <= least(length(a), length(b))])"


@query(PAIRS + f"SELECT l, r, round(CASE WHEN abs(length(a) - length(b)) > 1 THEN 0.2 ELSE jaro_similarity(a, b) + 0.1 * {_PRE} * (1 - jaro_similarity(a, b)) END, 6) AS jaro_winkler FROM pairs")
def jaro_winkler_ref(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.jaro_winkler("a", "b"), 6).alias("jaro_winkler"))


@query()
def jaro_frac(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.jaro("a", "b", whole=False), 6).alias("jaro"))


@query(PAIRS + "SELECT l, r, round(CASE WHEN jaro_similarity(a, b) >= 0.8 THEN jaro_similarity(a, b) ELSE 0.0 END, 6) AS jaro FROM pairs")
def jaro_thresholded(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.jaro_at_least("a", "b", 0.8), 6).alias("jaro"))


@query("""WITH s AS MATERIALIZED (SELECT id, list_aggregate([substr('abcde', CAST(CAST('0x' || substr(md5(id || ':0:' || i), 1, 15) AS BIGINT) % 5 AS INTEGER) + 1, 1) FOR i IN range(1, 26)], 'string_agg', '') AS v FROM (SELECT unnest(range(10000)) AS id))
SELECT a.id AS l, b.id AS r, round(jaro_similarity(a.v, b.v), 6) AS jaro FROM s a JOIN s b ON a.id < b.id WHERE jaro_similarity(a.v, b.v) >= 0.9000001""")
def jaro_all_pairs(spark, sf_dir):
    """10,000 random strings of 25 letters out of 5, all with all: the setting of the published timings."""
    return m.all_pairs_jaro(g.random_strings(spark, 10_000, 25, 5), "value", 0.9000001).withColumn("jaro", F.round("jaro", 6))


def _long_pairs(spark, length: int, alphabet: int, n: int = 1500) -> DataFrame:
    """All pairs of random strings of a length beyond one machine word, of different lengths by up to a third."""
    s = g.random_strings(spark, n, length, alphabet).withColumn("value", F.substring("value", 1, length - 2) if not length % 2 else F.col("value"))
    return m.all_pairs_jaro(s.withColumn("value", F.col("value").substr(F.lit(1), (F.length("value") - F.col("id") % (length // 3)).cast("int"))), "value", 0.7000001).withColumn("jaro", F.round("jaro", 6))


def _long_sql(length: int, alphabet: int, n: int = 1500) -> str:
    keep = length - 2 if not length % 2 else length
    return f"""WITH s AS MATERIALIZED (SELECT id, substr(list_aggregate([substr('abcdefghijklmnopqrstuvwxyz', CAST(CAST('0x' || substr(md5(id || ':0:' || i), 1, 15) AS BIGINT) % {alphabet} AS INTEGER) + 1, 1) FOR i IN range(1, {length + 1})], 'string_agg', ''), 1, CAST({keep} - id % {length // 3} AS INTEGER)) AS v FROM (SELECT unnest(range({n})) AS id))
SELECT a.id AS l, b.id AS r, round(jaro_similarity(a.v, b.v), 6) AS jaro FROM s a JOIN s b ON a.id < b.id WHERE jaro_similarity(a.v, b.v) >= 0.7000001"""


for _n, _letters, _many in ((75, 5, 1500), (150, 5, 1500), (500, 4, 700)):
    QUERIES[f"jaro_length_{_n}"] = lambda spark, sf_dir, _n=_n, _letters=_letters, _many=_many: _long_pairs(spark, _n, _letters, _many)
    SQL[f"jaro_length_{_n}"] = _long_sql(_n, _letters, _many)


# a row of the table at a time; within a row the best way from the left is a minimum over all places before
@query(PAIRS.replace("WITH names", "WITH RECURSIVE names") + """, way(l, r, a, b, i, before, line) AS (SELECT l, r, a, b, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), range(length(b) + 1) FROM pairs
  UNION ALL SELECT l, r, a, b, i + 1, line, [list_min([t[k] + j - k FOR k IN range(1, j + 1)]) FOR j IN range(1, len(t) + 1)] FROM (SELECT *, list_concat([i + 1],
    [least(line[j + 1] + 1, line[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND j >= 2 AND substr(a, i + 1, 1) = substr(b, j - 1, 1) AND substr(a, i, 1) = substr(b, j, 1) THEN before[j - 1] + 1 ELSE 1000 END) FOR j IN range(1, length(b) + 1)]) AS t FROM way WHERE i < length(a)))
SELECT l, r, line[-1] AS osa FROM way WHERE i = length(a)""")
def osa(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", m.osa("a", "b").alias("osa"))


@query(PAIRS + "SELECT l, r, round((0.6 * jaro_similarity(a, b) + 1.4 * jaro_similarity(b, a)) / 2, 6) AS mean FROM pairs")
def weighted_mean(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("l", "r", F.round(m.weighted_mean([(m.jaro("a", "b"), 0.6), (m.jaro("b", "a"), 1.4)]), 6).alias("mean"))


# match rules ---------------------------------------------------------------------------------------------------------


def _match(sql: str, limits, rule, many=False):
    def f(spark, sf_dir):
        u = unique(spark, sf_dir)
        return p.near_pairs(super_index(u), u, COLS, limits, rule(), many=many)

    return f, BLOCKS + f"SELECT l, r FROM att WHERE {sql}"


for _name, _sql, _limits, _rule in (
    ("match_f1", f"{_SUM} <= 1", [(COLS, 1)], lambda: pr.sum_within(COLS, 1)),
    ("match_f2", f"{_D['last']} <= 1 AND {_D['first']} + {_D['suburb']} + {_D['postcode']} <= 2", [(["first", "suburb", "postcode"], 2)], lambda: pr.block_and_rest("last", 1, ["first", "suburb", "postcode"], 2)),
    ("match_f3", f"{_D['last']} <= 2 AND {_D['suburb']} + {_D['postcode']} <= 1", [(["suburb", "postcode"], 1)], lambda: pr.block_and_rest("last", 2, ["suburb", "postcode"], 1)),
    ("match_f4", " AND ".join(f"{_D[c]} <= 1" for c in COLS), [(COLS, 4)], lambda: pr.each_within(COLS, 1)),
    ("match_f5", f"{_D['first']} <= 3 AND {_D['last']} <= 2 AND {_D['suburb']} <= 3 AND {_D['postcode']} <= 2 AND {_SUM} <= 5", [(COLS, 5)], lambda: pr.sum_within(COLS, 5, [3, 2, 3, 2])),
    ("match_f8", f"{_D['last']} <= 3 AND {_SUM} <= 5", [(COLS, 5)], lambda: pr.rotating("last", 3, ["first", "suburb", "postcode"], 5)),
    ("match_f12", f"{_D['last']} <= 2.0", [(["last"], 2)], lambda: pr.configured(m.edit_or_far("l_last", "r_last", 2), 2.0)),
):
    QUERIES[_name], SQL[_name] = _match(_sql, _limits, _rule, _name == "match_f12")


RAW = PLANTED + f""", blocks AS (SELECT rec_idx AS rec, substr(last, 1, 1) || '|' || k AS block FROM (SELECT rec_idx, last, unnest({SLIDING}) AS k FROM planted)),
cand AS (SELECT DISTINCT x.rec AS l, y.rec AS r FROM blocks x JOIN blocks y ON x.block = y.block AND x.rec < y.rec),
att AS (SELECT l, r, a.source AS l_source, b.source AS r_source, a.first AS l_first, a.last AS l_last, a.suburb AS l_suburb, a.postcode AS l_postcode, b.first AS r_first, b.last AS r_last, b.suburb AS r_suburb, b.postcode AS r_postcode
  FROM cand JOIN planted a ON a.rec_idx = l JOIN planted b ON b.rec_idx = r)
"""


@query(RAW + f"SELECT l, r FROM att WHERE l_source <> r_source AND {_D['last']} <= 3 AND {_D['first']} + {_D['suburb']} + {_D['postcode']} <= 5")
def match_source(spark, sf_dir):
    r = planted(spark, sf_dir)
    rule = pr.other_source() & pr.block_and_rest("last", 3, ["first", "suburb", "postcode"], 5)
    return p.near_pairs(super_index(r), r, [*COLS, "source"], [(["first", "suburb", "postcode"], 5)], rule)


_J = [f"jaro_similarity(l_{c}, r_{c})" for c in COLS]


@query(BLOCKS + f"SELECT l, r, round(({' + '.join(_J)}) / 4, 6) AS similarity FROM att WHERE {' AND '.join(x + ' >= 0.8' for x in _J)} AND ({' + '.join(_J)}) / 4 >= 0.9")
def match_mean_jaro(spark, sf_dir):
    return pr.with_jaro(alike(spark, sf_dir, pr.jaro_near(COLS, 0.8), many=False), COLS, 0.8, 0.9, bounded=True).select("l", "r", F.round("similarity", 6).alias("similarity"))


_JS = [f"CAST(floor(jaro_similarity(l_{c}, r_{c}) * 1000 + 1e-9) AS BIGINT)" for c in COLS]


@query(BLOCKS + f"""SELECT l, r, round(CASE WHEN {' AND '.join(x + ' >= 0.8' for x in _J)} THEN ({' + '.join(_J)}) / 4 ELSE 0 END, 6) AS mean_or_zero,
  CAST(floor(CASE WHEN {' AND '.join(x + ' >= 800' for x in _JS)} AND ({' + '.join(_JS)}) / 4 >= 900 THEN ({' + '.join(_JS)}) / 4 ELSE 0 END) AS BIGINT) AS thousandths FROM att""")
def pair_similarity(spark, sf_dir):
    j = [m.jaro(f"l_{c}", f"r_{c}") for c in COLS]
    # most pairs are 0 by their signatures and never meet the UDF; both parts read one shuffle
    far = alike(spark, sf_dir, ~pr.jaro_near(COLS, 0.8)).select("l", "r", F.lit(0.0).alias("mean_or_zero"), F.lit(0).cast("long").alias("thousandths"))
    near = alike(spark, sf_dir, pr.jaro_near(COLS, 0.8))
    return near.select("l", "r", F.round(pr.similarity_or_zero(j, [0.8] * 4), 6).alias("mean_or_zero"), pr.scaled_similarity(j, [800] * 4, 900).alias("thousandths")).unionAll(far)


@query(BLOCKS + f"SELECT l, r FROM att WHERE {' AND '.join(x + ' >= 0.8' for x in _J)} AND ({' + '.join(_J)}) / 4 >= 0.85")
def match_thresholded_jaro(spark, sf_dir):
    return alike(spark, sf_dir, pr.jaro_near(COLS, 0.8), many=False).where(pr.thresholded_jaro(COLS, 0.8, 0.85)).select("l", "r")


@query(BLOCKS + f"SELECT l, r FROM att WHERE {' AND '.join(x + ' >= 0.9' for x in _J)}")
def match_each_jaro(spark, sf_dir):
    return pr.with_jaro(alike(spark, sf_dir, pr.jaro_near(COLS, 0.9), many=False), COLS, 0.9, bounded=True).select("l", "r")


@query(BLOCKS + f"SELECT l, r, {_SUM} AS total, CASE WHEN {_SUM} > 5 THEN 99 ELSE {_SUM} END AS capped FROM att")
def pair_distance(spark, sf_dir):
    return candidates(spark, sf_dir).select("l", "r", pr.total_distance(COLS).alias("total"), pr.total_distance(COLS, 5).alias("capped"))


_HEADLESS = UNIQUE + """, keyed AS (SELECT rec_idx, last || first || suburb || postcode AS k FROM uniq),
keys AS (SELECT rec_idx, k FROM keyed UNION SELECT rec_idx, substr(k, 2) FROM keyed), firsts AS (SELECT k, min(rec_idx) AS l FROM keys GROUP BY k),
edges AS (SELECT DISTINCT l, rec_idx AS r FROM keys JOIN firsts USING (k) WHERE rec_idx > l)
"""


def _headless(spark, sf_dir):
    return p.headless_edges(unique(spark, sf_dir).withColumn("k", F.concat("last", "first", "suburb", "postcode")), "k")


@query(_HEADLESS + "SELECT l, r FROM edges")
def headless_edges(spark, sf_dir):
    return _headless(spark, sf_dir)


#: All pairs of unique records whose keys, with a mark after each attribute, agree without the first character of one or both.
_MARKED = """, marked AS (SELECT rec_idx, last || '#' || first || '#' || suburb || '#' || postcode || '#' AS k FROM uniq),
mkeys AS (SELECT rec_idx, k FROM marked UNION SELECT rec_idx, substr(k, 2) FROM marked),
headless AS (SELECT DISTINCT x.rec_idx AS l, y.rec_idx AS r FROM mkeys x JOIN mkeys y USING (k) WHERE x.rec_idx < y.rec_idx)
"""


@query(_HEADLESS + _MARKED + "SELECT l, r FROM headless JOIN uniq a ON a.rec_idx = l JOIN uniq b ON b.rec_idx = r WHERE levenshtein(a.first, b.first) + levenshtein(a.last, b.last) + levenshtein(a.suburb, b.suburb) + levenshtein(a.postcode, b.postcode) <= 1")
def headless_checked(spark, sf_dir):
    u = unique(spark, sf_dir)
    return p.candidate_pairs(p.headless_index(u, ["last", "first", "suburb", "postcode"]), u, COLS).where(pr.sum_within(COLS, 1)).select("l", "r")


@query(PLANTED + "SELECT a.rec_idx AS l, b.rec_idx AS r FROM planted a JOIN planted b ON a.first = b.first AND a.postcode = b.postcode WHERE a.source = 0 AND b.source = 1")
def shared_attributes(spark, sf_dir):
    r = planted(spark, sf_dir)
    return p.shared_attributes(r.where("source = 0"), r.where("source = 1"), ["first", "postcode"])


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_records(spark, sf_dir):
    ids = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return p.lookup(ids, read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    return p.only(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# components and clusters ---------------------------------------------------------------------------------------------

SPEC = LinkageSpec(compare=COLS, block="last", total=1)
_COMP = _HEADLESS + _MARKED + f""", blocks AS (SELECT rec_idx AS rec, substr(last, 1, 1) || '|' || k AS block FROM (SELECT rec_idx, last, unnest({SLIDING}) AS k FROM uniq)),
cand AS (SELECT DISTINCT x.rec AS l, y.rec AS r FROM blocks x JOIN blocks y ON x.block = y.block AND x.rec < y.rec UNION SELECT l, r FROM headless),
good AS (SELECT l, r FROM cand JOIN uniq a ON a.rec_idx = l JOIN uniq b ON b.rec_idx = r
  WHERE levenshtein(a.first, b.first) + levenshtein(a.last, b.last) + levenshtein(a.suburb, b.suburb) + levenshtein(a.postcode, b.postcode) <= 1),
both_ways AS (SELECT l AS a, r AS b FROM good UNION SELECT r, l FROM good),
reach(node, seen) AS (SELECT rec_idx, rec_idx FROM uniq UNION SELECT both_ways.b, seen FROM reach JOIN both_ways ON both_ways.a = node),
label AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
linked AS (SELECT p.rec_idx AS rec, component FROM planted p JOIN uniq USING (first, last, suburb, postcode) JOIN label ON node = uniq.rec_idx)
"""


@query(_COMP + "SELECT node, component FROM label WHERE node IN (SELECT l FROM good UNION SELECT r FROM good)")
def components(spark, sf_dir):
    return connected_components(linkage.edges(planted(spark, sf_dir), SPEC), "l", "r")


@query(_COMP + "SELECT rec, component FROM linked")
def components_with_dups(spark, sf_dir):
    return linkage.link(planted(spark, sf_dir), SPEC)


@query(_COMP + "SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM linked GROUP BY component) GROUP BY size")
def component_sizes(spark, sf_dir):
    return gr.size_histogram(linkage.link(planted(spark, sf_dir), SPEC), "component")


def _nodes(spark, sf_dir) -> DataFrame:
    return materialize(linkage.link(planted(spark, sf_dir), SPEC).select(F.col("rec").alias("node"), "component"), "nodes")


def _refined(spark, sf_dir, method: str, rule, weight, cols=COLS, with_source: bool = False, **options) -> DataFrame:
    r = planted(spark, sf_dir)
    nodes = _nodes(spark, sf_dir)
    met = rf.component_pairs(r, nodes, cols, rule, weight)
    sources = r.select(F.col("rec_idx").alias("rec"), "source") if with_source else None
    return rf.refine(met, nodes, method, sources, **options)


#: Matching pairs of all records of a component, and the records of each component in order.
_MET = _COMP + """, part AS (SELECT component, list_sort(list(rec)) AS nodes FROM linked GROUP BY component),
pair AS (SELECT x.component, x.rec AS a, y.rec AS b FROM linked x JOIN linked y ON x.component = y.component AND x.rec <> y.rec JOIN planted p ON p.rec_idx = x.rec JOIN planted q ON q.rec_idx = y.rec
  WHERE levenshtein(p.first, q.first) + levenshtein(p.last, q.last) + levenshtein(p.suburb, q.suburb) + levenshtein(p.postcode, q.postcode) <= 1),
beside AS (SELECT l.rec AS node, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near FROM linked l LEFT JOIN pair ON a = l.rec GROUP BY l.rec)
"""


@query(_MET + """, turn(free, taken) AS (SELECT nodes, CAST([] AS BIGINT[]) FROM part
  UNION ALL SELECT list_filter(free, lambda x: x <> free[1] AND NOT list_contains(near, x)), list_filter(free, lambda x: x = free[1] OR list_contains(near, x)) FROM turn JOIN beside ON node = free[1] WHERE len(free) > 0)
SELECT unnest(taken) AS rec, taken[1] AS cluster FROM turn WHERE len(taken) > 0""")
def star_clusters(spark, sf_dir):
    return _refined(spark, sf_dir, "star", pr.sum_within(COLS, 1), pr.total_distance(COLS))


# one record at a time: it joins what is taken if it matches all of it, else it waits for a later turn
@query(_MET + """, turn(todo, taken, later, done) AS (SELECT nodes[2:], nodes[1:1], CAST([] AS BIGINT[]), false FROM part
  UNION ALL SELECT CASE WHEN len(todo) > 0 THEN todo[2:] ELSE later[2:] END,
    CASE WHEN len(todo) = 0 THEN later[1:1] WHEN len(list_intersect(near, taken)) = len(taken) THEN list_append(taken, todo[1]) ELSE taken END,
    CASE WHEN len(todo) = 0 THEN CAST([] AS BIGINT[]) WHEN len(list_intersect(near, taken)) = len(taken) THEN later ELSE list_append(later, todo[1]) END, len(todo) = 0
  FROM turn LEFT JOIN beside ON node = todo[1] WHERE len(todo) > 0 OR len(later) > 0)
SELECT unnest(taken) AS rec, taken[1] AS cluster FROM turn WHERE len(todo) = 0""")
def clique_clusters(spark, sf_dir):
    return _refined(spark, sf_dir, "clique", pr.sum_within(COLS, 1), pr.total_distance(COLS))


@query()
def agglomerative(spark, sf_dir):
    close = F.lit(1.0) - pr.total_distance(COLS) / F.lit(20.0)
    return _refined(spark, sf_dir, "agglomerative", pr.sum_within(COLS, 1), close)


@query()
def hac(spark, sf_dir):
    return _refined(spark, sf_dir, "complete", pr.sum_within(COLS, 5), pr.total_distance(COLS), limit=1)


@query()
def source_consistent(spark, sf_dir):
    return _refined(spark, sf_dir, "source_consistent", pr.other_source() & pr.sum_within(COLS, 5), pr.total_distance(COLS), [*COLS, "source"], True)


@query()
def knn_complete(spark, sf_dir):
    return _refined(spark, sf_dir, "source_complete", pr.other_source() & pr.sum_within(COLS, 5), pr.total_distance(COLS), [*COLS, "source"], True, nearest=20, repeats=3)


@query(_MET + """, sides AS (SELECT component, least(a, b) AS l, greatest(a, b) AS r, a AS node, row_number() OVER (PARTITION BY a ORDER BY w, least(a, b), greatest(a, b)) AS k FROM (SELECT pair.*,
  levenshtein(p.first, q.first) + levenshtein(p.last, q.last) + levenshtein(p.suburb, q.suburb) + levenshtein(p.postcode, q.postcode) AS w FROM pair JOIN planted p ON p.rec_idx = a JOIN planted q ON q.rec_idx = b))
SELECT DISTINCT component, l, r FROM sides WHERE k <= 2""")
def nearest_two(spark, sf_dir):
    met = rf.component_pairs(planted(spark, sf_dir), _nodes(spark, sf_dir), COLS, pr.sum_within(COLS, 1), pr.total_distance(COLS))
    return rf.nearest_edges(met, 2).select("component", "l", "r")


@query()
def complete_driver(spark, sf_dir):
    r = planted(spark, sf_dir).withColumn("source", F.when(F.col("entity_id") % 3 == 0, F.col("source") % 4).otherwise(F.col("source")))
    spec = LinkageSpec(compare=COLS, block="last", source="source", total=5)
    return linkage.complete_clusters(r, _nodes(spark, sf_dir), spec, 5, pr.sum_within(COLS, 5), pr.total_distance(COLS), nearest=5, refill=True)


@query()
def similar_complete(spark, sf_dir):
    spec = LinkageSpec(compare=COLS, block="last", source="source")
    value = pr.scaled_similarity([m.jaro_winkler(f"l_{c}", f"r_{c}") for c in COLS], [75] * 4, 85, 100)
    return linkage.complete_clusters(planted(spark, sf_dir), _nodes(spark, sf_dir), spec, 5, value > 0, value, "similar_complete", least=85)


@query(_MET + """, turn(free, taken) AS (SELECT nodes, CAST([] AS BIGINT[]) FROM part
  UNION ALL SELECT list_filter(free, lambda x: x <> free[1] AND NOT list_contains(near, x)), list_filter(free, lambda x: x = free[1] OR list_contains(near, x)) FROM turn JOIN beside ON node = free[1] WHERE len(free) > 0),
star AS (SELECT s.rec, cluster, component, last, suburb FROM (SELECT unnest(taken) AS rec, taken[1] AS cluster FROM turn WHERE len(taken) > 0) s JOIN linked l ON l.rec = s.rec JOIN planted p ON p.rec_idx = s.rec),
vote AS (SELECT s.rec, h.cluster, h.n * 200 AS v FROM star s JOIN (SELECT component, cluster, last, count(*) AS n FROM star GROUP BY ALL) h USING (component, last)
  UNION ALL SELECT s.rec, h.cluster, h.n * 100 FROM star s JOIN (SELECT component, cluster, suburb, count(*) AS n FROM star GROUP BY ALL) h USING (component, suburb)),
total AS (SELECT rec, cluster, sum(v) AS v FROM vote GROUP BY rec, cluster)
SELECT rec, total.cluster AS cluster FROM total JOIN star USING (rec) QUALIFY row_number() OVER (PARTITION BY rec ORDER BY v DESC, (total.cluster = star.cluster) DESC, total.cluster) = 1""")
def moved_by_votes(spark, sf_dir):
    r, nodes = planted(spark, sf_dir), _nodes(spark, sf_dir)
    star = rf.refine(rf.component_pairs(r, nodes, COLS, pr.sum_within(COLS, 1), pr.total_distance(COLS)), nodes, "star")
    c = star.join(apart(nodes.select(F.col("node").alias("rec"), "component")), "rec").select("rec", "component", "cluster")
    return rf.move_by_votes(r, c, ["last", "suburb"]).select("rec", "cluster")


@query(_COMP + f""", few AS (SELECT rec FROM linked WHERE component IN (SELECT component FROM linked GROUP BY component HAVING count(*) <= 4)),
rb AS (SELECT rec_idx AS rec, substr(last, 1, 1) || '|' || k AS block FROM (SELECT rec_idx, last, unnest({SLIDING}) AS k FROM planted)),
met AS (SELECT DISTINCT x.rec AS l, y.rec AS r FROM rb x JOIN rb y ON x.block = y.block AND x.rec < y.rec WHERE x.rec IN (SELECT rec FROM few) OR y.rec IN (SELECT rec FROM few)),
loose AS (SELECT l, r FROM met JOIN planted a ON a.rec_idx = l JOIN planted b ON b.rec_idx = r WHERE levenshtein(a.first, b.first) + levenshtein(a.last, b.last) + levenshtein(a.suburb, b.suburb) + levenshtein(a.postcode, b.postcode) <= 2
  UNION SELECT component, rec FROM linked),
turns AS (SELECT l AS a, r AS b FROM loose UNION SELECT r, l FROM loose), wider(node, seen) AS (SELECT rec, rec FROM linked UNION SELECT turns.b, seen FROM wider JOIN turns ON turns.a = node)
SELECT node AS rec, min(seen) AS component FROM wider GROUP BY node""")
def generalised_pass(spark, sf_dir):
    r = planted(spark, sf_dir)
    c = linkage.link(r, SPEC).withColumnRenamed("component", "cluster")
    return linkage.generalised(r, c, SPEC, 4, pr.sum_within(COLS, 2), 2)


@query(_COMP + """, lines AS (SELECT string_agg(CAST(rec AS VARCHAR), ',' ORDER BY CAST(rec AS VARCHAR)) || ',' AS value FROM linked GROUP BY component) SELECT value FROM lines""")
def cluster_lines(spark, sf_dir):
    return writers.cluster_lines(linkage.link(planted(spark, sf_dir), SPEC).select(F.col("rec").alias("member"), F.col("component").alias("cluster")))


@query(_COMP.replace("uniq AS (SELECT first, last, suburb, postcode,", "uniq AS (SELECT first, last, suburb, postcode,") + """, u AS (SELECT rec, entity_id AS entity, component AS cluster FROM linked JOIN planted ON rec = rec_idx) SELECT cluster, entity, count(*) AS n FROM u GROUP BY cluster, entity""")
def eval_contingency(spark, sf_dir):
    return e.contingency(_rows(spark, sf_dir))


def _rows(spark, sf_dir) -> DataFrame:
    r = planted(spark, sf_dir).select(F.col("rec_idx").alias("rec"), F.col("entity_id").alias("entity"))
    return r.join(linkage.link(planted(spark, sf_dir), SPEC).withColumnRenamed("component", "cluster"), "rec")


_ROWS = _COMP + ", u AS (SELECT rec, entity_id AS entity, component AS cluster FROM linked JOIN planted ON rec = rec_idx), c AS (SELECT cluster, entity, count(*) AS n FROM u GROUP BY cluster, entity)"
_LINKS = _ROWS + """, f AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM c) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM u GROUP BY cluster)) AS found,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM u GROUP BY entity)) AS true_, (SELECT count(*) * (count(*) - 1) // 2 FROM u) AS every),
k AS (SELECT CAST(tp AS BIGINT) AS tp, CAST(found - tp AS BIGINT) AS fp, CAST(true_ - tp AS BIGINT) AS fn, CAST(every - found - true_ + tp AS BIGINT) AS tn FROM f)
"""


@query(_LINKS + "SELECT tp, fp, fn, tn FROM k")
def eval_links(spark, sf_dir):
    return e.links(_rows(spark, sf_dir))


@query(_LINKS + "SELECT tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM k")
def eval_prf(spark, sf_dir):
    return e.scores(_rows(spark, sf_dir))


@query(_ROWS + """, w AS (SELECT entity, count(*) AS whole FROM u GROUP BY entity), t AS (SELECT cluster, count(*) AS entities, count(*) FILTER (n = whole) AS f FROM c JOIN w USING (entity) GROUP BY cluster)
SELECT CASE WHEN entities = 1 AND f = 1 THEN 1 WHEN entities = 1 THEN 2 WHEN f > 0 THEN 3 ELSE 4 END AS type, count(*) AS clusters FROM t GROUP BY 1""")
def eval_types(spark, sf_dir):
    return e.cluster_types(_rows(spark, sf_dir))


@query(_ROWS + ", s AS (SELECT count(*) AS n FROM u GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS clusters, round(avg(n), 6) AS mean_size, round(avg(DISTINCT n), 6) AS mean_distinct_size FROM s")
def eval_sizes(spark, sf_dir):
    return e.sizes(_rows(spark, sf_dir))


@query(PLANTED + """, u AS (SELECT rec_idx AS rec, entity_id AS entity, CAST(entity_id // 3 AS BIGINT) AS cluster FROM planted), m AS (SELECT cluster FROM u GROUP BY cluster HAVING count(*) > 10 AND min(entity) <> max(entity)) SELECT rec, entity, cluster FROM u WHERE cluster IN (SELECT cluster FROM m)""")
def eval_large_mixed(spark, sf_dir):
    r = planted(spark, sf_dir).select(F.col("rec_idx").alias("rec"), F.col("entity_id").alias("entity"), F.floor(F.col("entity_id") / 3).cast("long").alias("cluster"))
    return e.large_mixed(r, 10)


@query(_ROWS + "SELECT count(*) FILTER (one) AS homogeneous, count(*) AS clusters FROM (SELECT min(entity) = max(entity) AS one FROM u GROUP BY cluster)")
def eval_homogeneous(spark, sf_dir):
    return e.homogeneous(_rows(spark, sf_dir))


# diagnostics ---------------------------------------------------------------------------------------------------------

_DIST = PLANTED + ", dist AS (SELECT a.entity_id AS entity, a.rec_idx AS l, b.rec_idx AS r, " + ", ".join(f"levenshtein(a.{c}, b.{c}) AS d_{c}" for c in COLS) + " FROM planted a JOIN planted b ON a.entity_id = b.entity_id AND a.rec_idx < b.rec_idx)\n"


@query(_DIST + "SELECT entity, l, r, d_first, d_last, d_suburb, d_postcode FROM dist")
def intra_entity_dist(spark, sf_dir):
    return d.entity_distances(planted(spark, sf_dir), COLS)


@query(_DIST + ", h AS (SELECT attribute, distance, count(*) AS pairs FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, d_{c} AS distance FROM dist" for c in COLS) + ") GROUP BY attribute, distance) SELECT attribute, distance, pairs, CAST(sum(pairs) OVER (PARTITION BY attribute ORDER BY distance) AS BIGINT) AS up_to FROM h")
def dist_histogram(spark, sf_dir):
    return d.histogram(d.entity_distances(planted(spark, sf_dir), COLS), COLS)


@query(_DIST + "SELECT entity, " + ", ".join(f"max(d_{c}) AS max_{c}" for c in COLS) + " FROM dist GROUP BY entity")
def dist_maxima(spark, sf_dir):
    return d.maxima(d.entity_distances(planted(spark, sf_dir), COLS), COLS)


def _coverage_sql(dist: str, points: list[str], after: str = "SELECT * FROM shares") -> str:
    """The entities whose first record reaches all others over the pairs that meet a condition, for each condition."""
    fit = " UNION ALL ".join(f"SELECT {i} AS point, entity, l, r FROM dist WHERE {x}" for i, x in enumerate(points))
    return dist + f""", fit AS ({fit}), ways AS (SELECT point, entity, l AS a, r AS b FROM fit UNION ALL SELECT point, entity, r, l FROM fit),
size AS (SELECT entity_id AS entity, count(*) AS n, min(rec_idx) AS start FROM planted GROUP BY entity_id), point AS (SELECT CAST(unnest(range({len(points)})) AS INTEGER) AS point),
reached(point, entity, node) AS (SELECT point, entity, start FROM size, point UNION SELECT w.point, w.entity, w.b FROM reached g JOIN ways w ON w.point = g.point AND w.entity = g.entity AND w.a = g.node),
whole AS (SELECT g.point, entity, n FROM (SELECT point, entity, count(*) AS m FROM reached GROUP BY point, entity) g JOIN size USING (entity) WHERE m = n),
counts AS (SELECT point, (SELECT count(*) FROM fit WHERE fit.point = point.point) AS pairs, (SELECT count(*) FROM whole WHERE whole.point = point.point) AS entities,
  CAST((SELECT coalesce(sum(n), 0) FROM whole WHERE whole.point = point.point) AS BIGINT) AS records FROM point),
shares AS (SELECT point, pairs, entities, round(entities / (SELECT count(*) FROM size), 6) AS entity_share, records, round(records / (SELECT sum(n) FROM size), 6) AS record_share FROM counts)
""" + after


GRID = [([a, l, a, z], t) for a in (0, 1) for l in (0, 1, 2) for z in (0, 1) for t in (0, 1, 2)]
_POINTS = [" AND ".join(f"d_{c} <= {x}" for c, x in zip(COLS, lim, strict=True)) + f" AND d_first + d_last + d_suburb + d_postcode <= {t}" for lim, t in GRID]


@query(_coverage_sql(_DIST, _POINTS))
def threshold_grid(spark, sf_dir):
    r = planted(spark, sf_dir)
    return d.grid_coverage(d.entity_distances(r, COLS), COLS, GRID, r)


@query(_coverage_sql(_DIST, _POINTS, "SELECT * FROM shares WHERE entity_share > 0.999 AND record_share > 0.999 ORDER BY point LIMIT 1"))
def threshold_sweep(spark, sf_dir):
    r = planted(spark, sf_dir)
    return d.first_covering(d.grid_coverage(d.entity_distances(r, COLS), COLS, GRID, r), 0.999)


JARO_GRID = [([t, l, t, t], mean) for t in (0.9, 0.75) for l in (0.95, 0.9, 0.85, 0.75) for mean in (0.975, 0.9, 0.75)]
_SIM = PLANTED + ", dist AS (SELECT a.entity_id AS entity, a.rec_idx AS l, b.rec_idx AS r, " + ", ".join(f"round(jaro_similarity(a.{c}, b.{c}), 9) AS s_{c}" for c in COLS) + " FROM planted a JOIN planted b ON a.entity_id = b.entity_id AND a.rec_idx < b.rec_idx)\n"
_SIM_POINTS = [" AND ".join(f"s_{c} >= {x}" for c, x in zip(COLS, lim, strict=True)) + f" AND (s_first + s_last + s_suburb + s_postcode) / 4 > {t}" for lim, t in JARO_GRID]


@query(_coverage_sql(_SIM, _SIM_POINTS))
def jaro_grid(spark, sf_dir):
    r = planted(spark, sf_dir)
    return d.similarity_grid(d.entity_similarities(r, COLS), COLS, JARO_GRID, r)


#: For each entity the last edge of the spanning tree in the order (w, l, r): the first edge up to which all edges join its records.
_TREE = _DIST + """, e AS (SELECT *, d_first + d_last + d_suburb + d_postcode AS w, row_number() OVER (PARTITION BY entity ORDER BY d_first + d_last + d_suburb + d_postcode, l, r) AS k FROM dist),
size AS (SELECT entity_id AS entity, count(*) AS n, min(rec_idx) AS start FROM planted GROUP BY entity_id), ways AS (SELECT entity, k, l AS a, r AS b FROM e UNION ALL SELECT entity, k, r, l FROM e),
reached(entity, upto, node) AS (SELECT e.entity, e.k, size.start FROM e JOIN size USING (entity) UNION SELECT g.entity, g.upto, w.b FROM reached g JOIN ways w ON w.entity = g.entity AND w.a = g.node AND w.k <= g.upto),
last AS (SELECT entity, min(upto) AS k FROM (SELECT entity, upto, count(*) AS m FROM reached GROUP BY entity, upto) JOIN size USING (entity) WHERE m = n GROUP BY entity)
"""


@query(_TREE + """, ok AS (SELECT entity, d_first <= 1 AND d_last <= 1 AND d_suburb <= 1 AND d_postcode <= 1 AND w <= 1 AS ok FROM last JOIN e USING (entity, k))
SELECT count(*) AS entities, count(*) FILTER (coalesce(ok, true)) AS valid, count(*) FILTER (NOT coalesce(ok, true)) AS invalid, CAST(coalesce(sum(n) FILTER (coalesce(ok, true)), 0) AS BIGINT) AS valid_records FROM size LEFT JOIN ok USING (entity)""")
def threshold_validity(spark, sf_dir):
    r = planted(spark, sf_dir)
    return d.threshold_validity(d.entity_distances(r, COLS), COLS, [1, 1, 1, 1], 1, r)


@query(_COMP + """, own AS (SELECT rec, entity_id AS entity, component FROM linked JOIN planted ON rec = rec_idx), per AS (SELECT entity, count(*) AS n, min(component) = max(component) AS joined FROM own GROUP BY entity)
SELECT count(*) AS entities, count(*) FILTER (joined) AS joined_entities, CAST(sum(n) AS BIGINT) AS records, CAST(coalesce(sum(n) FILTER (joined), 0) AS BIGINT) AS joined_records FROM per""")
def blocking_coverage(spark, sf_dir):
    r = planted(spark, sf_dir)
    exact = gr.membership(r, COLS).where("rec <> rep").select(F.col("rep").alias("l"), F.col("rec").alias("r"))
    return d.coverage(linkage.edges(r, SPEC).unionAll(exact), r)


@query(_TREE + "SELECT entity AS component, n AS records, CAST(w AS DOUBLE) AS bottleneck FROM last JOIN e USING (entity, k) JOIN size USING (entity)")
def mst_bottleneck(spark, sf_dir):
    dist = d.entity_distances(planted(spark, sf_dir), COLS)
    return rf.mst_bottlenecks(dist.select(F.col("entity").alias("component"), "l", "r", sum((F.col(f"d_{c}") for c in COLS[1:]), F.col("d_first")).cast("double").alias("w")))


@query(BLOCKS + """, s AS (SELECT CAST(CAST('0x' || substr(md5(block), 1, 15) AS BIGINT) % 16 AS INTEGER) AS chunk, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS comparisons FROM blocks GROUP BY block),
k AS (SELECT chunk, CAST(coalesce(sum(comparisons), 0) AS BIGINT) AS comparisons FROM (SELECT CAST(unnest(range(16)) AS INTEGER) AS chunk) LEFT JOIN s USING (chunk) GROUP BY chunk)
SELECT chunk, comparisons, min(comparisons) OVER () AS least, max(comparisons) OVER () AS most, round(max(comparisons) OVER () / greatest(avg(comparisons) OVER (), 1e-9), 6) AS imbalance FROM k""")
def chunk_balance(spark, sf_dir):
    return d.chunk_balance(b.sizes(super_index(unique(spark, sf_dir))), 16)


# sampling and generators ---------------------------------------------------------------------------------------------


@query(PLANTED + ", ids AS (SELECT entity_id FROM (SELECT DISTINCT entity_id FROM planted) ORDER BY md5(CAST(entity_id AS VARCHAR) || ':0'), entity_id LIMIT 50) SELECT rec_idx, entity_id FROM planted WHERE entity_id IN (SELECT entity_id FROM ids)")
def sample_entities(spark, sf_dir):
    return g.sample_entities(planted(spark, sf_dir), 50).select("rec_idx", "entity_id")


@query(PLANTED + "SELECT rec_idx FROM planted ORDER BY md5(CAST(rec_idx AS VARCHAR) || ':0'), rec_idx LIMIT 100")
def sample_rows(spark, sf_dir):
    return g.sample_rows(planted(spark, sf_dir), 100, "rec_idx").select("rec_idx")


@query(NAMES + """, k AS (SELECT rec_idx, row_number() OVER (ORDER BY rec_idx) - 1 AS row FROM names), c AS (SELECT count(*) AS n FROM names),
d AS (SELECT unnest(range(CAST(floor(0.5 * n * n) AS BIGINT))) AS draw, n FROM c), z AS (SELECT draw, CAST('0x' || substr(md5(draw || ':3:x'), 1, 15) AS BIGINT) % n AS i, CAST('0x' || substr(md5(draw || ':3:y'), 1, 15) AS BIGINT) % n AS j FROM d)
SELECT draw, a.rec_idx AS x, b.rec_idx AS y FROM z JOIN k a ON a.row = i JOIN k b ON b.row = j""")
def random_pairs(spark, sf_dir):
    return p.random_pairs(names(spark, sf_dir), 0.5, 3)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row FROM lineitem")
def number_rows(spark, sf_dir):
    return p.number_rows(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "row")


@query("SELECT c_custkey, copy FROM customer, (SELECT CAST(unnest(range(3)) AS INTEGER) AS copy)")
def exact_copies(spark, sf_dir):
    return g.copies(read(spark, sf_dir, "customer").select("c_custkey"), 3)


@query("SELECT p_partkey, substr(repeat(p_name, 26), 1, 26) AS value FROM part")
def fixed_width(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", g.fixed_width("p_name", 26).alias("value"))


def _edit_sql(table: str, col: str, k: int, key: str) -> str:
    """One drawn edit of a column, in SQL; `key` is the string that seeds it."""
    h = lambda what: f"CAST('0x' || substr(md5({key} || ':{k}:{what}'), 1, 15) AS BIGINT)"
    letters = "'abcdefghijklmnopqrstuvwxyz'"
    return f"""SELECT * EXCLUDE (kind, place) REPLACE (CASE kind WHEN 0 THEN substr({col}, 1, place) || substr({letters}, CAST({h("letter")} % 26 AS INTEGER) + 1, 1) || substr({col}, place + 1)
  WHEN 1 THEN substr({col}, 1, place) || substr({col}, place + 2)
  ELSE substr({col}, 1, place) || substr({letters}, CAST((greatest(strpos({letters}, substr({col}, place + 1, 1)), 1) + {h("other")} % 25) % 26 AS INTEGER) + 1, 1) || substr({col}, place + 2) END AS {col})
FROM (SELECT *, CAST({h("place")} % (length({col}) + CASE kind WHEN 0 THEN 1 ELSE 0 END) AS INTEGER) AS place FROM (SELECT *, CASE WHEN length({col}) = 0 THEN 0 ELSE {h("kind")} % 3 END AS kind FROM {table}))"""


_EDITED = "WITH o AS (SELECT c_custkey, c_name, c_name || ':0' AS k FROM customer), a AS (" + _edit_sql("o", "c_name", 0, "k") + "), b AS (" + _edit_sql("a", "c_name", 1, "k") + ")\n"


@query(_EDITED + """, p AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS s FROM customer),
q AS (SELECT c_custkey, s, list_sort([{h: md5(s || ':0:' || i), i: i} FOR i IN range(1, 9)])[1:2] AS c FROM p),
z AS (SELECT c_custkey, list_aggregate([CASE WHEN list_contains([x.i FOR x IN c], i) THEN substr('0123456789', CAST((strpos('0123456789', substr(s, i, 1)) + CAST('0x' || substr(md5(s || ':0:' || i || ':by'), 1, 15) AS BIGINT) % 9) % 10 AS INTEGER) + 1, 1)
  ELSE substr(s, i, 1) END FOR i IN range(1, 9)], 'string_agg', '') AS dob FROM q),
m AS (SELECT c_custkey, list_aggregate([CASE WHEN CAST('0x' || substr(md5(c_name || ':0:' || i || ':in'), 1, 15) AS BIGINT) % 1000 < 300 THEN CAST(CAST('0x' || substr(md5(c_name || ':0:' || i || ':digit'), 1, 15) AS BIGINT) % 10 AS VARCHAR) ELSE '' END
  || substr(c_name, i, 1) FOR i IN range(1, length(c_name) + 1)], 'string_agg', '') AS mixed FROM customer)
SELECT c_custkey, a.c_name AS one, b.c_name AS two, dob, mixed FROM a JOIN b USING (c_custkey) JOIN z USING (c_custkey) JOIN m USING (c_custkey)""")
def edited_strings(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.select("c_custkey", *[F.col("c_name").alias(x) for x in ("one", "two", "mixed")], F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("dob"))
    return g.with_digits(g.with_digit_edits(g.with_edits(g.with_edits(c, "one", 1), "two", 2), "dob", 2), "mixed").select("c_custkey", "one", "two", "dob", "mixed")


@query()
def k_distant(spark, sf_dir):
    r = planted(spark, sf_dir).where("source = 0").select("entity_id", F.col("last").alias("name"), F.lpad(F.col("entity_id").cast("string"), 8, "0").alias("dob"))
    return g.k_distant(r, "name", ["dob"])


@query("""SELECT id, list_aggregate([substr('abcde', CAST(CAST('0x' || substr(md5(id || ':0:' || i), 1, 15) AS BIGINT) % 5 AS INTEGER) + 1, 1) FOR i IN range(1, 26)], 'string_agg', '') AS value FROM (SELECT unnest(range(1000)) AS id)""")
def random_strings(spark, sf_dir):
    return g.random_strings(spark, 1000, 25, 5)


@query("SELECT count(*) AS strings, min(length(p_name)) AS min_len, max(length(p_name)) AS max_len, round(avg(length(p_name)), 6) AS mean_len FROM part")
def string_stats(spark, sf_dir):
    from .sources.readers import string_stats as stats

    return stats(read(spark, sf_dir, "part"), "p_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
