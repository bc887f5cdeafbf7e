"""Readers. Every reader declares its columns, gives strings, and puts '' for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.normalize import strip_digits_punct, strip_punct, text
from ..operators.pairs import number_rows
from ..spec import LinkageSpec


def _filled(df: DataFrame) -> DataFrame:
    return df.select(*[text(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])


def delimited(spark: SparkSession, path: str | list[str], layout: StructType, sep: str = ",", header: bool = False) -> DataFrame:
    """A delimited file without quoting; missing fields at a line's end are empty."""
    return _filled(spark.read.csv(path, schema=layout, sep=sep, header=header, quote="", mode="PERMISSIVE"))


def cleaned(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lower case without punctuation, in all string columns or those named."""
    return df.select(*[strip_punct(c).alias(c) if (columns is None and df.schema[c].dataType == StringType()) or (columns and c in columns) else F.col(c) for c in df.columns])


def name_cleaned(df: DataFrame, name: str, keep: int = 4) -> DataFrame:
    """The first `keep` columns, the name without digits and punctuation in lower case, the others raw."""
    return df.select(*[strip_digits_punct(c).alias(c) if c == name else F.col(c) for c in df.columns[:keep]])


def block_first(df: DataFrame, block: str) -> DataFrame:
    """The blocking column behind the id, cleaned."""
    first, rest = df.columns[0], [c for c in df.columns[1:] if c != block]
    return df.select(first, strip_digits_punct(block).alias(block), *rest)


def merged(a: DataFrame, b: DataFrame, first: str, last: str, name: str = "name") -> DataFrame:
    """Two tables under each other, with the joined names in lower case."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.lower(F.concat(text(first), text(last)))).drop(first, last)


def _placed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with where they stand: file, start of the split in it, and the place in the split. Spark deals splits by size, so their numbers do not follow the files."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def number_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (line_no, value): lines numbered from 0 in the order of files and of lines in them."""
    return number_rows(_placed(spark, path), "file", "start", "place").select(F.col("row").alias("line_no"), "value")


def clusters_by_line(spark: SparkSession, path: str, member: str = "member") -> DataFrame:
    """Rows (cluster, member) from lines of members with a comma after each."""
    lines = number_lines(spark, path).where("length(trim(value)) > 0")
    parts = F.filter(F.split("value", ","), lambda x: F.trim(x) != "")
    return lines.select(F.col("line_no").alias("cluster"), F.explode(F.transform(parts, F.trim)).alias(member))


def clusters_by_headers(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """Rows (file, cluster, fields) from blocks of lines, each under a line 'cluster n:' or behind an empty line; clusters count from 0 or 1 in each file."""
    lines = _placed(spark, path)
    head = F.lower("value").rlike(r"^\s*cluster\s*\d+\s*:?\s*$") | (F.trim("value") == "")
    w = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # cluster files, not a corpus
    marked = lines.withColumn("cluster", F.sum(head.cast("long")).over(w)).where(~head)
    return marked.select("file", "cluster", F.split("value", sep).alias("fields"))


def clusters_by_id(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Rows (cluster, fields) from a table with a header whose first column is the cluster's id, as linkage libraries write predictions."""
    rows = spark.read.csv(path, sep=sep, header=True)
    first, rest = rows.columns[0], rows.columns[1:]
    return rows.select(F.col(first).alias("cluster"), F.array(*[F.coalesce(c, F.lit("")) for c in rest]).alias("fields"))


def whitespace(spark: SparkSession, path: str | list[str], names: list[str], min_length: int = 10, row_cap: int | None = None) -> DataFrame:
    """Lines longer than `min_length`, cut at white space; `row_cap` rows of each file where it is set."""
    files = [path] if isinstance(path, str) else path
    out = None
    for f in files:
        rows = spark.read.text(f).where(F.length("value") > min_length)
        rows = rows.limit(row_cap) if row_cap else rows
        parts = F.split(F.trim("value"), r"\s+")
        part = rows.select(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part)
    return out


def mapped(spark: SparkSession, spec: LinkageSpec, names: list[str], sep: str = "\t") -> DataFrame:
    """The datasets of a configuration in one table. Place i of a dataset's map is where it keeps attribute i, -1 where it has none; each
    row also has its file and the dataset's number."""
    out = None
    for i, (path, places) in enumerate(zip(spec.files, spec.attribute_maps, strict=True)):
        rows = spark.read.text(path)
        rows = rows.limit(spec.row_cap) if spec.row_cap else rows
        parts = F.split("value", sep)
        cols = [F.lower(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(p + 1)), F.lit("")), r"\s", "")) if p >= 0 else F.lit("") for p in places]
        part = rows.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], F.lit(path).alias("file"), F.lit(i).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("value"))


def string_stats(df: DataFrame, col: str = "value") -> DataFrame:
    """One row: strings, and the least, greatest and mean length."""
    n = F.length(text(col))
    return df.agg(F.count("*").alias("strings"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"))


def genome_windows(spark: SparkSession, path: str, size: int = 900) -> DataFrame:
    """Rows (window, value): a FASTA sequence cut into windows of `size` letters; a shorter rest is left out."""
    whole = spark.read.text(path, wholetext=True)
    seq = F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ""), r"\s", "")
    n = F.floor(F.length("seq") / size).cast("int")
    # cut within the row, so that no window carries the whole sequence
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.col("seq").substr(i * size + 1, F.lit(size))))
    return whole.select(seq.alias("seq")).where(n > 0).select(F.posexplode(cut).alias("window", "value"))


def gene_locations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (start, stop, complement) of the gene lines of a GenBank file."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s+gene\s"))
    at = lambda i: F.regexp_extract("value", r"(\d+)\.\.>?(\d+)", i).cast("long")
    return lines.select(at(1).alias("start"), at(2).alias("stop"), F.col("value").contains("complement").alias("complement")).where("start is not null")
