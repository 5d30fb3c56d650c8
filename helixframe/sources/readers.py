"""Reads of sequences: FASTA, FASTQ and raw lines, as DataFrames.

Reference sequences have name and seq; reads have ord, tag, seq and qscore.  Both FASTA readers take records of
several lines and drop carriage returns.  A record that is wrong raises when it is reached (``strict``), or is
kept with what is wrong in ``_corrupt`` (``permissive``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FASTA, FASTQ, RAW = "fasta", "fastq", "raw"
#: What one micro-batch or scan takes at most by default.
CHUNK_BYTES = 256 * 1024 * 1024
READ = "ord bigint, tag string, seq string, qscore string"


def _lines(spark: SparkSession, path: str, separator: str | None = None, wanted: Column | None = None) -> DataFrame:
    """value, and file, block and id, whose order is the order of lines; only the wanted lines have an id."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path)
    lines = lines if wanted is None else lines.filter(wanted)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _numbered(lines: DataFrame, out: str) -> DataFrame:
    """What _lines gives with 0, 1, ... in the order of lines.

    A block is read by one task in order, so its ids leave none out: only blocks are counted and summed, and no line is moved.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    lifts = blocks.select("file", "block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__lift"))
    return lines.join(F.broadcast(lifts), ["file", "block"]).withColumn(out, F.col("__lift") + F.col("id")).drop("__lift")


def _checked(df: DataFrame, problem: Column, mode: str) -> DataFrame:
    if mode == "permissive":
        return df.withColumn("_corrupt", problem)
    if mode != "strict":
        raise ValueError(f"mode must be strict or permissive, not {mode!r}")
    return df.filter(F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.lit(True)).cast("boolean"))


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file by its first character: @ FASTQ, > FASTA, else raw lines."""
    first = spark.read.text(path).limit(1).collect()
    start = first[0].value[:1] if first else ""
    return {"@": FASTQ, ">": FASTA}.get(start, RAW)


def _fasta_parts(value: Column) -> tuple[Column, Column]:
    """Header and sequence of a record, without its >."""
    record = F.regexp_replace(value, "\r", "")
    header = F.regexp_replace(F.split_part(record, F.lit("\n"), F.lit(1)), "^>", "")
    body = F.when(F.instr(record, "\n") > 0, F.regexp_replace(record, r"\A[^\n]*\n", "")).otherwise("")
    return header, F.regexp_replace(body, "\n", "")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "\n>", F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")


def read_fasta(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """seq_id (0, 1, ...), name, seq. A name is the header's first word; it must not be empty or occur twice."""
    header, seq = _fasta_parts(F.col("value"))
    name = F.split_part(F.ltrim(header), F.lit(" "), F.lit(1))
    rows = _numbered(_records(spark, path), "seq_id")
    start = F.when((F.col("seq_id") == 0) & ~F.startswith("value", F.lit(">")), "the file doesn't begin with >")
    rows = rows.select("seq_id", name.alias("name"), seq.alias("seq"), start.alias("__start"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    rows = rows.withColumn("__twice", twice)
    problem = F.coalesce(F.col("__start"), F.when(F.col("name") == "", "a sequence has no name"), F.when(F.col("__twice"), F.concat(F.lit("repeated name: "), "name")))
    checked = _checked(rows, problem, mode)
    return checked.select("seq_id", "name", "seq", *(["_corrupt"] if mode == "permissive" else []))


def _read_checks(df: DataFrame, more: Column, mode: str) -> DataFrame:
    problem = F.coalesce(
        more,
        F.when(F.coalesce(F.col("seq"), F.lit("")) == "", F.concat(F.lit("no sequence in record "), F.col("ord").cast("string"))),
        F.when(F.length("qscore") != F.length("seq"), F.concat(F.lit("quality and sequence differ in length in record "), F.col("ord").cast("string"))),
    )
    checked = _checked(df, problem, mode)
    return checked.select("ord", "tag", "seq", "qscore", *(["_corrupt"] if mode == "permissive" else []))


def read_query_fasta(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Reads of a FASTA file: the tag is the whole header."""
    header, seq = _fasta_parts(F.col("value"))
    rows = _numbered(_records(spark, path), "ord")
    start = F.when((F.col("ord") == 0) & ~F.startswith("value", F.lit(">")), "the file doesn't begin with >")
    rows = rows.select("ord", header.alias("tag"), seq.alias("seq"), F.lit(None).cast("string").alias("qscore"), start.alias("__start"))
    return _read_checks(rows, F.col("__start"), mode)


def read_fastq(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Reads of a FASTQ file, framed by four lines (a quality line may begin with @)."""
    lines = _numbered(_lines(spark, path), "n").withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    # blank lines at the end are no record
    part = F.col("n") % 4
    at = lambda k: F.max(F.when(part == k, F.col("value")))
    rows = lines.groupBy((F.col("n") - part).alias("first")).agg(F.count(F.lit(1)).alias("lines"), at(0).alias("head"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qscore"))
    rows = rows.filter(~((F.coalesce("head", F.lit("")) == "") & (F.coalesce("seq", F.lit("")) == "") & (F.coalesce("qscore", F.lit("")) == "")))
    rows = rows.select((F.col("first") / 4).cast("bigint").alias("ord"), F.expr("substring(head, 2)").alias("tag"), "seq", "qscore", "lines", "head")
    problem = F.coalesce(
        F.when(F.col("lines") < 4, F.concat(F.lit("incomplete record "), F.col("ord").cast("string"))),
        F.when(~F.startswith("head", F.lit("@")), F.concat(F.lit("no @ in record "), F.col("ord").cast("string"))),
    )
    return _read_checks(rows, problem, mode)


def read_raw(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """A read per line; the tag is the number of the line, from 1."""
    lines = _numbered(_lines(spark, path), "ord").withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    rows = raw_reads(lines, "ord", "value").filter(F.col("seq") != "")
    return _read_checks(rows, F.lit(None).cast("string"), mode)


def raw_reads(lines: DataFrame, ord_col: str, text_col: str) -> DataFrame:
    """Lines that are numbered already, as reads."""
    return lines.select(F.col(ord_col).cast("bigint").alias("ord"), (F.col(ord_col) + 1).cast("string").alias("tag"), F.col(text_col).alias("seq"), F.lit(None).cast("string").alias("qscore"))


def read_queries(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Reads of a file in whichever format it begins with."""
    return {FASTA: read_query_fasta, FASTQ: read_fastq, RAW: read_raw}[sniff(spark, path)](spark, path, mode)


def new_reads(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Checks rows that were made elsewhere: a sequence is needed, and a quality of its length or none."""
    return _read_checks(df, F.lit(None).cast("string"), mode)


def write_sequences(reads: DataFrame, path: str) -> None:
    """The sequences of reads as lines of text, in order."""
    reads.orderBy("ord").select("seq").write.text(path)
