"""Reads as a stream: each micro-batch takes whole files up to a budget of bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import running_total, saved
from ..sources.readers import CHUNK_BYTES, FASTA, FASTQ, RAW, _fasta_parts

#: Records of which one task follows the pointers at once.
SEGMENT = 1 << 17


def stream_reads(spark: SparkSession, folder: str, form: str, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """file, ord (in its file), tag, seq, qscore and _corrupt of files that arrive in a folder.

    A file is one unit, so its records can be numbered without state.
    """
    if form not in (FASTA, FASTQ, RAW):
        raise ValueError(f"unknown format {form!r}")
    files = spark.readStream.option("maxBytesPerTrigger", max_bytes).text(folder, wholetext=True)
    text = F.regexp_replace("value", "\r", "")
    files = files.select(F.col("_metadata.file_path").alias("file"), text.alias("text"))
    none = F.lit(None).cast("string")
    if form == FASTA:
        records = files.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\A>", ""), "\n>")).alias("ord", "record"))
        header, seq = _fasta_parts(F.col("record"))
        rows = records.select("file", "ord", header.alias("tag"), seq.alias("seq"), none.alias("qscore"), none.alias("_corrupt"))
    elif form == FASTQ:
        lines = F.split(F.regexp_replace("text", r"\n+\z", ""), "\n")
        framed = files.select("file", lines.alias("l")).select("file", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int"))).alias("ord"))
        line = lambda k: F.get("l", F.col("ord") * 4 + k)
        whole = line(3).isNotNull() & F.startswith(line(0), F.lit("@")) & (F.length(line(3)) == F.length(line(1)))
        rows = framed.select("file", "ord", F.substring(line(0), F.lit(2), F.length(line(0))).alias("tag"), line(1).alias("seq"), line(3).alias("qscore"), F.when(whole, none).otherwise("not a whole record").alias("_corrupt"))
    else:
        lines = files.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n")).alias("ord", "seq"))
        rows = lines.select("file", "ord", (F.col("ord") + 1).cast("string").alias("tag"), "seq", none.alias("qscore"), none.alias("_corrupt"))
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def record_bytes(form: str):
    """The bytes of a record's lines without their ends: header and sequence, and of FASTQ the plus and the quality too."""
    octets = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    if form == RAW:
        return octets("seq")
    header = octets("tag") + 1 + octets("seq")
    return header if form == FASTA else header + 1 + octets("qscore")


def chunked(reads: DataFrame, form: str, max_bytes: int = CHUNK_BYTES, stream: list[str] | None = None) -> DataFrame:
    """reads with chunk (0, 1, ...): a chunk takes records in order until their bytes reach the budget, so it ends with the
    record that does. `stream` are the columns that tell inputs apart (default: `file`, if there is one), each with chunks of its own.

    Where a chunk begins depends on all before it, but from each record it is known where the next chunk would begin if one
    began there: at the first record that has the budget's bytes more before it. Those pointers are counts over range
    partitions. Records are then cut by number into segments of SEGMENT, and in each the pointers are followed until they leave it.
    What they lead to is few records, or the chunks are few; those that are reached from the first record are found by
    pointers of 1, 2, 4, ... segments. Each segment is entered at one record at most, from which its chunks follow. No task
    holds more than a segment at once, every step but the rounds runs once, and there is a round for each doubling of the segments.
    """
    if max_bytes < 1:
        raise ValueError("the budget is a byte at least")
    keys = [c for c in ("file",) if c in reads.columns] if stream is None else stream
    sizes = reads.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("ord").cast("bigint").alias("ord"), record_bytes(form).cast("bigint").alias("size"))
    own = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    if not keys:
        sizes = sizes.withColumn("__k0", F.lit(0))
    numbers = _chunk_numbers(sizes, own, max_bytes)
    same = [F.col(f"__of.{k}").eqNullSafe(F.col(f"__in.{c}")) for k, c in zip(own, keys)]
    found = reads.alias("__in").join(numbers.alias("__of"), [F.col("__in.ord").cast("bigint") == F.col("__of.ord"), *same])
    return found.select("__in.*", "__of.chunk")


def _exits(table: pa.Table) -> pa.Table:
    """id, to of a segment: id and exit, the first pointer beyond the segment that its pointers lead to."""
    table = table.sort_by("id")
    ids, to = table["id"].to_numpy(), table["to"].to_numpy()
    then = np.searchsorted(ids, to)
    last = np.where(then < len(ids), then, np.arange(len(ids)))
    while not np.array_equal(further := last[last], last):
        last = further
    return pa.table({"id": ids, "exit": to[last]})


def _numbered(table: pa.Table, marks: pa.Table) -> pa.Table:
    """A segment's records with n, how many chunks have begun in it, and from, the n of the last first record of an input in it.

    marks (id, first): first records, and the record where the segment is entered, if it is.
    """
    table = table.sort_by("id")
    ids, then = table["id"].to_numpy(), np.searchsorted(table["id"].to_numpy(), table["to"].to_numpy()).tolist()
    first = marks["first"].to_numpy().astype(bool)
    entries, firsts = (np.searchsorted(ids, marks["id"].to_numpy()[x]) for x in (~first, first))
    begins = np.zeros(len(ids), np.int64)
    for at in entries.tolist():
        while at < len(ids):
            begins[at] = 1
            at = then[at]
    n, since = np.cumsum(begins), np.zeros(len(ids), np.int64)  # n is 1 at least at a first record
    since[firsts] = n[firsts]
    since = np.maximum.accumulate(since)
    return table.drop_columns(["id", "to"]).append_column("n", pa.array(n)).append_column("from", pa.array(since, mask=since == 0))


def _chunk_numbers(sizes: DataFrame, keys: list[str], max_bytes: int, segment: int = SEGMENT) -> DataFrame:
    """keys, ord, chunk of rows (keys, ord, size)."""
    placed = running_total(sizes, [*keys, "ord"], "size", "at")
    # a record and the place where the chunk that begins with it is full; a record's number is how many records stand before
    marks = placed.select(*keys, "ord", F.explode(F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("is")), F.struct((F.col("at") + max_bytes).alias("at"), F.lit(0).alias("is")))).alias("m")).select(*keys, "ord", "m.*")
    counted = running_total(marks, [*keys, "at", "is", "ord"], F.col("is"), "n")
    by = counted.groupBy(*keys, "ord").agg(F.max(F.when(F.col("is") == 1, F.col("n"))).alias("id"), F.max(F.when(F.col("is") == 0, F.col("n"))).alias("to"))
    part = F.floor(F.col("id") / segment).alias("part")
    rows = saved(by.select(part, *keys, "ord", "id", "to"))
    firsts = rows.groupBy(*keys).agg(F.min("id").alias("id")).select("id")
    # the last chunk of an input leads to the first record of the next, so that all are reached from the very first
    begin = saved(rows.agg(F.min("id").alias("id")).filter("id is not null"))
    exits = saved(rows.groupBy("part").applyInArrow(lambda key, t: _exits(t.select(["id", "to"])), "id bigint, exit bigint"))
    nodes = exits.select(F.col("exit").alias("id")).unionByName(begin).distinct()
    jumps = steps = saved(exits.join(nodes, "id").select("id", F.col("exit").alias("to")))
    reached, size = begin, begin.count()
    while True:
        more = reached.join(jumps, "id").select(F.col("to").alias("id")).join(steps.select("id"), "id", "left_semi")
        reached = saved(reached.unionByName(more).distinct())
        size, before = reached.count(), size
        if size == before:
            break
        jumps = saved(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
    told = reached.withColumn("first", F.lit(False)).unionByName(firsts.withColumn("first", F.lit(True))).select(part, "id", "first")
    kinds = T.StructType([f for f in rows.schema if f.name not in ("id", "to")] + [T.StructField("n", T.LongType()), T.StructField("from", T.LongType())])
    each = saved(rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_numbered, kinds))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    lifts = each.groupBy("part").agg(F.max("n").alias("n"), F.max("from").alias("from")).select("part", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lifts = lifts.select("part", "base", F.last(F.col("base") + F.col("from"), ignorenulls=True).over(before).alias("origin"))
    chunk = F.col("base") + F.col("n") - F.coalesce(F.col("base") + F.col("from"), F.col("origin"))
    return each.join(F.broadcast(lifts), "part").select(*keys, "ord", chunk.alias("chunk"))


def chunk_counts(chunks: DataFrame, stream: list[str] | None = None) -> DataFrame:
    """chunk and n, its reads, of reads with chunks; by `stream`, the columns that tell inputs apart, as in chunked."""
    keys = [c for c in ("file",) if c in chunks.columns] if stream is None else stream
    return chunks.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"))


def process_stream(reads: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls work(batch, number) for each chunk of a stream of reads until the files there are have been read."""
    return reads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_chunks(reads: DataFrame, path: str, checkpoint: str, mapped: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes each chunk of a stream of reads below path: seq, a folder of lines for each chunk, and counts (chunk, n).

    With `mapped`, which makes rows of a chunk's reads (such as places, by map_reads with the index's sequences, which are read
    anew for each chunk and so may be as large as they are), those are written instead, as Parquet. Reads are counted while
    they are written. A chunk that is tried again replaces what it wrote.
    """

    def work(batch: DataFrame, number: int) -> None:
        seen = Observation()
        counted = lambda rows: rows.observe(seen, F.count(F.lit(1)).alias("n"))  # noqa: E731  last before the write: a sort reads what is below it twice
        if mapped is None:
            counted(batch.orderBy("file", "ord").select("seq")).write.mode("overwrite").text(f"{path}/seq/chunk={number}")
        else:
            kept = f"{path}/reads/chunk={number}"
            counted(batch).write.mode("overwrite").parquet(kept)
            mapped(batch.sparkSession.read.parquet(kept)).write.mode("overwrite").parquet(f"{path}/mapped/chunk={number}")
        batch.sparkSession.createDataFrame([(seen.get["n"],)], "n bigint").write.mode("overwrite").parquet(f"{path}/counts/chunk={number}")

    return process_stream(reads, work, checkpoint)
