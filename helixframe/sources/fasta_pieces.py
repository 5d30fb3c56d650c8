"""FASTA files in pieces: neither a record nor a sequence is one value, so a chromosome is read by many tasks.

Lines are what Spark splits files into, whatever the records. A line's record and the symbols before it are running
totals over range partitions; pieces are cut at multiples of `size` and put together from the lines that they lie on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, SEPARATOR, Alphabet
from ..functions.shared import running_totals, saved
from .readers import _lines

#: Symbols of a piece.
SIZE = 4096
#: A sequence is looked up by bins of so many symbols, so that a long one is many keys.
BIN = 1 << 16


def read_fasta_pieces(spark: SparkSession, path: str, mode: str = "strict", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(names, pieces) of a file, a folder or a pattern.

    names: seq_id (0, 1, ...), name, length, before (symbols of all sequences before it). pieces: seq_id, at (a multiple of
    size), part (of size symbols, the last of a sequence shorter; none of an empty one).

    As in read_fasta, names are the headers' first words, carriage returns are dropped and empty lines are nothing. A name that
    is empty or repeated raises here (``strict``) or is told in `_corrupt` of names (``permissive``); a file whose first line
    isn't a header always raises. A line is the largest value: symbols without line ends are read by one task, then cut.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode must be strict or permissive, not {mode!r}")
    if size < 1 or size > 65535:
        raise ValueError("a piece has 1 to 65535 symbols")
    lines = _lines(spark, path, "\n").withColumn("value", F.regexp_replace("value", "\r", "")).filter("value <> ''")
    head = F.startswith("value", F.lit(">"))
    lines = lines.select("file", "block", "id", "value", head.alias("head"))
    counted = running_totals(lines, ["file", "block", "id"], {"heads": F.col("head").cast("int"), "before": F.when(F.col("head"), 0).otherwise(F.length("value"))})
    rows = saved(counted.select("file", "block", "id", "head", "value", (F.col("heads") + F.col("head").cast("int") - 1).alias("seq_id"), "before"))
    starts = rows.groupBy("file").agg(F.min_by("head", F.struct("block", "id")).alias("head")).filter("not head").select("file").limit(1).collect()
    if starts:
        raise ValueError(f"the file doesn't begin with >: {starts[0].file}")
    names = _names(rows)
    if mode == "strict":
        wrong = names.filter(F.col("_corrupt").isNotNull()).select("_corrupt").limit(1).collect()
        if wrong:
            raise ValueError(wrong[0][0])
        names = names.drop("_corrupt")
    return names, _pieces(rows.filter("not head").select("seq_id", "before", "value"), names, size)


def _names(rows: DataFrame) -> DataFrame:
    header = F.expr("substring(value, 2)")
    names = rows.filter("head").select("seq_id", F.split_part(F.ltrim(header), F.lit(" "), F.lit(1)).alias("name"), "before")
    # a line's symbols, by sequence, are summed up in the tasks first
    length = rows.filter("not head").groupBy("seq_id").agg(F.sum(F.length("value")).alias("length"))
    twice = names.groupBy("name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    told = names.join(length, "seq_id", "left").join(twice, "name", "left")
    problem = F.when(F.col("name") == "", "a sequence has no name").when(F.col("times").isNotNull(), F.concat(F.lit("repeated name: "), "name"))
    return saved(told.select("seq_id", "name", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), "before", problem.alias("_corrupt")))


def _pieces(lines: DataFrame, names: DataFrame, size: int) -> DataFrame:
    cut = lines.select("seq_id", "before", F.posexplode(F.regexp_extract_all("value", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))).alias("i", "part"))
    cut = cut.select("seq_id", (F.col("before") + F.col("i").cast("bigint") * size).alias("place"), "part")
    bin_of = lambda place: F.floor(place / BIN)
    begins = names.filter("length > 0").select("seq_id", F.col("before").alias("begin"), F.explode(F.sequence(bin_of(F.col("before")), bin_of(F.col("before") + F.col("length") - 1))).alias("bin"))
    at = cut.withColumn("bin", bin_of(F.col("place"))).join(begins, ["seq_id", "bin"]).select("seq_id", (F.col("place") - F.col("begin")).alias("at"), "part")
    first = (F.lit(size) - F.col("at") % size).cast("int")  # symbols up to the next multiple of size
    halves = F.array(F.struct(F.col("at").alias("at"), F.substring("part", F.lit(1), first).alias("part")), F.struct((F.col("at") + first).alias("at"), F.substring("part", first + 1, F.lit(size)).alias("part")))
    each = at.select("seq_id", F.explode(halves).alias("x")).select("seq_id", "x.at", "x.part").filter("part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")  # size symbols at most
    return each.groupBy("seq_id", F.floor(F.col("at") / size).alias("number")).agg(joined.alias("part")).select("seq_id", (F.col("number") * size).alias("at"), "part")


def text_of_pieces(names: DataFrame, pieces: DataFrame, alphabet: Alphabet = DNA, two_strands: bool = True) -> DataFrame:
    """at, part: the stretches of the text that suffix.text_positions takes, made of pieces and single separators."""
    half = names.agg(F.coalesce(F.sum(F.col("length") + 1), F.lit(0))).first()[0]
    bins = names.filter("length > 0").select("seq_id", F.col("before").alias("begin"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / BIN))).alias("bin"))
    placed = pieces.withColumn("bin", F.floor(F.col("at") / BIN)).join(bins, ["seq_id", "bin"])
    # a sequence begins behind all symbols and one separator for each sequence before it
    forward = placed.select((F.col("begin") + F.col("seq_id") + F.col("at")).alias("at"), alphabet.encode("part").alias("part"))
    ends = names.select((F.col("before") + F.col("seq_id") + F.col("length")).alias("at"), F.lit(SEPARATOR).alias("part"))
    if not two_strands:
        return forward.unionByName(ends)
    # position p mirrors to 2 half - 2 - p, and a sequence's mirror begins behind the separator before it
    turned = forward.select((F.lit(2 * half - 1) - F.col("at") - F.length("part")).alias("at"), alphabet.reverse_complement("part").alias("part"))
    mirrored = names.select((F.lit(2 * half - 1) - F.col("before") - F.col("seq_id")).alias("at"), F.lit(SEPARATOR).alias("part"))
    return forward.unionByName(ends).unionByName(turned).unionByName(mirrored)


def kmers_of_pieces(pieces: DataFrame, k: int, size: int = SIZE) -> DataFrame:
    """seq_id, off, kmer of pieces of `size` symbols: each takes the first k - 1 symbols of the next."""
    if not 1 <= k <= size:
        raise ValueError("k is 1 to the size of a piece")
    after = pieces.select("seq_id", (F.col("at") - size).alias("at"), F.substring("part", 1, k - 1).alias("after"))
    wide = pieces.join(after, ["seq_id", "at"], "left").select("seq_id", "at", F.concat("part", F.coalesce("after", F.lit(""))).alias("part")).filter(F.length("part") >= k)
    each = wide.select("seq_id", "at", "part", F.explode(F.sequence(F.lit(0), F.length("part") - k)).alias("i"))
    return each.select("seq_id", (F.col("at") + F.col("i")).alias("off"), F.substring("part", F.col("i") + 1, F.lit(k)).alias("kmer"))
