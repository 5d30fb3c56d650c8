"""Sequences as one text with two strands: coordinates, labels and slices.

The text is the sequences in order, each followed by a separator, and then the reverse complement of all that
followed by a separator.  It is never built: a sequence is a row (seq_id, name, seq, beg, len), len with its
separator, and a position of the text is arithmetic on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, SEPARATOR, Alphabet
from ..functions.shared import running_total
from .kmers import PIECE, pieces

#: Positions are looked up by bins of so many.
BIN = 1 << 16


def with_coordinates(seqs: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """seq_id, name, seq (encoded), beg, len of rows (seq_id, name, seq). Names must be unique and not empty."""
    rows = seqs.select("seq_id", "name", alphabet.encode("seq").alias("seq")).withColumn("len", (F.length("seq") + 1).cast("bigint"))
    placed = running_total(rows.select("seq_id", "len"), ["seq_id"], "len", "beg").select("seq_id", "beg")
    return rows.join(placed, "seq_id").select("seq_id", "name", "seq", "beg", "len")


def check_names(seqs: DataFrame) -> None:
    """Raises if a name is empty or occurs twice."""
    if not seqs.filter(F.coalesce(F.col("name"), F.lit("")) == "").isEmpty():
        raise ValueError("a sequence has no name")
    twice = seqs.groupBy("name").count().filter("count > 1").select("name").limit(1).collect()
    if twice:
        raise ValueError(f"repeated name: {twice[0].name}")


def both_strands(seqs: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """seqs twice: strand + as they are, strand - reverse-complemented."""
    return seqs.withColumn("strand", F.lit("+")).unionByName(seqs.withColumn("seq", alphabet.reverse_complement("seq")).withColumn("strand", F.lit("-")))


def text_statistics(seqs: DataFrame) -> DataFrame:
    """One row: seq_count, text_length (both strands), wildcard_count (separators on both strands), has_rc."""
    return seqs.agg(
        F.count(F.lit(1)).alias("seq_count"),
        (2 * F.coalesce(F.sum("len"), F.lit(0))).alias("text_length"),
        (2 * F.count(F.lit(1))).alias("wildcard_count"),
        F.lit(1).alias("has_rc"),
    )


def forward_length(seqs: DataFrame) -> int:
    """The length of the forward half, a number."""
    return seqs.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]


def mirror(pos: Column, forward: int) -> Column:
    """The position on the other strand."""
    return F.lit(2 * forward - 2) - pos


def _owners(points: DataFrame, seqs: DataFrame, at: str) -> DataFrame:
    """points with the sequence that holds the forward position `at`."""
    spans = seqs.select("seq_id", "name", "beg", "len")
    inside = (F.col(at) >= F.col("beg")) & (F.col(at) < F.col("beg") + F.col("len"))
    # a sequence stands in each bin that it reaches, so the join is by key
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("beg") / BIN), F.floor((F.col("beg") + F.col("len") - 1) / BIN))))
    return points.withColumn("__bin", F.floor(F.col(at) / BIN)).join(binned, "__bin").filter(inside).drop("__bin")


def pos_to_str(points: DataFrame, seqs: DataFrame, pos_col: str = "pos") -> DataFrame:
    """points with label: name, offset from 1 and strand of a position of the two-strand text. Positions outside are left out."""
    half = forward_length(seqs)
    reverse = F.col(pos_col) >= half
    rows = points.withColumn("__at", F.when(reverse, mirror(F.col(pos_col), half)).otherwise(F.col(pos_col)))
    found = _owners(rows, seqs, "__at")
    label = F.concat_ws(":", "name", (F.col("__at") - F.col("beg") + 1).cast("string"), F.when(reverse, "-").otherwise("+"))
    return found.select(*points.columns, label.alias("label"))


def str_to_pos(labels: DataFrame, seqs: DataFrame, label_col: str = "label") -> DataFrame:
    """labels with pos; null for what is no label of a symbol: unknown names, offsets outside, other forms."""
    half = forward_length(seqs)
    pattern = r"^(.+?):([0-9]+)(?::(.+))?$"
    part = lambda k: F.regexp_extract(label_col, pattern, k)
    rows = labels.select(*labels.columns, part(1).alias("__name"), F.expr(f"try_cast(regexp_extract(`{label_col}`, '{pattern}', 2) as bigint)").alias("__offset"), part(3).alias("__strand"))
    found = rows.join(seqs.select("name", "beg", "len"), F.col("__name") == F.col("name"), "left")
    at = F.col("beg") + F.col("__offset") - 1
    inside = (F.col("__offset") >= 1) & (F.col("__offset") < F.col("len"))
    forward = (F.col("__strand") == "") | F.startswith("__strand", F.lit("+"))
    return found.select(*labels.columns, F.when(inside, F.when(forward, at).otherwise(mirror(at, half))).alias("pos"))


def text_slice(points: DataFrame, seqs: DataFrame, pos_col: str, length: int) -> DataFrame:
    """points (forward positions) with the `length` symbols there, as far as the sequence and its separator go.

    Points meet the pieces of sequences that they reach into, by number, and never a whole sequence.
    """
    found = _owners(points, seqs, pos_col)
    off = F.col(pos_col) - F.col("beg")
    last = F.least(off + length, F.col("len")) - 1
    asked = found.select(*points.columns, "seq_id", off.alias("__off"), F.explode(F.sequence(F.floor(off / PIECE), F.floor(last / PIECE))).alias("__no"))
    parts = seqs.select("seq_id", F.explode(pieces(F.concat("seq", F.lit(SEPARATOR)), PIECE, 0)).alias("__p")).select("seq_id", F.floor(F.col("__p.at") / PIECE).alias("__no"), F.col("__p.part").alias("__part"))
    begin = F.greatest(F.col("__off") - F.col("__no") * PIECE, F.lit(0))
    end = F.col("__off") + length - F.col("__no") * PIECE
    cut = asked.join(parts, ["seq_id", "__no"]).withColumn("__cut", F.substring("__part", (begin + 1).cast("int"), (end - begin).cast("int")))
    cuts = cut.groupBy(pos_col).agg(F.array_sort(F.collect_set(F.struct("__no", "__cut"))).alias("__cuts"))  # of one position: as many as `length` reaches
    return points.join(cuts, pos_col).select(*points.columns, F.array_join(F.transform("__cuts", lambda x: x["__cut"]), "").alias("slice"))


def symbol_at(points: DataFrame, seqs: DataFrame, pos_col: str = "pos") -> DataFrame:
    """points (forward positions) with the symbol there."""
    return text_slice(points, seqs, pos_col, 1).withColumnRenamed("slice", "symbol")


def two_strand_slice(points: DataFrame, seqs: DataFrame, pos_col: str, length: int, alphabet: Alphabet = DNA) -> DataFrame:
    """points with the `length` symbols of the two-strand text from there, over separators, sequences and strands.

    A slice ends where the text does. A position that is null, negative or behind the text raises an error. A slice is
    mirrored first where it reaches into the other strand, so that only pieces of sequences are met, by number; it is put
    together from as many as `length` reaches.
    """
    if length < 1:
        raise ValueError("a slice is a symbol at least")
    half = forward_length(seqs)
    pos = F.col(pos_col).cast("bigint")
    inside = F.coalesce((pos >= 0) & (pos < 2 * half), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"the text has positions 0 to {2 * half - 1}, not "), F.coalesce(pos.cast("string"), F.lit("null"))))
    asked = points.select(F.when(inside, pos).otherwise(wrong.cast("bigint")).alias("__p")).distinct()
    last = F.least(F.col("__p") + length, F.lit(2 * half)) - 1
    # of each strand the forward positions from lo to hi; the text's last separator is the mirror of none
    spans = F.filter(
        F.array(
            F.struct(F.lit(False).alias("turned"), F.col("__p").alias("lo"), F.least(last, F.lit(half - 1)).alias("hi")),
            F.struct(F.lit(True).alias("turned"), mirror(F.least(last, F.lit(2 * half - 2)), half).alias("lo"), mirror(F.greatest(F.col("__p"), F.lit(half)), half).alias("hi")),
        ),
        lambda x: x["lo"] <= x["hi"],
    )
    each = asked.select("__p", F.explode(spans).alias("s")).select("__p", "s.*")
    binned = each.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    places = seqs.select("seq_id", "beg", "len").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("beg") / BIN), F.floor((F.col("beg") + F.col("len") - 1) / BIN))))
    over = binned.join(places, "__bin").filter((F.col("lo") < F.col("beg") + F.col("len")) & (F.col("hi") >= F.col("beg"))).drop("__bin").distinct()
    off = over.withColumn("__from", F.greatest(F.col("lo"), F.col("beg")) - F.col("beg")).withColumn("__to", F.least(F.col("hi"), F.col("beg") + F.col("len") - 1) - F.col("beg"))
    numbered = off.withColumn("__no", F.explode(F.sequence(F.floor(F.col("__from") / PIECE), F.floor(F.col("__to") / PIECE))))
    parts = seqs.select("seq_id", F.explode(pieces(F.concat("seq", F.lit(SEPARATOR)), PIECE, 0)).alias("__q")).select("seq_id", F.floor(F.col("__q.at") / PIECE).alias("__no"), F.col("__q.part").alias("__part"))
    begin = F.greatest(F.col("__from") - F.col("__no") * PIECE, F.lit(0))
    cut = F.substring("__part", (begin + 1).cast("int"), (F.col("__to") - F.col("__no") * PIECE - begin + 1).cast("int"))
    at = F.col("beg") + F.col("__no") * PIECE + begin
    cuts = numbered.join(parts, ["seq_id", "__no"]).select("__p", F.when(F.col("turned"), mirror(at, half)).otherwise(at).alias("at"), F.when(F.col("turned"), alphabet.reverse_complement(cut)).otherwise(cut).alias("cut"))
    whole = cuts.groupBy("__p").agg(F.array_sort(F.collect_list(F.struct("at", "cut"))).alias("__cuts"))
    body = F.array_join(F.transform(F.coalesce("__cuts", F.array().cast("array<struct<at:bigint,cut:string>>")), lambda x: x["cut"]), "")
    done = asked.join(whole, "__p", "left").select("__p", F.concat(body, F.when(last == 2 * half - 1, SEPARATOR).otherwise("")).alias("slice"))
    return points.join(done, pos == F.col("__p")).select(*points.columns, "slice")


def two_strand_symbol(points: DataFrame, seqs: DataFrame, pos_col: str = "pos", alphabet: Alphabet = DNA) -> DataFrame:
    """points with the symbol of the two-strand text there; a position outside raises an error."""
    return two_strand_slice(points, seqs, pos_col, 1, alphabet).withColumnRenamed("slice", "symbol")
