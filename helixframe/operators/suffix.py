"""Suffix array, Burrows-Wheeler transform and occurrence counts of a text, as tables.

The text is a table of positions; nothing holds it in one place.  The first ranks come from the next ``FIRST``
symbols, and prefix doubling then refines only positions that are not yet told apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, SEPARATOR, Alphabet
from ..functions.shared import running_total, saved
from .text import with_coordinates

FIRST, CHUNK = 32, 4096
#: Positions from one mark to the next: 14 words of 64 bits.
MARK = 14 * 64
#: Positions that are sent to the ranks they ask for at most; more are joined.
SENT = 100_000


def text_rows(seqs: DataFrame, alphabet: Alphabet = DNA, two_strands: bool = True) -> DataFrame:
    """at, part: the text of placed sequences (seq_id, seq, beg, len) in stretches that begin at `at`.

    With two strands the reverse half follows: the mirror of each sequence begins behind its separator's mirror.
    """
    forward = seqs.select(F.col("beg").alias("at"), F.concat("seq", F.lit(SEPARATOR)).alias("part"))
    if not two_strands:
        return forward
    half = seqs.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    # the forward half's last separator stands at half - 1, so position p mirrors to 2 half - 2 - p
    reverse = seqs.select((F.lit(2 * half) - F.col("beg") - F.col("len")).alias("at"), F.concat(alphabet.reverse_complement("seq"), F.lit(SEPARATOR)).alias("part"))
    return forward.unionByName(reverse)


def text_positions(rows: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """pos, symbol, ahead (the next FIRST symbols in sort order's letters) of a text given as rows (at, part)."""
    span = rows.select("at", F.posexplode(F.expr(f"regexp_extract_all(part, '(?s)(.{{1,{CHUNK}}})', 1)")).alias("i", "piece")).select((F.col("at") + F.col("i").cast("bigint") * CHUNK).alias("at"), "piece")
    # pieces are cut again at multiples of CHUNK, so that each chunk of the text is a few pieces
    first = (F.lit(CHUNK) - F.col("at") % CHUNK).cast("int")
    cut = span.select(F.explode(F.array(F.struct(F.col("at").alias("at"), F.substring("piece", F.lit(1), first).alias("piece")), F.struct((F.col("at") + first).alias("at"), F.substring("piece", first + 1, F.lit(CHUNK)).alias("piece")))).alias("x"))
    chunks = cut.select("x.at", "x.piece").filter("piece <> ''").groupBy(F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("body"))
    chunks = saved(chunks)
    after = chunks.select((F.col("chunk") - 1).alias("chunk"), F.substring("body", 1, FIRST - 1).alias("after"))
    both = chunks.join(after, "chunk", "left").select("chunk", "body", F.concat("body", F.coalesce("after", F.lit(""))).alias("wide"))
    each = both.select("chunk", "body", "wide", F.explode(F.sequence(F.lit(0), F.length("body") - 1)).alias("i"))
    ahead = F.substring("wide", F.col("i") + 1, F.lit(FIRST))
    return each.select((F.col("chunk") * CHUNK + F.col("i")).cast("bigint").alias("pos"), F.substring("body", F.col("i") + 1, F.lit(1)).alias("symbol"), alphabet.sort_key(ahead).alias("ahead"))


def suffix_array(positions: DataFrame) -> DataFrame:
    """rank, pos of a text's positions (pos, ahead)."""
    keys = running_total(positions.groupBy("ahead").agg(F.count(F.lit(1)).alias("n")), ["ahead"], "n", "rank")
    ranked = saved(positions.select("pos", "ahead").join(keys, "ahead").select("pos", "rank", (F.col("n") == 1).alias("done")))
    settled, open_ = [ranked.filter("done").select("pos", "rank")], ranked.filter("not done").select("pos", "rank")
    reach = FIRST
    while size := open_.count():
        # settled positions stay in the files that they were written to; late rounds ask for few of them
        every = reduce(DataFrame.unionByName, settled, open_)
        if size <= SENT:
            every = every.join(F.broadcast(open_.select((F.col("pos") + reach).alias("pos"))), "pos", "left_semi")
        after = every.select((F.col("pos") - reach).alias("pos"), F.col("rank").alias("after"))
        told = saved(open_.join(after, "pos", "left").withColumn("after", F.coalesce("after", F.lit(-1))))
        # a long repeat is one rank: its parts are counted and summed up over range partitions, not in one window
        groups = running_total(told.groupBy("rank", "after").agg(F.count(F.lit(1)).alias("n")), ["rank", "after"], "n", "sum")
        start = groups.groupBy("rank").agg(F.min("sum").alias("first"))
        places = groups.join(start, "rank").select("rank", "after", "n", (F.col("sum") - F.col("first")).alias("place"))
        new = saved(told.join(places, ["rank", "after"]).select("pos", (F.col("rank") + F.col("place")).alias("rank"), (F.col("n") == 1).alias("done")))
        settled.append(new.filter("done").select("pos", "rank"))
        open_ = new.filter("not done").select("pos", "rank")
        reach *= 2
    return reduce(DataFrame.unionByName, settled).select("rank", "pos")


def sa_of_text(seqs: DataFrame, alphabet: Alphabet = DNA, two_strands: bool = True) -> tuple[DataFrame, DataFrame]:
    """(positions, suffix array) of sequences (seq_id, name, seq)."""
    positions = saved(text_positions(text_rows(with_coordinates(seqs, alphabet), alphabet, two_strands), alphabet))
    return positions, suffix_array(positions)


def sa_range(sa: DataFrame, begin: int, size: int) -> DataFrame:
    """The positions of `size` ranks from `begin`."""
    if begin < 0 or size < 1:
        raise ValueError("a range begins at 0 or later and has a rank at least")
    return sa.filter(F.col("rank").between(begin, begin + size - 1))


def bwt(positions: DataFrame, sa: DataFrame) -> DataFrame:
    """rank, symbol: what stands before each suffix; the last symbol of the text before the first."""
    n = positions.count()
    before = positions.select(F.when(F.col("pos") == n - 1, 0).otherwise(F.col("pos") + 1).cast("bigint").alias("pos"), "symbol")
    return sa.join(before, "pos").select("rank", "symbol")


def symbol_order(symbol: Column, alphabet: Alphabet = DNA) -> Column:
    """-1 for the separator, else the symbol's code."""
    return F.position(symbol, F.lit(alphabet.canonical)) - 1


def c_array(positions: DataFrame, alphabet: Alphabet = DNA) -> DataFrame:
    """symbol, start: the rank of the first suffix that begins with each symbol of the alphabet."""
    counts = positions.groupBy("symbol").count()
    every = positions.sparkSession.createDataFrame([(i, c) for i, c in enumerate(alphabet.canonical)], "code int, symbol string")
    smaller = F.broadcast(counts.select(symbol_order(F.col("symbol"), alphabet).alias("below"), F.col("count").alias("n")))  # a row per symbol
    return every.join(smaller, F.col("below") < F.col("code"), "left").groupBy("symbol").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("start"))


def occ_marks(transform: DataFrame, alphabet: Alphabet = DNA, mark: int = MARK) -> DataFrame:
    """block, symbol, cnt: occurrences of each symbol before rank block * mark."""
    spark = transform.sparkSession
    counts = transform.filter(F.col("symbol") != SEPARATOR).groupBy(F.floor(F.col("rank") / mark).alias("block"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    blocks = transform.select(F.floor(F.col("rank") / mark).alias("block")).distinct()
    symbols = F.broadcast(spark.createDataFrame([(c,) for c in alphabet.canonical], "symbol string"))
    grid = blocks.join(symbols).join(counts, ["block", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # symbol by symbol; what the symbols before have in all is taken off again
    total = running_total(grid, ["symbol", "block"], "n", "sum")
    start = F.broadcast(total.groupBy("symbol").agg(F.min("sum").alias("first")))
    return total.join(start, "symbol").select("block", "symbol", (F.col("sum") - F.col("first")).alias("cnt"))


def occ_rank(points: DataFrame, transform: DataFrame, marks: DataFrame, mark: int = MARK) -> DataFrame:
    """points (ptr, symbol) with occ: occurrences of the symbol at ranks 0 to ptr, from the mark before and the block's rest."""
    rows = points.withColumn("block", F.floor(F.col("ptr") / mark))
    inside = transform.select(F.floor(F.col("rank") / mark).alias("block"), "symbol", "rank")
    rest = rows.join(inside, ["block", "symbol"]).filter("rank <= ptr").groupBy("ptr", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(marks, ["block", "symbol"]).join(rest, ["ptr", "symbol"], "left").select("ptr", "symbol", (F.col("cnt") + F.coalesce("n", F.lit(0))).alias("occ"))


def occ_all(points: DataFrame, transform: DataFrame, marks: DataFrame, alphabet: Alphabet = DNA, mark: int = MARK) -> DataFrame:
    """points (ptr) with a column occ_<symbol> for each symbol of the alphabet."""
    each = points.select("ptr").distinct().select("ptr", F.explode(F.array(*map(F.lit, alphabet.canonical))).alias("symbol"))
    found = occ_rank(each, transform, marks, mark)
    return found.groupBy("ptr").agg(*[F.max(F.when(F.col("symbol") == c, F.col("occ"))).alias(f"occ_{c}") for c in alphabet.canonical])
