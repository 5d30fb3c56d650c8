"""Backward search over stored occurrence blocks: intervals of patterns of any lengths at once, and the positions in them.

A block is a row: the BWT's symbols of ``mark`` ranks as one string and, for each symbol, how often it stands before. Where a rank leads
to is then a look into one block: its count, and the symbol's occurrences in the block's first letters.

A step puts a symbol in front of every pattern and joins both ends of its interval with their blocks.  Patterns of all lengths
go together; those that are done stay in the files they were written to.  The first ``HEAD`` steps are made for the distinct ends of
patterns only, of which there are few (at most the alphabet's size to that power): at first all intervals begin in
the same few blocks.  Then patterns take the interval of their end by an equi-join and go on by themselves.  Blocks are broadcast
after they are counted; more than ``BROADCAST_BLOCKS`` are joined by number.

Positions come from a suffix array of which only every ``rate``-th text position is kept.  Intervals are cut into bins of ranks, so none is one
row however wide it is, and bins meet the sampled ranks by number.  A rank that isn't sampled steps to the suffix that begins one
symbol earlier, and so on: after at most ``rate`` - 1 steps it is.  Ranks that several intervals share are followed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, SEPARATOR, Alphabet
from ..functions.shared import saved
from .suffix import MARK
from .text import pos_to_str

#: Symbols of the common ends of patterns, steps between two written tables, blocks (about a kilobyte each) that are broadcast.
HEAD, STEPS, BROADCAST_BLOCKS = 8, 4, 20_000
#: Of text positions one in so many is kept; ranks of a bin.
RATE, BIN = 32, 4096


def occ_blocks(transform: DataFrame, marks: DataFrame, alphabet: Alphabet = DNA, mark: int = MARK) -> DataFrame:
    """block, body (its symbols in order), cnt (by symbol, the separator first: occurrences before it) of a BWT (rank, symbol) and its marks."""
    placed = transform.groupBy(F.floor(F.col("rank") / mark).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("x"))  # mark rows each
    bodies = placed.select("block", F.array_join(F.transform("x", lambda r: r["symbol"]), "").alias("body"))
    known = marks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "cnt"))).alias("c"))  # a row per symbol
    counts = [F.coalesce(F.element_at("c", c), F.lit(0)) for c in alphabet.canonical]
    separators = F.col("block") * mark - reduce(Column.__add__, counts)
    return bodies.join(known, "block").select("block", "body", F.array(separators, *counts).alias("cnt"))


def sampled(sa: DataFrame, rate: int = RATE) -> DataFrame:
    """rank, pos of the text positions that are kept."""
    if rate < 1:
        raise ValueError("one position in `rate` is kept")
    return sa.filter(F.col("pos") % rate == 0)


class Occurrences:
    """Steps through blocks. c: symbol, start of the alphabet's symbols (a few rows); total: the text's length."""

    def __init__(self, blocks: DataFrame, c: DataFrame, total: int, alphabet: Alphabet = DNA, mark: int = MARK, broadcast_blocks: int = BROADCAST_BLOCKS):
        self.alphabet, self.mark, self.total = alphabet, mark, total
        self.blocks = F.broadcast(blocks) if blocks.count() <= broadcast_blocks else blocks
        start = {r.symbol: r.start for r in c.collect()} | {SEPARATOR: 0}  # a row per symbol
        self.order = SEPARATOR + alphabet.canonical
        self.starts = [start[s] for s in self.order]
        # the counts of the whole text, for ends behind the last block
        self.totals = [b - a for a, b in zip(self.starts, [*self.starts[1:], total])]

    def _at(self, values: list[int], symbol: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.position(symbol, F.lit(self.order)))

    def before(self, rows: DataFrame, ptr: str, symbol: Column, out: str) -> DataFrame:
        """rows with `out`: occurrences of the symbol at ranks below ptr."""
        met = rows.join(self.blocks, F.floor(F.col(ptr) / self.mark) == F.col("block"), "left")
        inside = F.substring("body", F.lit(1), (F.col(ptr) % self.mark).cast("int"))
        found = F.element_at("cnt", F.position(symbol, F.lit(self.order))) + F.length(inside) - F.length(F.replace(inside, symbol))
        return met.select(*rows.columns, F.coalesce(found, self._at(self.totals, symbol)).alias(out))

    def step(self, rows: DataFrame) -> DataFrame:
        """rows (text, left, lo, hi) with the symbol before the last `left - 1` ones in front, where one is left."""
        symbol = F.substring("text", F.col("left"), F.lit(1))
        open_ = F.col("left") > 0
        asked = rows.withColumn("__symbol", F.when(open_, symbol).otherwise(SEPARATOR))
        asked = self.before(self.before(asked, "lo", F.col("__symbol"), "__lo"), "hi", F.col("__symbol"), "__hi")
        start = self._at(self.starts, F.col("__symbol"))
        new = {"lo": F.when(open_, start + F.col("__lo")).otherwise(F.col("lo")), "hi": F.when(open_, start + F.col("__hi")).otherwise(F.col("hi")), "left": F.when(open_, F.col("left") - 1).otherwise(0)}
        return asked.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])

    def finish(self, rows: DataFrame, longest: int) -> DataFrame:
        """rows (text, left, lo, hi) after all steps, of which there are `longest` at most."""
        done, rows = [], saved(rows)
        for k in range(0, longest, STEPS):
            for _ in range(min(STEPS, longest - k)):
                rows = self.step(rows)
            rows = saved(rows)
            done.append(rows.filter("left = 0"))
            rows = rows.filter("left > 0")
        return reduce(DataFrame.unionByName, done) if done else rows

    def intervals(self, texts: DataFrame) -> DataFrame:
        """text, lo, hi of distinct texts (text) of any lengths: hi - lo suffixes begin with the text, and lo stand below it."""
        whole = [F.lit(0).cast("bigint").alias("lo"), F.lit(self.total).cast("bigint").alias("hi")]
        longest = texts.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
        end = F.expr(f"right(text, {HEAD})")
        ends = texts.select(end.alias("text")).distinct()
        ends = self.finish(ends.select("text", F.length("text").alias("left"), *whole), min(HEAD, longest)) if longest else ends.select("text", F.lit(0).alias("left"), *whole)
        ends = ends.select(F.col("text").alias("__end"), "lo", "hi")
        rows = texts.withColumn("__end", end).join(ends, "__end").select("text", F.greatest(F.length("text") - HEAD, F.lit(0)).alias("left"), "lo", "hi")
        return (self.finish(rows, longest - HEAD) if longest > HEAD else rows).select("text", "lo", "hi")

    def positions(self, ranks: DataFrame, samples: DataFrame, first_rank: int, rate: int = RATE) -> DataFrame:
        """rank, pos of distinct ranks. first_rank: that of text position 0, before which nothing stands."""
        live, done = ranks.select("rank", F.col("rank").alias("at")), []
        for steps in range(rate):
            met = saved(live.join(samples.select(F.col("rank").alias("at"), "pos"), "at", "left"))
            done.append(met.filter("pos is not null").select("rank", (F.col("pos") + steps).alias("pos")))
            live = met.filter("pos is null").select("rank", "at")
            if steps == rate - 1 or live.isEmpty():
                break
            symbol = F.substring("body", (F.col("at") % self.mark + 1).cast("int"), F.lit(1))
            inside = F.substring("body", F.lit(1), (F.col("at") % self.mark).cast("int"))
            earlier = F.element_at("cnt", F.position("__s", F.lit(self.order))) + F.length("__inside") - F.length(F.replace("__inside", "__s"))
            # the text's last separator, which nothing follows, sorts before the others though it stands before position 0
            wrapped = F.when((F.col("__s") == SEPARATOR) & (F.col("at") < first_rank), 1).otherwise(0)
            met = live.join(self.blocks, F.floor(F.col("at") / self.mark) == F.col("block")).withColumn("__s", symbol).withColumn("__inside", inside)
            live = met.select("rank", (self._at(self.starts, F.col("__s")) + earlier + wrapped).alias("at"))
        return reduce(DataFrame.unionByName, done)

    def pattern_intervals(self, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
        """pattern, fp, rp, sz, dp as ``search.fm_interval`` gives them; patterns of all lengths, encoded by the alphabet first."""
        wanted = patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern is not null").distinct()
        wanted = saved(wanted.withColumn("text", self.alphabet.encode("pattern")).withColumn("rc", self.alphabet.reverse_complement(self.alphabet.encode("pattern"))))
        found = saved(self.intervals(wanted.select(F.explode(F.array("text", "rc")).alias("text")).distinct()))
        own = found.select("text", F.col("lo").alias("fp"), (F.col("hi") - F.col("lo")).alias("sz"))
        other = found.select(F.col("text").alias("rc"), F.col("lo").alias("rp"))
        return wanted.join(own, "text").join(other, "rc").select("pattern", "fp", "rp", "sz", F.length("pattern").alias("dp"))


def ranks_of(intervals: DataFrame, size: int = BIN) -> DataFrame:
    """intervals (fp, sz and others) with a row for each rank in them. A wide one is cut into bins of ranks, which are dealt out."""
    bins = intervals.filter("sz > 0").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("fp") / size), F.floor((F.col("fp") + F.col("sz") - 1) / size))))
    bins = bins.repartition("__bin", "fp")
    first, last = F.greatest(F.col("fp"), F.col("__bin") * size), F.least(F.col("fp") + F.col("sz"), (F.col("__bin") + 1) * size) - 1
    return bins.withColumn("rank", F.explode(F.sequence(first, last))).drop("__bin")


def locate(intervals: DataFrame, occurrences: Occurrences, samples: DataFrame, seqs: DataFrame, rate: int = RATE) -> DataFrame:
    """pattern, pos, label: every place of patterns with their intervals (pattern, fp, sz) in the two-strand text.

    Sampled ranks of an interval are met by bin; the others are followed to one.
    """
    each = saved(ranks_of(intervals.select("pattern", "fp", "sz")).select("pattern", "rank"))
    first = samples.filter("pos = 0").select("rank").first()
    found = occurrences.positions(each.select("rank").distinct(), samples, first[0] if first else 0, rate)
    return pos_to_str(each.join(found, "rank").select("pattern", "pos"), seqs).select("pattern", "pos", "label")
