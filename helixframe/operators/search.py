"""Exact search: intervals, counts, places and continuations of patterns in the two-strand text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, SEPARATOR, Alphabet
from ..functions.shared import running_total
from .kmers import LONG, kmers, longest
from .text import both_strands, forward_length, mirror


def fm_interval(patterns: DataFrame, seqs: DataFrame, alphabet: Alphabet = DNA, pattern_col: str = "pattern") -> DataFrame:
    """pattern, fp (suffixes below it), rp (fp of its reverse complement), sz (suffixes that begin with it), dp (its length).

    Placed sequences are cut to the patterns' lengths; counts of the distinct cuts and the patterns are sorted
    together and summed up in that order, which gives every interval without a suffix array. An empty pattern
    is the whole text.
    """
    wanted = patterns.select(F.col(pattern_col).alias("pattern")).distinct()
    lengths = [r[0] for r in wanted.select(F.length("pattern").alias("n")).distinct().filter("n > 0").collect()]  # a few numbers
    total = 2 * forward_length(seqs)
    strands = both_strands(seqs.select("seq_id", "seq"), alphabet)
    texts = strands.select(F.concat("seq", F.lit(SEPARATOR * max(lengths, default=1))).alias("seq"), F.length("seq").alias("n"))
    asked = wanted.select("pattern", F.explode(F.array(F.lit(0), F.lit(1))).alias("rc")).withColumn("key", F.when(F.col("rc") == 1, alphabet.reverse_complement("pattern")).otherwise(F.col("pattern")))
    parts = []
    for n in sorted(lengths):
        # a cut that reaches a separator is filled with more of them: all that is compared is what stands before
        cuts = kmers(texts, n, ["n"], spread=longest(seqs) > LONG).filter(F.col("off") <= F.col("n")).groupBy("kmer").agg(F.count(F.lit(1)).alias("c"))
        rows = cuts.select(alphabet.sort_key("kmer").alias("sort"), F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("rc"), "c")
        mine = asked.filter(F.length("pattern") == n)
        mine = mine.join(cuts, F.col("kmer") == F.col("key"), "left").select(alphabet.sort_key("key").alias("sort"), "pattern", "rc", F.coalesce("c", F.lit(0)).alias("sz"))
        both = rows.select("sort", "pattern", "rc", "c", F.lit(1).alias("last"), F.lit(0).cast("bigint").alias("sz")).unionByName(mine.select("sort", "pattern", "rc", F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("last"), "sz"))
        parts.append(running_total(both, ["sort", "last", "pattern", "rc"], "c", "fp").filter("pattern is not null"))
    empty = wanted.filter("pattern = ''").select("pattern", F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("rp"), F.lit(total).cast("bigint").alias("sz"), F.lit(0).alias("dp"))
    for part in parts:
        one = part.groupBy("pattern").agg(F.max(F.when(F.col("rc") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("rc") == 1, F.col("fp"))).alias("rp"), F.max(F.when(F.col("rc") == 0, F.col("sz"))).alias("sz"))
        empty = empty.unionByName(one.select("pattern", "fp", "rp", "sz", F.length("pattern").alias("dp")))
    return empty


def extensions(patterns: DataFrame, seqs: DataFrame, end: str = "suffix", alphabet: Alphabet = DNA, pattern_col: str = "pattern") -> DataFrame:
    """pattern, symbol, fp, rp, sz, dp: the interval of each pattern with each symbol put in front ("prefix") or behind."""
    if end not in ("prefix", "suffix"):
        raise ValueError(f"the end is prefix or suffix, not {end!r}")
    symbols = F.explode(F.array(*map(F.lit, alphabet.canonical))).alias("symbol")
    grown = patterns.select(F.col(pattern_col).alias("__old")).distinct().select("__old", symbols)
    grown = grown.withColumn("__new", F.concat("symbol", "__old") if end == "prefix" else F.concat("__old", "symbol"))
    found = fm_interval(grown.select(F.col("__new").alias("pattern")), seqs, alphabet)
    return grown.join(found, F.col("__new") == F.col("pattern")).select(F.col("__old").alias("pattern"), "symbol", "fp", "rp", "sz", "dp")


def count_patterns(patterns: DataFrame, seqs: DataFrame, k: int, alphabet: Alphabet = DNA) -> DataFrame:
    """pattern, n: occurrences on both strands of patterns of one length k; 0 for those without."""
    found = kmers(both_strands(seqs.select("seq_id", "seq"), alphabet), k, [], spread=longest(seqs) > LONG).join(patterns.select(F.col("pattern").alias("kmer")).distinct(), "kmer", "left_semi")
    return patterns.select("pattern").distinct().join(found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")), F.col("pattern") == F.col("kmer"), "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def locate(patterns: DataFrame, seqs: DataFrame, k: int, alphabet: Alphabet = DNA) -> DataFrame:
    """pattern, pos, label: every place of patterns of length k in the two-strand text of placed sequences.

    A k-mer's place gives its label at once, so no lookup of positions is needed.
    """
    half = forward_length(seqs)
    wanted = patterns.select(F.col("pattern").alias("kmer")).distinct()
    found = kmers(both_strands(seqs.select("seq_id", "name", "beg", "len", "seq"), alphabet), k, ["name", "beg", "len", "strand"]).join(wanted, "kmer")
    forward = F.col("beg") + F.col("off")
    # offset o of the reverse strand is base len - 2 - o of the forward one
    at = F.col("beg") + F.col("len") - 2 - F.col("off")
    plus = F.col("strand") == "+"
    offset = F.when(plus, F.col("off")).otherwise(F.col("len") - 2 - F.col("off")) + 1
    return found.select(F.col("kmer").alias("pattern"), F.when(plus, forward).otherwise(mirror(at, half)).alias("pos"), F.concat_ws(":", "name", offset.cast("string"), "strand").alias("label"))


def children(prefixes: DataFrame, seqs: DataFrame, k: int, alphabet: Alphabet = DNA) -> DataFrame:
    """pattern, next, n: the symbols that follow each pattern of length k in the two-strand text and how often."""
    strands = both_strands(seqs.select("seq_id", "seq"), alphabet)
    longer = kmers(strands, k + 1, [], spread=longest(seqs) > LONG).select(F.substring("kmer", 1, k).alias("pattern") if k else F.lit("").alias("pattern"), F.substring("kmer", k + 1, 1).alias("next"))
    return longer.join(prefixes.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern", "next").agg(F.count(F.lit(1)).alias("n"))
