"""K-mers: every window of k symbols of every sequence, none across its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet

#: Sequences are cut into pieces of this size first: a substring of a long string costs its distance from the start.
PIECE = 512
#: From this length on a sequence's pieces are dealt out.
LONG = 1_000_000


def pieces(seq: Column, size: int, overlap: int) -> Column:
    """The sequence in pieces of `size` <= 65535 symbols, each with the first `overlap` symbols of what follows."""
    if not 0 <= overlap <= size:
        raise ValueError("the overlap reaches over more than a piece")
    parts = F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    return F.transform(parts, lambda p, i: F.struct((i.cast("bigint") * size).alias("at"), F.concat(p, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, overlap)).alias("part")))


def longest(seqs: DataFrame) -> int:
    """The length of the longest sequence, from `len` where there is one."""
    size = F.col("len") if "len" in seqs.columns else F.length("seq")
    return seqs.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]


def kmers(seqs: DataFrame, k: int, keep: list[str] | None = None, seq_col: str = "seq", spread: bool | None = None) -> DataFrame:
    """The columns of `keep` (seq_id), off (from 0) and kmer.

    With spread the pieces of sequences are dealt out before they become k-mers: a long sequence is one row, and
    its k-mers would all be made in its task. Left open, `len` decides where rows have it (sequences that are placed).
    """
    if spread is None:
        spread = "len" in seqs.columns and longest(seqs) > LONG
    if k < 1:
        raise ValueError("k is at least 1")
    keep = ["seq_id"] if keep is None else keep
    size = max(PIECE, k)
    cut = seqs.filter(F.length(seq_col) >= k).select(*keep, pieces(F.col(seq_col), size, k - 1).alias("__parts")).select(*keep, F.explode("__parts").alias("__p"))
    cut = cut.select(*keep, F.col("__p.at").alias("__at"), F.col("__p.part").alias("__part")).filter(F.length("__part") >= k)
    if spread:
        cut = cut.repartition(F.xxhash64("__part", "__at"))
    each = cut.select(*keep, "__at", "__part", F.explode(F.sequence(F.lit(0), F.length("__part") - k)).alias("__i"))
    return each.select(*keep, (F.col("__at") + F.col("__i")).alias("off"), F.substring("__part", F.col("__i") + 1, F.lit(k)).alias("kmer"))


def unknown_count(kmer: Column | str, alphabet: Alphabet = DNA) -> Column:
    """How many symbols are the unknown one."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.lit(0) if alphabet.unknown is None else symbol_count(kmer, alphabet.unknown)


def symbol_count(text: Column, symbol: str) -> Column:
    """How often a symbol stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def count_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n: occurrences on the strands given."""
    return kmers(seqs, k, []).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def distinct_kmers(seqs: DataFrame, k: int, spread: bool = False) -> DataFrame:
    return kmers(seqs, k, [], spread=spread).select("kmer").distinct()


def count_canonical(seqs: DataFrame, k: int, alphabet: Alphabet = DNA, seq_col: str = "seq") -> DataFrame:
    """kmer, n: of a k-mer and its reverse complement the one that sorts first, with the occurrences of either.

    Pieces are turned and put into sort order's letters whole; k-mers are only cut from them and compared.
    """
    cut = seqs.filter(F.length(seq_col) >= k).select(F.explode(pieces(F.col(seq_col), max(PIECE, k), k - 1)).alias("__p"))
    part = F.col("__p.part")
    both = cut.filter(F.length(part) >= k).select(alphabet.sort_key(part).alias("__one"), alphabet.sort_key(alphabet.reverse_complement(part)).alias("__other"))
    each = both.select("__one", "__other", F.explode(F.sequence(F.lit(0), F.length("__one") - k)).alias("__i"))
    turned = F.substring("__other", F.length("__other") - k - F.col("__i") + 1, F.lit(k))
    counts = each.select(F.least(F.substring("__one", F.col("__i") + 1, F.lit(k)), turned).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(alphabet.from_sort_key("key").alias("kmer"), "n")
