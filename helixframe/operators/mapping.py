"""Read mapping by seeds and verification: an extension that the index makes possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.shared import saved
from .kmers import LONG, PIECE, kmers, longest, pieces, unknown_count
from .text import both_strands


#: Up to so many k-mers of items are broadcast (about 60 bytes each).
BROADCAST_KMERS = 500_000


#: Lengths of seeds: a read takes the longest that its fragments hold, so that reads of all lengths ask for few kinds of k-mers.
SEED_LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 254)
#: A seed with more places than this is taken longer where its fragment allows.
HOT_PLACES = 1000


def _longest_seed(fragment: Column, most: int) -> Column:
    """The longest seed length that a fragment holds, at most `most`; 0 for an empty fragment."""
    out = F.lit(0)
    for n in sorted({n for n in SEED_LENGTHS if n <= most} | {most}):
        out = F.when(fragment >= n, n).otherwise(out)
    return out


def _fragments(texts: DataFrame, tau: int, most: int, alphabet: Alphabet) -> DataFrame:
    """texts (read, text) with at, size (of the seed) and fragment (its length) of tau + 1 fragments without a gap or an overlap."""
    n = F.length("text")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(tau)), lambda i: F.struct(F.floor(n * i / (tau + 1)).cast("int").alias("at"), F.floor(n * (i + 1) / (tau + 1)).cast("int").alias("end")))
    rows = texts.select("read", "text", F.explode(cuts).alias("f")).select("read", "text", "f.at", (F.col("f.end") - F.col("f.at")).alias("fragment"))
    return rows.withColumn("size", _longest_seed(F.col("fragment"), most))


def _hits(wanted: DataFrame, strands: DataFrame, spread: bool, lengths: list[int]) -> DataFrame:
    """wanted (size, kmer, ...) with seq_id, strand and off of each place of the k-mer. Placed k-mers of each length, of which there are few."""
    places = [kmers(strands, n, ["seq_id", "strand"], spread=spread).withColumn("size", F.lit(n)) for n in lengths]
    return wanted.join(reduce(DataFrame.unionByName, places), ["size", "kmer"])


def seeds(texts: DataFrame, seqs: DataFrame, k: int, tau: int, alphabet: Alphabet = DNA, hot: int | None = None) -> DataFrame:
    """read, seq_id, strand, diagonal (begin of the read on that strand): all places where texts (read, text) can stand with at most tau
    substitutions, and others.

    Of tau + 1 fragments of a read one at least is without a mismatch, and so is its seed: its first symbols, as many as the longest of
    SEED_LENGTHS up to k that it holds. Seeds of more than `hot` places are taken as long as their fragments allow, so a seed
    such as poly-A costs no row for each pair of a read and a place. Reads of tau symbols or fewer have a fragment without a symbol and may
    stand anywhere: they are few different ones, and are sent to all places.
    """
    hot = HOT_PLACES if hot is None else hot
    spread = longest(seqs) > LONG
    strands = both_strands(seqs.select("seq_id", "seq"), alphabet)
    cut = saved(_fragments(texts, tau, k, alphabet))
    clean = lambda rows: rows.filter((F.col("size") > 0) & (unknown_count("kmer", alphabet) == 0))
    seed = F.substring("text", F.col("at") + 1, F.col("size"))
    first = saved(clean(cut.withColumn("kmer", seed)))
    lengths = lambda rows: sorted(r[0] for r in rows.select("size").distinct().collect())  # noqa: E731  a few numbers
    found = []
    if used := lengths(first):
        keys = first.select("size", "kmer").distinct()
        often = saved(_hits(keys, strands, spread, used).groupBy("size", "kmer").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > hot))
        # longer seeds for those
        longer = first.join(often.select("size", "kmer"), ["size", "kmer"], "left_semi").withColumn("more", _longest_seed(F.col("fragment"), max(SEED_LENGTHS)))
        again = saved(clean(longer.filter("more > size").select("read", "text", "at", F.col("more").alias("size"), F.substring("text", F.col("at") + 1, F.col("more")).alias("kmer"))))
        kept = first.join(often.select("size", "kmer", F.lit(True).alias("often")), ["size", "kmer"], "left").filter(F.col("often").isNull() | (_longest_seed(F.col("fragment"), max(SEED_LENGTHS)) <= F.col("size")))
        wanted = kept.select("read", "at", "size", "kmer").unionByName(again.select("read", "at", "size", "kmer"))
        found.append(_hits(wanted, strands, spread, sorted({*used, *lengths(again)})).select("read", "seq_id", "strand", (F.col("off") - F.col("at")).alias("diagonal")))
    short = texts.filter((F.length("text") <= tau) & (F.col("text") != "")).select("read", F.length("text").alias("n"))
    if not short.isEmpty():
        anywhere = kmers(strands, 1, ["seq_id", "strand"], spread=spread).select("seq_id", "strand", F.col("off").alias("diagonal"))
        found.append(anywhere.join(F.broadcast(short.select("read"))).select("read", "seq_id", "strand", "diagonal"))  # texts of tau <= 3 symbols at most
    if not found:
        return texts.select("read", F.lit(None).cast("bigint").alias("seq_id"), F.lit("").alias("strand"), F.lit(0).alias("diagonal")).limit(0)
    return reduce(DataFrame.unionByName, found).filter("diagonal >= 0").distinct()


def hamming(a, b, unknown: str | None):
    """Mismatches of two texts of one length, without unpacking them: symbols that stay after equal ones are blanked."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    differ = lambda p: (p["x"] != p["y"]) | (p["x"] == unknown) if unknown else p["x"] != p["y"]
    return F.size(F.filter(pairs, differ))


def map_reads(reads: DataFrame, seqs: DataFrame, k: int, tau: int, read_id: str = "ord", read_seq: str = "seq", alphabet: Alphabet = DNA) -> DataFrame:
    """read, name, offset (from 1, on the forward strand), strand, dist: the best place of each read, with at most tau
    substitutions over its whole length; of equal ones the first by name, offset and strand. Reads without one are left out, and no
    others: seeds are taken from each read by its own length, k symbols at most. Reads with the same text are mapped once.

    A place is compared with the pieces of a sequence that it covers, joined by number, so no sequence is moved whole.
    """
    if k < 1 or tau < 0:
        raise ValueError("a seed has a symbol at least, and a distance isn't negative")
    named = saved(reads.select(F.col(read_id).alias("name_of_read"), alphabet.encode(read_seq).alias("text")))
    texts = saved(named.select("text").filter("text <> ''").distinct().withColumn("read", F.monotonically_increasing_id()))
    placed = seeds(texts, seqs, k, tau, alphabet)
    both = both_strands(seqs.select("seq_id", "name", "seq"), alphabet)
    sizes = seqs.select("seq_id", "name", F.length("seq").alias("size"))
    full = placed.join(texts, "read").join(sizes, "seq_id").filter(F.col("diagonal") + F.length("text") <= F.col("size"))
    last = F.floor((F.col("diagonal") + F.length("text") - 1) / PIECE)
    asked = full.select("*", F.explode(F.sequence(F.floor(F.col("diagonal") / PIECE), last)).alias("no"))
    begin = F.greatest(F.col("no") * PIECE - F.col("diagonal"), F.lit(0))  # of the read, where the piece begins or before it
    end = F.least((F.col("no") + 1) * PIECE - F.col("diagonal"), F.length("text"))
    asked = asked.select("read", "seq_id", "name", "size", "strand", "diagonal", "no", F.length("text").alias("n"), F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"), F.greatest(F.col("diagonal") - F.col("no") * PIECE, F.lit(0)).alias("at"))
    parts = both.select("seq_id", "strand", F.explode(pieces(F.col("seq"), PIECE, 0)).alias("p")).select("seq_id", "strand", F.floor(F.col("p.at") / PIECE).alias("no"), F.col("p.part").alias("piece"))
    met = asked.join(parts, ["seq_id", "strand", "no"])
    each = met.withColumn("d", hamming(F.col("part"), F.substring("piece", (F.col("at") + 1).cast("int"), F.length("part")), alphabet.unknown))
    summed = each.groupBy("read", "seq_id", "strand", "diagonal", "name", "size", "n").agg(F.sum("d").cast("int").alias("dist")).filter(F.col("dist") <= tau)
    offset = F.when(F.col("strand") == "+", F.col("diagonal") + 1).otherwise(F.col("size") - F.col("diagonal") - F.col("n") + 1)
    best = summed.groupBy("read").agg(F.min(F.struct("dist", "name", offset.alias("offset"), "strand")).alias("x"))
    best = best.join(texts, "read").select("text", "x.name", "x.offset", "x.strand", "x.dist")
    return named.join(best, "text").select(F.col("name_of_read").alias("read"), "name", "offset", "strand", "dist")


def contamination_seeds(docs: DataFrame, items: DataFrame, k: int, doc_id: str, item_id: str, doc_seq: str, item_seq: str) -> DataFrame:
    """doc, item, n: pairs with k-mers in common and how many different ones.

    The documents' k-mers meet those of the items before they are made distinct, so that few are moved; the items'
    are broadcast if there are not too many.
    """
    theirs = saved(kmers(items.select(F.col(item_id).alias("item"), F.col(item_seq).alias("seq")), k, ["item"]).select("item", "kmer").distinct())
    if theirs.count() <= BROADCAST_KMERS:
        theirs = F.broadcast(theirs)
    mine = kmers(docs.select(F.col(doc_id).alias("doc"), F.col(doc_seq).alias("seq")), k, ["doc"]).select("doc", "kmer")
    return mine.join(theirs, "kmer").select("doc", "item", "kmer").distinct().groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"))
