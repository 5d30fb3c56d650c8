"""Near-dedup by SimHash and by words: of each group of near copies one document stays.

Documents are near copies if their fingerprints link (``simhash``), and so are those left whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more, all of them.  One pass over the texts makes a sketch of each: fingerprint, size of
its set, a parity bitmap of it and its prefix.  All that follows moves sketches; texts move once, in the end.

Shingles are XXH64 values in one order for all documents.  Two sets as similar as that share one of the first
p = n - ceil(0.8 n) + 1 of their n shingles, whatever the order is, so documents are compared only where these prefixes meet.
The order: first the shingles in the lowest ``SHARE`` of the values' range that ``RARE`` documents hold at most, by how many do;
then, for the documents that these don't give a prefix, all others, by how many of *these* documents hold them; last, by value,
those that many of a sample of documents hold.  Share, limit and sample have a say in the cost only.  A sketch holds the shingles of
the share; what else the documents without a prefix hold is taken from their texts, once it is known which they are.  Counts
come from an exchange of shingles by value, which what one text alone has does not leave.  So a prefix holds a frequent shingle
only if the document has too few others in all, however many documents there are.  Shingles that the same documents hold (a shared
passage, a copy) are one, with their number as its weight: documents meet in it once.  Where two sets first meet, at places i and
j, they share at most min(n - i, m - j) shingles, which rules out most meetings.  A pair's bitmaps differ in no more bits than
its sets differ in shingles, so bitmaps rule out nearly all other pairs; the rest are compared by their whole sets.

Pairs of a bucket (documents that meet in a shingle) come in rounds: the first takes its smallest key against all, each later one
the next ``CENTERS`` keys, which then leave the bucket, until its documents are connected or done.  So a round makes at most
``CENTERS`` pairs for a row, and nothing is capped or dropped.

Defined cases: a text of fewer words than a shingle is one shingle; a text without words (or null) is like no other by words.
Rows without an id stay only where their group has no id.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import arrow_column, as_bytes, give_back, own_columns, saved, session_of, stored
from .components import connected_components, few_components
from .simhash import SEED, fingerprint, heads, keep_rows, owners

SHINGLE = 5
#: Documents of the sample (about), and how many of them hold a shingle that comes last.
SAMPLE, COMMON = 10_000, 10
#: The share of the hash values' range whose shingles come first, by their counts: more than a prefix is of a set (0.2), since it
#: has to hold enough shingles that no other text has.
SHARE = 0.3
#: Documents that hold a shingle that comes first, at most.
RARE = 16
#: Texts that are sketched before their words are let go of.
SLICE = 50
#: Keys of a bucket that are compared with all of it in a round.
CENTERS = 64
#: Edges up to which components are found in one task.
FEW = 1_000_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    size = min(shingle, len(words))
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))], np.uint64).view(np.int64))


def parity(values: np.ndarray) -> bytes:
    """A bit for each residue of the values: whether an odd number of them has it. As many bits as values, up to twice."""
    size = max(64, 1 << max(0, len(values) - 1).bit_length())
    return np.packbits(np.bincount(values & (size - 1), minlength=size) & 1 == 1, bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """In how many values two sets differ, at least. A larger bitmap is folded to the size of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for bits in (8 * len(a) >> k for k in range(1, (len(a) // len(b)).bit_length())):
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in texts:
        yield _lists([shingles(t) for t in as_bytes(text)])
    give_back()


_SKETCH = "struct<print:bigint,n:bigint,bits:binary,first:array<bigint>>"
_OTHERS = "struct<others:array<bigint>,late:array<bigint>>"
#: Shingles of a prefix.
_PREFIX = "(n - (4 * n + 4) div 5 + 1)"
_LIMIT = int(SHARE * 2**64) - 2**63


def split(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set in order: its shingles of the share, its others, and those of common (in order), which are in neither."""
    at = np.searchsorted(common, s)
    late = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    early = s[~late]
    k = int(np.searchsorted(early, _LIMIT))
    return early[:k], early[k:], s[late]


def sketches(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, prints: bool = True) -> tuple[DataFrame, Broadcast]:
    """id, hash (of the text), print, n, bits, first (shingles of the share) of every document, written once; the shingles that come last."""
    spark = session_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    some = rows.filter(F.pmod("hash", F.lit(max(1, rows.count() // sample))) == 0)
    often = some.select("hash", arrow_column(_sets, "array<bigint>", F.col("text")).alias("s")).dropDuplicates(["hash"])
    often = often.select(F.explode("s").alias("x")).groupBy("x").count().filter(F.col("count") >= COMMON)
    last = spark.sparkContext.broadcast(np.sort(np.array([r.x for r in often.select("x").collect()], np.int64)))

    def sketch_some(text: pa.Array) -> pa.Array:
        out, firsts = [[], [], []], []
        for t in as_bytes(text):
            s = shingles(t)
            firsts.append(split(s, last.value)[0])
            for c, x in zip(out, (np.array(fingerprint(t) if prints else 0, np.uint64).view(np.int64), len(s), parity(s))):
                c.append(x)
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), _lists(firsts)]
        return pa.StructArray.from_arrays(columns, ["print", "n", "bits", "first"])

    def sketch(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.concat_arrays([sketch_some(text.slice(k, SLICE)) for k in range(0, max(1, len(text)), SLICE)])
        give_back()

    return stored(rows.select("id", "hash", arrow_column(sketch, _SKETCH, F.col("text")).alias("s")).select("id", "hash", "s.*"), "sketches"), last


def _near(left_bits: pa.Array, right_bits: pa.Array, n: pa.Array) -> pa.Array:
    """Whether bitmaps let sets of n elements together be alike: then these differ in at most a ninth of n."""
    return pa.array([9 * differ(a, b) <= k for a, b, k in zip(left_bits.to_pylist(), right_bits.to_pylist(), n.to_pylist())], pa.bool_())


def _one_each(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (id, key, ...) of wanted (id, key; no key twice), one for each. By both: all copies of a text have its key, and would meet
    in one task only to be let go of. The two as one hash, which null ids have too, so that one exchange serves join and choice."""
    both = F.xxhash64("id", "key").alias("__both")
    return rows.select("*", both).join(wanted.select("key", both), ["key", "__both"], "left_semi").dropDuplicates(["key", "__both"]).drop("__both")


def _alike(pairs: DataFrame, kept: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of keys, no pair twice, those whose sets are alike. kept: id, key, n, bits; texts: id, key, text."""
    side = lambda k: kept.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    both = pairs.join(side("a"), "a").filter("na > 0").join(side("b"), "b").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
    near = stored(both.filter(arrow_column(_near, "boolean", F.col("bitsa"), F.col("bitsb"), F.col("na") + F.col("nb"))).select("a", "b"), "near")
    if near.isEmpty():
        return near
    keys = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    wanted = stored(kept.select("id", "key").join(keys, "key", "left_semi"), "wanted")  # mostly few: known once they are written
    sets = stored(_one_each(texts, wanted).select("key", arrow_column(_sets, "array<bigint>", F.col("text")).alias("set")), "sets")
    both = near.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return stored(shared.filter("5 * shared >= 4 * (n - shared)").select("a", "b"), "edges")


def _classes(rows: DataFrame) -> DataFrame:
    """key, c, x, w: of rows (x, key, w; no x of a key twice) those that the same c > 1 keys hold as one, the smallest, of all their weight."""
    bucket = Window.partitionBy("x")
    holders = [F.count(F.lit(1)).over(bucket).alias("c"), F.bit_xor("key").over(bucket).alias("s"), F.bit_xor(F.xxhash64("key")).over(bucket).alias("t")]
    return rows.select("x", "key", "w", *holders).filter("c > 1").groupBy("key", "c", "s", "t").agg(F.min("x").alias("x"), F.sum("w").alias("w")).drop("s", "t")


def _placed(rows: DataFrame) -> DataFrame:
    """x, key, n, rest of rows (key, c, x, w, n, end) in prefixes: from how many shingles on. end: the place after the last of a key, counting
    those that it alone has, which come first and are no rows."""
    after = Window.partitionBy("key").orderBy(F.desc("c"), F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.col("end") - F.sum("w").over(after))
    return rows.filter(f"at < {_PREFIX}").select("x", "key", "n", (F.col("n") - F.col("at")).alias("rest"))


def _others(needy: DataFrame, texts: DataFrame, common: Broadcast) -> DataFrame:
    """needy (id, key, n), others (shingles neither of the share nor common), late (as many common ones as a prefix has beyond the rest)."""

    def others(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            rest, late = [], []
            for t in as_bytes(text):
                s = shingles(t)
                first, other, last = split(s, common.value)
                rest.append(other)
                late.append(last[: max(0, len(s) - (4 * len(s) + 4) // 5 + 1 - len(first) - len(other))])
            yield pa.StructArray.from_arrays([_lists(rest), _lists(late)], ["others", "late"])
        give_back()

    rows = _one_each(texts, needy)
    return stored(rows.select("key", arrow_column(others, _OTHERS, F.col("text")).alias("o")).select("key", "o.*").join(needy.drop("id"), "key"), "others")


def meetings(marked: DataFrame, kept: DataFrame, texts: DataFrame, common: Broadcast) -> DataFrame:
    """x, key, n, rest: the shingles where prefixes of kept documents meet, and of how many shingles x is the first, at most.

    marked: hash, first; kept: id, key (distinct), n, own (the size of first); texts: id, key, text.
    """
    bucket = Window.partitionBy("x")
    rows = marked.select("hash", F.explode("first").alias("x"))
    rows = rows.select("x", F.col("hash").alias("key"), (F.min("hash").over(bucket) != F.max("hash").over(bucket)).alias("met"))
    rows = stored(rows.filter("met").drop("met"), "repeated")
    held = _classes(rows.join(kept.select("key"), "key", "left_semi").distinct().withColumn("w", F.lit(1).cast("bigint")))
    held = stored(held, "held")
    often = held.filter(F.col("c") > RARE)
    sizes = kept.filter("n > 0").join(often.groupBy("key").agg(F.sum("w").alias("often")), "key", "left")
    sizes = stored(sizes.select("id", "key", "n", "own", (F.col("own") - F.coalesce("often", F.lit(0))).alias("rare")), "sizes")
    first = _placed(held.filter(F.col("c") <= RARE).join(sizes.select("key", "n", F.col("rare").alias("end")), "key"))
    needy = _others(stored(sizes.filter(f"rare < {_PREFIX}").select("id", "key", "n", "own"), "needy"), texts, common)
    ends = needy.select("key", "n", (F.col("own") + F.size("others")).alias("end"))
    rows = needy.select("key", F.explode("others").alias("x"), F.lit(1).cast("bigint").alias("w"))
    rows = rows.unionByName(often.join(needy.select("key"), "key", "left_semi").select("key", "x", "w"))
    second = _placed(_classes(rows).join(ends, "key"))
    last = needy.select("key", "n", (F.col("own") + F.size("others")).alias("end"), F.posexplode("late").alias("k", "x"))
    last = last.select("x", "key", "n", (F.col("n") - F.col("end") - F.col("k")).alias("rest"))
    rows = first.unionByName(second).unionByName(last).withColumn("able", _able(bucket)).filter("able")
    return stored(rows.select("x", "key", "n", "rest", F.count(F.lit(1)).over(bucket).alias("c")).filter("c > 1").drop("c"), "met")


def _able(bucket: WindowSpec) -> Column:
    """Whether some row of the bucket may be alike, from its smallest set and the most that any can share."""
    return 9 * F.least("rest", F.max("rest").over(bucket)) >= 4 * (F.col("n") + F.min("n").over(bucket))


def _reach(n: str, rest: str, other_n: str, other_rest: str) -> Column:
    """Whether sets that first meet there can be alike: they share 4 of 9 of their shingles then."""
    return F.expr(f"9 * least({rest}, {other_rest}) >= 4 * ({n} + {other_n})")


def _roots(edges: DataFrame) -> DataFrame:
    return few_components(edges) if edges.count() <= FEW else stored(connected_components(edges), "roots")


def similar(kept: DataFrame, met: DataFrame, texts: DataFrame, centers: int = CENTERS) -> DataFrame:
    """node, root: the components that pairs of similarity 0.8 or more make. kept: id, key (distinct), n, bits; met: see ``meetings``; texts: id, key, text."""
    bucket = Window.partitionBy("x")
    met = met.withColumn("center", F.min(F.struct("key", "n", "rest")).over(bucket)).filter(F.col("key") != F.col("center.key"))
    pairs = met.filter(_reach("n", "rest", "center.n", "center.rest")).select(F.col("center.key").alias("a"), F.col("key").alias("b"))
    edges = _alike(pairs.distinct(), kept, texts)
    roots = _roots(edges)
    met = met.drop("center")
    while True:
        left = met.join(roots.withColumnRenamed("node", "key"), "key", "left").select("x", "key", "n", "rest", F.coalesce("root", "key").alias("root"))
        left = left.select("*", (F.min("root").over(bucket) != F.max("root").over(bucket)).alias("apart"), _able(bucket).alias("able"))
        left = left.filter("apart and able").select("x", "key", "n", "rest", "root", F.row_number().over(bucket.orderBy("key")).alias("place"))
        left = stored(left, "left")
        if left.isEmpty():
            return roots
        first = left.filter(F.col("place") <= centers).select("x", F.col("key").alias("a"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("rest").alias("s"))
        pairs = left.join(first, "x").filter("a < key and r <> root").filter(_reach("n", "rest", "m", "s")).select("a", F.col("key").alias("b"))
        more = _alike(pairs.distinct(), kept, texts)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = _roots(edges)
        met = left.filter(F.col("place") > centers).select("x", "key", "n", "rest")


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written: nothing reads them later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _kept_of_groups(best: DataFrame, marked: DataFrame, texts: DataFrame, common: Broadcast, centers: int) -> DataFrame:
    """id, hash: of best (id, hash, no hash twice) what stays when groups of similar sets keep their smallest id."""
    with _tidy(session_of(marked)):
        kept = stored(_one_each(marked.select("id", F.col("hash").alias("key"), "n", "bits", F.size("first").alias("own")), best.withColumnRenamed("hash", "key")), "kept")
        roots = similar(kept, meetings(marked, kept, texts, common), texts, centers)
        rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
        ranked = best.join(roots, F.col("hash") == F.col("node"), "left").select(F.coalesce("root", "hash").alias("root"), rank.alias("rank"))
        return stored(ranked.groupBy("root").agg(F.min("rank").alias("r")).select("r.id", "r.hash"), "best")


@own_columns
def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE, centers: int = CENTERS) -> DataFrame:
    """docs, all columns, with one document of each group: first by SimHash links, then of those left by five-word shingles."""
    marked, common = sketches(docs, id_col, text_col, sample)
    best = heads(marked, owners(marked, components=_roots))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return keep_rows(docs, _kept_of_groups(best, marked, texts, common, centers), marked, id_col, text_col)


@own_columns
def jaccard_dedup(docs: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE, centers: int = CENTERS) -> DataFrame:
    """docs, all columns, with one document of each group by five-word shingles alone; of equal texts one stays too."""
    marked, common = sketches(docs, id_col, text_col, sample, prints=False)
    rank = F.struct(F.col("id").isNull().alias("none"), "id")
    best = saved(marked.groupBy("hash").agg(F.min(rank).alias("r")).select("r.id", "hash"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return keep_rows(docs, _kept_of_groups(best, marked, texts, common, centers), marked, id_col, text_col)
