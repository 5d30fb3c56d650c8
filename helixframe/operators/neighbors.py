"""Approximate matches: pairs of k-mers within a Hamming distance, and what they say about each k-mer.

Two symbols mismatch if they differ or the first is the unknown one (N), so N costs one even against N.

Pigeonhole: of tau + s fragments of a k-mer, s at least are free of tau mismatches, and so equal in both and without N.
Pairs come from an equi-join on s fragments at a time, and only from the first s that they share, so no pair is
made twice.  With s = 1 there are tau + 1 short keys for each k-mer; a larger s gives more and longer
keys, and is taken where short ones would bring too many k-mers together.  A key that brings too many together all the
same (a run of one letter) is no key of its own: what is left of its k-mers is cut into fragments again, and they meet by
the first key and one of these, as deep as it takes.  K-mers are packed two bits a symbol once each, and pairs are
verified with a few bit operations.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.shared import saved
from .kmers import LONG, distinct_kmers, kmers, longest, unknown_count
from .text import both_strands

#: Symbols in a 64-bit word.
PACK = 31
ODD_BITS = 0x5555555555555555
MOST_TAU, LEAST_K, MOST_K = 3, 2, 254
#: K-mers that share a key, on average, and the most fragments in a key.
BUCKET, MOST_SHARED = 16, 3
#: Pairs that one key makes at most, before what is left of its k-mers is cut again.
KEY_PAIRS = 1 << 18
#: Hot keys that are sent to all tasks at most; more are joined.
SENT_KEYS = 100_000


def check_parameters(k: int, tau: int, any_tau: bool = False) -> None:
    if not LEAST_K <= k <= MOST_K:
        raise ValueError(f"k is {LEAST_K} to {MOST_K}")
    if tau < 1 or tau >= k or (tau > MOST_TAU and not any_tau):
        raise ValueError(f"the distance is 1 to {MOST_TAU} and less than k")


def _segments(k: int) -> list[tuple[int, int]]:
    return [(i, min(PACK, k - i)) for i in range(0, k, PACK)]


def packed(kmer: Column, k: int, alphabet: Alphabet = DNA) -> tuple[Column, Column]:
    """Arrays of words: two bits for each symbol, and 01 at each unknown one. Needs four symbols and an unknown one."""
    known = [c for c in alphabet.canonical if c != alphabet.unknown]
    if len(known) > 4:
        raise ValueError("packing takes four symbols besides the unknown one")
    digits, flags = "".join(map(str, range(len(known)))), "0" * len(known)
    letters = "".join(known)
    unknown = alphabet.unknown or ""
    word = lambda part, to: F.conv(F.translate(part, letters + unknown, to), 4, 10).cast("bigint")
    parts = [F.substring(kmer, i + 1, n) for i, n in _segments(k)]
    return F.array(*[word(p, digits + "0" * len(unknown)) for p in parts]), F.array(*[word(p, flags + "1" * len(unknown)) for p in parts])


def _differences(k: int) -> Column:
    """Words with 01 at each mismatch of the packed a_bits/a_unknown and b_bits/b_unknown."""
    out = []
    for i in range(len(_segments(k))):
        x = F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])
        one = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ODD_BITS))
        out.append(one.bitwiseOR(F.col("a_unknown")[i]).bitwiseOR(F.col("b_unknown")[i]))
    return F.array(*out)


def positions_of(words: Column, k: int) -> Column:
    """The places, from 0, that are set in an array of words."""
    spans = _segments(k)
    starts = F.array(*[F.lit(i) for i, _ in spans])
    sizes = F.array(*[F.lit(n) for _, n in spans])
    seg = lambda p: (p / PACK).cast("int")
    bit = lambda p: 2 * (F.get(sizes, seg(p)) - 1 - (p - F.get(starts, seg(p))))
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: F.getbit(F.get(words, seg(p)), bit(p)) == 1)


def _fragments(k: int, count: int) -> list[tuple[int, int]]:
    cuts = [k * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def shared_fragments(k: int, tau: int, rows: int, symbols: int = 4) -> int:
    """How many fragments to join on: the fewest whose keys bring BUCKET k-mers together on average at most."""
    for s in range(1, MOST_SHARED):
        if tau + s >= k or symbols ** (s * k // (tau + s)) * BUCKET >= rows:
            return s
    return min(MOST_SHARED, k - tau)


def _placed(rows: DataFrame, kmer_col: str, k: int, tau: int, shared: int, side: str, alphabet: Alphabet) -> DataFrame:
    """A row for each choice of fragments without unknown symbols: kmer, bits, unknown, the choice (as bits) and its text."""
    bits, unknown = packed(F.col(kmer_col), k, alphabet)
    parts = _fragments(k, tau + shared)
    keys = [
        F.struct(F.lit(sum(1 << i for i in choice)).alias("choice"), F.concat(*[F.substring(kmer_col, parts[i][0] + 1, parts[i][1]) for i in choice]).alias("text"))
        for choice in combinations(range(tau + shared), shared)
    ]
    found = F.array(*keys)
    if alphabet.unknown is not None:
        found = F.filter(found, lambda f: F.instr(f["text"], alphabet.unknown) == 0)
    return rows.select(F.col(kmer_col).alias(side), bits.alias(f"{side}_bits"), unknown.alias(f"{side}_unknown"), F.explode(found).alias("f")).select(side, f"{side}_bits", f"{side}_unknown", "f.choice", "f.text")


def _hot(one: DataFrame, two: DataFrame | None, keys: list[str]) -> tuple[DataFrame, int]:
    """The keys by which more than KEY_PAIRS pairs would meet, and how many there are. Without two, one meets itself."""
    counts = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if two is None:
        counts = counts.withColumn("m", F.col("n"))
    else:
        counts = counts.join(two.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    hot = saved(counts.filter(F.col("n").cast("double") * F.col("m") > KEY_PAIRS).select(*keys))
    size = hot.count()
    return (F.broadcast(hot) if size <= SENT_KEYS else hot), size


def _bounds(length: Column, i: int, count: int) -> tuple[Column, Column]:
    """Where the i-th of count fragments of a text of that length begins (from 0), and its length."""
    begin, end = (F.floor(length * F.lit(x) / count).cast("int") for x in (i, i + 1))
    return begin, end - begin


def _left_over(kmer: str, k: int, tau: int, shared: int) -> Column:
    """A k-mer without the fragments of the row's choice."""
    parts = _fragments(k, tau + shared)
    out = F.lit(None).cast("string")
    for choice in combinations(range(tau + shared), shared):
        kept = [F.substring(kmer, first + 1, n) for i, (first, n) in enumerate(parts) if i not in choice]
        out = F.when(F.col("choice") == sum(1 << i for i in choice), F.concat(*kept) if kept else F.lit("")).otherwise(out)
    return out


def _cut_again(rows: DataFrame, tau: int, shared: int, side: str, alphabet: Alphabet, depth: int) -> DataFrame:
    """Rows of hot keys, once for each choice of clean fragments of what is left of their k-mers.

    text grows by the choice and its fragments, next{depth} is the choice, {side}_was{depth} what was left before it.
    """
    rest, count = F.col(f"{side}_left"), tau + shared
    span = [_bounds(F.length(rest), i, count) for i in range(count)]
    part = [F.substring(rest, begin + 1, n) for begin, n in span]
    found = F.array(
        *[
            F.struct(
                F.lit(sum(1 << i for i in choice)).alias("next"),
                F.concat(*[part[i] for i in choice]).alias("own"),
                F.concat(F.lit(""), *[part[i] for i in range(count) if i not in choice]).alias("left"),
            )
            for choice in combinations(range(count), shared)
        ]
    )
    if alphabet.unknown is not None:
        found = F.filter(found, lambda f: F.instr(f["own"], alphabet.unknown) == 0)
    fixed = [c for c in rows.columns if c not in ("text", f"{side}_left")]
    cut = rows.select(*fixed, "text", rest.alias(f"{side}_was{depth}"), F.explode(found).alias("f"))
    text = F.concat("text", F.lit("|"), F.col("f.next").cast("string"), F.lit(":"), "f.own")
    return cut.select(*fixed, f"{side}_was{depth}", text.alias("text"), F.col("f.next").alias(f"next{depth}"), F.col("f.left").alias(f"{side}_left"))


def _up_to(choice: Column, count: int) -> Column:
    """The bits of all fragments up to the last of a choice."""
    return reduce(lambda p, i: F.when(choice >= 1 << i, (2 << i) - 1).otherwise(p), range(count), F.lit(0))


def _first_shared(tau: int, shared: int, alphabet: Alphabet, depth: int) -> Column:
    """Whether the fragments that a pair was brought together by are the first that it shares at this depth."""
    was, count, equal = (F.col(f"a_was{depth}"), F.col(f"b_was{depth}")), tau + shared, F.lit(0)
    for i in range(count):
        begin, n = _bounds(F.length(was[0]), i, count)
        x, y = (F.substring(w, begin + 1, n) for w in was)
        clean = x == y if alphabet.unknown is None else (x == y) & (F.instr(x, alphabet.unknown) == 0)
        equal = equal + F.when(clean, 1 << i).otherwise(0)
    choice = F.col(f"next{depth}")
    return equal.bitwiseAND(_up_to(choice, count)) == choice


def _lengths_left(lengths: set[int], tau: int, shared: int) -> set[int]:
    """How long what is left can be, whatever the choice."""
    return {n - sum(_fragments(n, tau + shared)[i][1] for i in choice) for n in lengths for choice in combinations(range(tau + shared), shared)}


def _met(one: DataFrame, two: DataFrame | None, k: int, tau: int, shared: int, alphabet: Alphabet, below: bool) -> DataFrame:
    """choice, a, b and their packed words: pairs that share fragments, by keys of KEY_PAIRS pairs at most. Without two, one meets itself.

    A pair under a hot key has all its mismatches, tau at most, in what the key leaves of its k-mers, so that is cut as
    k-mers are. At each depth a pair counts for the first fragments that it shares there, so it is met once under each first
    choice. Where tau symbols or fewer are left nothing can be cut, and few k-mers differ.
    """
    keys, out = ["choice", "text"], ["choice", "a", "b", "a_bits", "a_unknown", "b_bits", "b_unknown"]
    parts, firsts, depth, lengths = [], [], 0, {k}

    def meet(left: DataFrame, right: DataFrame | None) -> None:
        if right is None:
            right = one.toDF(*["b" + c[1:] if c == "a" or c.startswith("a_") else c for c in one.columns])
        pairs = left.join(right.select(*keys, *[c for c in right.columns if c == "b" or c.startswith("b_")]), keys)
        for first in [F.col("a") < F.col("b")] * below + firsts:
            pairs = pairs.filter(first)
        parts.append(pairs.select(*out))

    while True:
        hot, size = _hot(one, two, keys)
        meet(one.join(hot, keys, "left_anti") if size else one, two)
        lengths = _lengths_left(lengths, tau, shared)
        if not size:
            return reduce(DataFrame.unionByName, parts)
        one, two = one.join(hot, keys, "left_semi"), None if two is None else two.join(hot, keys, "left_semi")
        if not depth:
            one, two = (None if x is None else x.withColumn(f"{side}_left", _left_over(side, k, tau, shared)) for x, side in ((one, "a"), (two, "b")))
        if min(lengths) <= tau:
            meet(one.filter(F.length("a_left") <= tau), two)
            lengths = {n for n in lengths if n > tau}
            one, two = (None if x is None else x.filter(F.length(f"{side}_left") > tau) for x, side in ((one, "a"), (two, "b")))
        if not lengths:
            return reduce(DataFrame.unionByName, parts)
        depth, shared = depth + 1, min(shared, min(lengths) - tau)
        one, two = (None if x is None else saved(_cut_again(x, tau, shared, side, alphabet, depth)) for x, side in ((one, "a"), (two, "b")))
        firsts.append(_first_shared(tau, shared, alphabet, depth))


def hamming_join(left: DataFrame, right: DataFrame, k: int, tau: int, left_col: str = "kmer", right_col: str = "kmer", alphabet: Alphabet = DNA, below: bool = False, shared: int = 1) -> DataFrame:
    """a, b, dist, mism (words): pairs of distinct k-mers of left and right within tau mismatches.

    Equal ones count too, unless `below`, which takes pairs with a < b only (for a join with itself). `shared` is
    the number of fragments to join on; the result doesn't depend on it, nor on KEY_PAIRS.
    """
    if not 1 <= shared <= k - tau:
        raise ValueError("there are not so many fragments")
    one = _placed(left, left_col, k, tau, shared, "a", alphabet)
    two = None if left is right and left_col == right_col else _placed(right, right_col, k, tau, shared, "b", alphabet)
    pairs = _met(one, two, k, tau, shared, alphabet, below).select("choice", "a", "b", _differences(k).alias("mism"))
    dist = reduce(lambda p, q: p + q, [F.bit_count(F.col("mism")[i]) for i in range(len(_segments(k)))])
    near = pairs.select("choice", "a", "b", dist.cast("int").alias("dist"), "mism").filter(F.col("dist") <= tau)
    equal = F.lit(0)  # the fragments without a mismatch, as bits
    for i, (first, n) in enumerate(_fragments(k, tau + shared)):
        clean = F.lit(True)
        for w, (begin, size) in enumerate(_segments(k)):
            mask = sum(1 << 2 * (size - 1 - (p - begin)) for p in range(max(first, begin), min(first + n, begin + size)))
            if mask:
                clean = clean & (F.col("mism")[w].bitwiseAND(F.lit(mask)) == 0)
        equal = equal + F.when(clean, 1 << i).otherwise(0)
    # a pair counts where its choice is all that it shares up to the choice's last fragment
    return near.filter(equal.bitwiseAND(_up_to(F.col("choice"), tau + shared)) == F.col("choice")).select("a", "b", "dist", "mism")


def text_kmers(seqs: DataFrame, k: int, tau: int | None = None, alphabet: Alphabet = DNA) -> DataFrame:
    """The distinct k-mers of both strands, without those of more than tau unknown symbols."""
    found = distinct_kmers(both_strands(seqs.select("seq_id", "seq"), alphabet), k, longest(seqs) > LONG)
    return found if tau is None else found.filter(unknown_count("kmer", alphabet) <= tau)


def hamming_pairs(seqs: DataFrame, k: int, tau: int, alphabet: Alphabet = DNA) -> DataFrame:
    """a, b, dist, mism: unordered pairs (a < b) of distinct k-mers of both strands within tau mismatches."""
    check_parameters(k, tau)
    found = saved(text_kmers(seqs, k, tau, alphabet))
    return hamming_join(found, found, k, tau, alphabet=alphabet, below=True, shared=shared_fragments(k, tau, found.count()))


def search(queries: DataFrame, seqs: DataFrame, k: int, tau: int, alphabet: Alphabet = DNA, free_unknown: bool = True, boundary: bool = False) -> DataFrame:
    """query, hit, dist, mism: k-mers of both strands within tau substitutions of each query.

    With boundary only hits that do not sort after the query, so that each pair of k-mers is seen once.

    With free_unknown an unknown symbol in the query matches anything at no cost, though its place is marked. A query without
    a known symbol more than tau would match everything and raises; null queries have no hits.
    Queries and k-mers are compared piece by piece through fragments; queries with unknown symbols choose their own.
    """
    check_parameters(k, tau)
    if boundary:
        every = search(queries, seqs, k, tau, alphabet, free_unknown)
        return every.filter(alphabet.sort_key("hit") <= alphabet.sort_key("query"))
    found = saved(text_kmers(seqs, k, None, alphabet))
    wanted = queries.select(F.col("query")).distinct()
    rows = found.count()

    def plain(some: DataFrame) -> DataFrame:
        return hamming_join(some, found, k, tau, "query", "kmer", alphabet, shared=shared_fragments(k, tau, rows)).select(F.col("a").alias("query"), F.col("b").alias("hit"), "dist", "mism")

    if not free_unknown or alphabet.unknown is None:
        return plain(wanted)
    wanted = saved(wanted)
    free = unknown_count("query", alphabet)
    n, wild, most = wanted.agg(F.count("query"), F.count(F.when(free > 0, 1)), F.coalesce(F.max(free), F.lit(0))).first()
    if most >= k - tau:
        raise ValueError("a query of unknown symbols matches everything")
    if not wild:
        return plain(wanted)
    hits = _wildcard_hits(wanted.filter(free > 0), found, k, tau, alphabet)
    return hits if wild == n else hits.unionByName(plain(wanted.filter(free == 0)))


def _blocks(k: int, level: int) -> Column:
    """The blocks of 2^level places, the last one cut off at k: level, begin (from 0), size."""
    size = 1 << level
    each = F.sequence(F.lit(0), F.lit((k - 1) // size))
    return F.transform(each, lambda i: F.struct(F.lit(level).alias("level"), (i * size).alias("begin"), F.least(F.lit(size), F.lit(k) - i * size).alias("size")))


def _place(text: Column, block: Column) -> Column:
    return F.substring(text, block["begin"] + 1, block["size"])


def _chosen_blocks(text: Column, k: int, tau: int, unknown: str) -> Column:
    """tau + 1 blocks (begin, size) without unknown symbols, none over another, so that the smallest is as large as it can be.

    Of blocks of up to 2^l places those are taken that no clean block of up to 2^l places holds; l is the one that serves best.
    """
    clean = lambda begin, size: F.instr(F.substring(text, begin + 1, size), unknown) == 0

    def choice(top: int) -> Column:
        def taken(b: Column) -> Column:
            size = F.pow(F.lit(2), b["level"] + 1).cast("int")  # of the block that holds it
            begin = (F.floor(b["begin"] / size) * size).cast("int")
            return clean(b["begin"], b["size"]) & ((b["level"] == top) | ~clean(begin, size))

        some = F.filter(F.concat(*[_blocks(k, level) for level in range(top + 1)]), taken)
        sized = F.array_sort(F.transform(some, lambda b: F.struct((-b["size"]).alias("less"), b["begin"].alias("begin"), b["size"].alias("size"))))
        picks = F.transform(F.slice(sized, 1, tau + 1), lambda b: F.struct(b["begin"].alias("begin"), b["size"].alias("size")))
        least = F.when(F.size(picks) == tau + 1, F.element_at(picks, -1)["size"]).otherwise(0)
        return F.struct(least.alias("least"), F.lit(top).alias("top"), picks.alias("picks"))

    return F.array_max(F.array(*map(choice, range((k - 1).bit_length() + 1))))["picks"]


def _wildcard_hits(wanted: DataFrame, found: DataFrame, k: int, tau: int, alphabet: Alphabet) -> DataFrame:
    """query, hit, dist, mism of queries with unknown symbols, which cost nothing; all have more than tau known ones.

    Each query picks tau + 1 blocks of a fixed grid that hold no unknown symbol; one of them is free of mismatches. K-mers
    have a row for each block that some query picked, fewer than 2 k + log k kinds whatever the queries, and a pair counts
    at the first block that it shares. What a key of more than KEY_PAIRS pairs leaves of its queries picks blocks again, as deep as
    it takes, so all kinds of places go through the same joins.
    """
    unknown = alphabet.unknown
    one = wanted.select("query", F.col("query").alias("left"), F.lit("").alias("key"), F.expr("cast(array() as array<struct<begin:int,size:int>>)").alias("before"))
    two = found.select(F.col("kmer").alias("hit"), F.lit("").alias("key"))
    parts, depth = [], 0

    def meet(queries: DataFrame, hits: DataFrame) -> None:
        pairs = queries.join(hits, "key").filter(~F.exists("before", lambda b: _place(F.col("query"), b) == _place(F.col("hit"), b)))
        a, a_unknown = packed(F.col("query"), k, alphabet)
        b, b_unknown = packed(F.col("hit"), k, alphabet)
        compared = pairs.select("query", "hit", a.alias("a_bits"), a_unknown.alias("a_unknown"), b.alias("b_bits"), b_unknown.alias("b_unknown"))
        compared = compared.select("query", "hit", _differences(k).alias("mism"))
        marked = reduce(lambda p, q: p + q, [F.bit_count(F.col("mism")[i]) for i in range(len(_segments(k)))])
        dist = (marked - unknown_count("query", alphabet)).cast("int")
        parts.append(compared.select("query", "hit", dist.alias("dist"), "mism").filter(F.col("dist") <= tau))

    while True:
        picked = one.select("query", "left", "key", "before", _chosen_blocks(F.col("left"), k, tau, unknown).alias("picks"))
        picked = picked.select("query", "left", F.col("key").alias("was"), "before", "picks", F.posexplode("picks").alias("nth", "b"))
        own = lambda text: F.concat_ws(":", "was", F.col("b.begin").cast("string"), F.col("b.size").cast("string"), _place(F.col(text), F.col("b")))
        covered = F.concat(F.substring("left", F.lit(1), F.col("b.begin")), F.repeat(F.lit(unknown), F.col("b.size")), F.substring("left", F.col("b.begin") + F.col("b.size") + 1, F.lit(k)))
        one = saved(picked.select("query", covered.alias("left"), own("left").alias("key"), F.concat("before", F.slice("picks", F.lit(1), F.col("nth"))).alias("before"), "was", "b"))
        kinds = one.select("was", "b").distinct()
        kinds = F.broadcast(kinds) if not depth or kinds.count() <= SENT_KEYS else kinds  # at first a kind for each block of the grid
        grid = F.array_distinct(F.transform(F.concat(*[_blocks(k, level) for level in range((k - 1).bit_length() + 1)]), lambda b: F.struct(b["begin"].alias("begin"), b["size"].alias("size"))))
        each = two.select("hit", F.col("key").alias("was"), F.explode(grid).alias("b")).join(kinds, ["was", "b"], "left_semi")
        two = each.select("hit", own("hit").alias("key"))
        keys = one.select("key").distinct()
        two = two.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, "key", "left_semi")  # k-mers that no query meets aren't moved
        two = saved(two) if depth else two
        one = one.drop("was", "b")
        hot, size = _hot(one, two, ["key"])
        meet(one.join(hot, "key", "left_anti") if size else one, two)
        if size:
            one, two = one.join(hot, "key", "left_semi"), two.join(hot, "key", "left_semi")
            few = F.lit(k) - unknown_count("left", alphabet) <= tau  # nothing can be picked, and few places are left to differ
            meet(one.filter(few), two)
            one = one.filter(~few)
        if not size or one.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        depth += 1


def within(hits: DataFrame, k: int, begin: int, end: int, tau: int, score_ref: int = 0, score_diff: int = 0) -> DataFrame:
    """Of hits (dist, mism) those whose mismatches all stand in the places begin to end - 1, at most tau of them, and at
    least score_diff more than score_ref: what an extension to the right (end = k) or to the left (begin = 0) finds of a
    match that has score_ref mismatches already. tau counts all of a hit's mismatches."""
    if not 0 <= begin < end <= k:
        raise ValueError("the places are inside the query")
    outside = F.exists(positions_of(F.col("mism"), k), lambda p: (p < begin) | (p >= end))
    return hits.filter((F.col("dist") <= tau) & (F.col("dist") - score_ref >= score_diff) & ~outside)


def annotate(seqs: DataFrame, k: int, tau: int, alphabet: Alphabet = DNA) -> DataFrame:
    """kmer, dist, neigh_cnt, align_pos for every distinct k-mer of both strands with at most tau unknown symbols.

    dist is the least number of mismatches to another k-mer, 0 if none is within tau; neigh_cnt counts the k-mers
    at that distance; align_pos are the places where any of them differs, empty if more than max(3, tau).
    Mismatches are merged as bits, so a k-mer with many neighbours costs no list of them.
    """
    check_parameters(k, tau)
    found = saved(text_kmers(seqs, k, tau, alphabet))
    half = hamming_join(found, found, k, tau, alphabet=alphabet, below=True, shared=shared_fragments(k, tau, found.count()))
    pairs = half.select(F.explode(F.array("a", "b")).alias("kmer"), "dist", "mism")  # each pair once, seen from either side
    words = len(_segments(k))
    by = pairs.groupBy("kmer", "dist").agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(F.col("mism")[i]).alias(f"m{i}") for i in range(words)])
    best = by.groupBy("kmer").agg(F.min(F.struct("dist", "n", *[f"m{i}" for i in range(words)])).alias("x"))
    rows = found.join(best, "kmer", "left")
    places = positions_of(F.array(*[F.col(f"x.m{i}") for i in range(words)]), k)
    return rows.select(
        "kmer",
        F.coalesce("x.dist", F.lit(0)).alias("dist"),
        F.coalesce("x.n", F.lit(0)).alias("neigh_cnt"),
        F.when(F.col("x").isNull() | (F.size(places) > max(3, tau)), F.array().cast("array<int>")).otherwise(places).alias("align_pos"),
    )


def binned_count(count: Column) -> Column:
    """A count as the compact annotation keeps it: exact to 10, then the middle of its bin."""
    return (
        F.when(count <= 10, count).when(count <= 20, 15).when(count <= 50, 40).when(count <= 100, 75).when(count <= 500, 300).otherwise(1000)
    )


def annotation_binned(annotation: DataFrame) -> DataFrame:
    """kmer, dist, neigh_cnt as the compact annotation gives them."""
    return annotation.select("kmer", "dist", binned_count(F.col("neigh_cnt")).cast("bigint").alias("neigh_cnt"))


#: Fixed values of the compact annotation, a byte for each place of the forward strand: bits 0 to 3 the count's code, 4 and 5
#: the distance less one, 6 whether places are known, 7 whether a neighbour of some k-mer over this place differs here.
COUNT_CODES = ((10, None), (20, 11), (50, 12), (100, 13), (500, 14), (None, 15))
BIN_MIDDLES = {11: 15, 12: 40, 13: 75, 14: 300, 15: 1000}
DIST_SHIFT, KNOWN_BIT, MISMATCH_BIT = 4, 6, 7


def annotation_bytes(seqs: DataFrame, annotation: DataFrame, k: int) -> DataFrame:
    """pos, info (0 to 255): the compact annotation of every forward place of placed sequences that isn't 0."""
    loci = kmers(seqs.select("seq_id", "beg", "seq"), k, ["beg"], spread=longest(seqs) > LONG).select((F.col("beg") + F.col("off")).alias("pos"), "kmer")
    found = saved(loci.join(annotation.filter("dist > 0").select("kmer", "dist", "neigh_cnt", "align_pos"), "kmer").drop("kmer"))
    code = F.lit(COUNT_CODES[-1][1])
    for most, value in reversed(COUNT_CODES[:-1]):
        code = F.when(F.col("neigh_cnt") <= most, F.col("neigh_cnt") if value is None else F.lit(value)).otherwise(code)
    known = F.when(F.size("align_pos") > 0, 1 << KNOWN_BIT).otherwise(0)
    own = found.select("pos", code.bitwiseOR(F.shiftleft(F.col("dist") - 1, DIST_SHIFT)).bitwiseOR(known).cast("int").alias("info"))
    marks = found.select("pos", F.explode("align_pos").alias("i")).select((F.col("pos") + F.col("i")).alias("pos"), F.lit(1 << MISMATCH_BIT).alias("info"))
    return own.unionByName(marks).groupBy("pos").agg(F.bit_or("info").alias("info"))


def annotation_of_bytes(places: DataFrame, k: int) -> DataFrame:
    """pos, dist, neigh_cnt, align_pos as the compact annotation gives them: counts in bins, and the marks of every k-mer
    over a place, not only of the one that begins there."""
    code = F.col("info").bitwiseAND(15)
    count = code
    for value, middle in BIN_MIDDLES.items():
        count = F.when(code == value, middle).otherwise(count)
    here = places.filter(code > 0).select("pos", (F.shiftright("info", DIST_SHIFT).bitwiseAND(3) + 1).alias("dist"), count.cast("bigint").alias("neigh_cnt"), (F.shiftright("info", KNOWN_BIT).bitwiseAND(1) == 1).alias("known"))
    marks = places.filter(F.shiftright("info", MISMATCH_BIT).bitwiseAND(1) == 1).select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "pos").select((F.col("pos") - F.col("i")).alias("pos"), "i")
    listed = marks.groupBy("pos").agg(F.array_sort(F.collect_list("i")).alias("marks"))  # k places at most
    none = F.array().cast("array<int>")
    return here.join(listed, "pos", "left").select("pos", "dist", "neigh_cnt", F.when(F.col("known"), F.coalesce("marks", none)).otherwise(none).alias("align_pos"))


def annotation_query(labels: DataFrame, seqs: DataFrame, annotation: DataFrame, k: int, label_col: str = "label") -> DataFrame:
    """labels with dist, neigh_cnt, align_cnt, align_pos of the k-mer that begins there on the forward strand.

    On the reverse strand the places are counted from the other end. A k-mer that isn't annotated, because it
    crosses a sequence's end or has too many unknown symbols, has 0, 0 and no places.
    """
    pattern = r"^(.+?):([0-9]+)(?::(.+))?$"
    rows = labels.select(*labels.columns, F.regexp_extract(label_col, pattern, 1).alias("__name"), F.expr(f"try_cast(regexp_extract(`{label_col}`, '{pattern}', 2) as bigint)").alias("__offset"), F.regexp_extract(label_col, pattern, 3).alias("__strand"))
    known = rows.join(seqs.select("name"), F.col("__name") == F.col("name"), "left_semi")
    loci = kmers(seqs.select("name", "seq", *[c for c in ("len",) if c in seqs.columns]), k, ["name"])
    at = known.join(loci, (F.col("__name") == F.col("name")) & (F.col("__offset") - 1 == F.col("off")), "left").drop("name", "off")
    done = at.join(annotation.select("kmer", "dist", "neigh_cnt", "align_pos"), "kmer", "left")
    forward = (F.col("__strand") == "") | F.startswith("__strand", F.lit("+"))
    none = F.array().cast("array<int>")
    places = F.coalesce("align_pos", none)
    turned = F.when(forward, places).otherwise(F.reverse(F.transform(places, lambda p: F.lit(k - 1) - p)))
    return done.select(*labels.columns, F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("neigh_cnt", F.lit(0)).alias("neigh_cnt"), F.size(places).alias("align_cnt"), turned.alias("align_pos"))


def unannotated(seqs: DataFrame, annotation: DataFrame, k: int, alphabet: Alphabet = DNA) -> DataFrame:
    """The distinct k-mers of both strands without a neighbour."""
    return text_kmers(seqs, k, None, alphabet).join(annotation.filter("dist > 0").select("kmer"), "kmer", "left_anti")
