"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

A fingerprint is cut into six blocks.  Two that differ in at most three bits agree in three whole blocks
at least, so each fingerprint joins one bucket for every choice of three blocks (20 keys of 32 bits).
Only distinct fingerprints take part; copies of a text meet in one row before anything is joined.

A bucket yields the edges of a spanning forest of its links, never its pairs.  Buckets of more than
``BUCKET`` fingerprints leave the first pass whole and are cut again: the other 32 bits are split into six
blocks of their own, which gives keys of 48 bits and so at most 65,536 fingerprints a bucket.  Nothing
is capped or dropped.

Defined cases: a text of fewer words than a shingle is hashed whole; a text without words (or null) has
fingerprint zero and is linked like any other; rows without an id get a fingerprint and the
component of their links, but name no component unless nothing else does (component_id null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, as_bytes, free_names, own_columns, saved, session_of, stored
from .components import connected_components

DISTANCE, SHINGLE, SEED = 3, 3, 42
BUCKET = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # a very long text in pieces
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _blocks(bits: list[int], count: int, kept: int) -> list[int]:
    """The masks that keep `kept` of `count` near-equal blocks of the given bits."""
    cuts = [sum(1 << b for b in bits[i * len(bits) // count : (i + 1) * len(bits) // count]) for i in range(count)]
    return [sum(c) for c in combinations(cuts, kept)]


MASKS = _blocks(list(range(64)), 6, 3)


def _forest(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of at most `distance` bits connect, at most one fewer than there are prints."""
    edges, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= distance
            if near.any():
                found = rest[near]
                edges.append((np.full(len(found), node), found))
                queue.extend(found)
                rest = rest[~near]
    return edges


def _links(sizes_from: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets that stand one after another, starting at sizes_from."""
    size = np.diff(np.append(sizes_from, len(prints)))
    a, b = [], []
    bucket = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= 8, size)
    for step in range(1, 8):  # small buckets, all at once
        both = np.flatnonzero(small[:-step] & (bucket[:-step] == bucket[step:])) if len(prints) > step else np.zeros(0, np.int64)
        if not len(both):
            break
        both = both[np.bitwise_count(prints[both] ^ prints[both + step]) <= distance]
        a.append(prints[both])
        b.append(prints[both + step])
    for k in np.flatnonzero(size > 8):
        for x, y in _forest(prints[sizes_from[k] : sizes_from[k] + size[k]], distance):
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])


def _linker(distance: int, limit: int):
    """For rows sorted by (mask, key): edges (a, b, null), and the prints (a, null, mask) of buckets over the limit."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, mask=None):
            nulls = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), nulls if b is None else pa.array(b.view(np.int64)), nulls if mask is None else pa.array(mask)], schema=_EDGES)

        held: tuple | None = None  # the last bucket, which may go on in the next batch
        over = False  # it has passed the limit, and what was held is out
        for batch in batches:
            mask, key, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            prints = prints.view(np.uint64)
            if held is not None:
                if over and len(mask):
                    same = int(np.argmin(np.append((mask == held[0][-1]) & (key == held[1][-1]), False)))
                    if same:
                        yield out(prints[:same], None, mask[:same])
                        mask, key, prints = mask[same:], key[same:], prints[same:]
                    if not len(mask):
                        continue
                    over, held = False, None
                else:
                    mask, key, prints = (np.concatenate(x) for x in zip(held, (mask, key, prints)))
            if not len(mask):
                continue
            first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
            last = first[-1]
            held = mask[last:], key[last:], prints[last:]
            big = [k for k in range(len(first) - 1) if first[k + 1] - first[k] > limit] if last > limit else []
            drop = np.zeros(last, bool)
            for k in big:
                yield out(prints[first[k] : first[k + 1]], None, mask[first[k] : first[k + 1]])
                drop[first[k] : first[k + 1]] = True
            starts = first[:-1]
            done = prints[:last]
            if big:
                size = np.diff(first)
                size = size[size <= limit]
                starts, done = np.cumsum(size) - size, done[~drop]
            if len(done):
                yield out(*_links(starts, done, distance))
            if len(held[0]) > limit:
                yield out(held[2], None, held[0])
                over = True
        if held is not None and not over and len(held[2]):
            yield out(*_links(np.zeros(1, np.int64), held[2], distance))

    return link


def _bucketed(rows: DataFrame, distance: int, limit: int) -> DataFrame:
    """rows: (mask, key, print) -> edges and prints of large buckets."""
    placed = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return placed.mapInArrow(_linker(distance, limit), "a bigint, b bigint, mask bigint")


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct `print`. a, b: edges that connect exactly what links of at most `distance` <= 3 bits connect."""
    if not 0 <= distance <= 3:
        raise ValueError("the blocks are laid out for 0 to 3 differing bits")
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in MASKS])
    rows = prints.select(F.explode(keys).alias("k"), "print").select("k.mask", "k.key", "print")
    first = saved(_bucketed(rows, distance, bucket))
    edges = first.filter("b is not null").select("a", "b")
    large = first.filter("b is null").select(F.col("mask").alias("outer"), F.col("a").alias("print"))
    if large.isEmpty():
        return edges
    cases = F.lit(None).cast("array<bigint>")
    for m in MASKS:
        rest = [i for i in range(64) if not m >> i & 1]
        cases = F.when(F.col("outer") == _signed(m), F.array(*[F.lit(_signed(m | x)) for x in _blocks(rest, 6, 3)])).otherwise(cases)
    finer = large.select(F.explode(cases).alias("mask"), "print").select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("key"), "print").distinct()
    return edges.unionByName(_bucketed(finer, distance, 1 << 62).select("a", "b"))


def mark(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id, hash (of the text), print of every document, written once."""

    def prints_of(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in as_bytes(text)], np.uint64).view(np.int64))

    return saved(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), arrow_column(prints_of, "bigint", F.col(text_col)).alias("print")))


def owners(marked: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, components=connected_components) -> DataFrame:
    """print, first (the smallest id), root of every print. components: edges to (node, root)."""
    distinct = saved(marked.groupBy("print").agg(F.min("id").alias("first")))
    # the links stand before components are asked for: how these are found must not say in how many tasks links are made
    roots = components(stored(links(distinct.select("print"), distance, bucket), "links"))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))


def simhash_components(docs: DataFrame, id_col="doc_id", text_col="text", distance=DISTANCE, shingle=SHINGLE, bucket=BUCKET) -> DataFrame:
    """One row per document: the id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    session_of(docs)
    marked = mark(docs, id_col, text_col, shingle)
    owner = owners(marked, distance, bucket)
    named = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    label = owner.select("print", "root").join(named, "root").select("print", "component_id")
    return marked.join(label, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def heads(marked: DataFrame, owner: DataFrame) -> DataFrame:
    """id, hash of the document that stays of each component: the smallest id (nulls last), of its texts the smallest hash."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = marked.groupBy("print").agg(F.min(rank).alias("best"))
    best = best.join(owner.select("print", "root"), "print").groupBy("root").agg(F.min("best").alias("best"))
    return saved(best.select("best.id", "best.hash").distinct())


def keep_rows(docs: DataFrame, best: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, whose (id, hash) is in best, of equal ones one row. marked: (id, hash) of all docs."""
    own_id, own_hash = free_names(docs, "__id", "__hash")
    best = best.select(F.col("id").alias(own_id), F.col("hash").alias(own_hash))
    on = lambda rows, i, h: [rows[i].eqNullSafe(best[own_id]), rows[h] == best[own_hash]]
    rows = docs.withColumn(own_id, F.col(f"`{id_col}`")).withColumn(own_hash, F.xxhash64(F.col(f"`{text_col}`")))
    kept = rows.join(best, on(rows, own_id, own_hash), "left_semi")
    if marked.join(best, on(marked, "id", "hash"), "left_semi").count() > best.count():
        kept = kept.dropDuplicates([own_id, own_hash])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@own_columns
def simhash_dedup(docs: DataFrame, id_col="doc_id", text_col="text", distance=DISTANCE, shingle=SHINGLE, bucket=BUCKET) -> DataFrame:
    """docs, all columns, with one document of each component: the smallest id, among its texts the one with
    the smallest hash, of equal rows one. Rows without an id stay only where the component has no id."""
    session_of(docs)
    marked = mark(docs, id_col, text_col, shingle)
    return keep_rows(docs, heads(marked, owners(marked, distance, bucket)), marked, id_col, text_col)
