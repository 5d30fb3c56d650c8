"""Benchmark decontamination: a broadcast hash set of test n-grams against windows of training words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  On UTF-8 bytes that is
digits, a-z and every byte from 0x80 up, so texts are scanned as bytes.  A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window of its length.

The set is sent in blocks of items of at most ``BLOCK_CHARS`` characters, whatever the benchmark's
size; every block scans all documents.  A scan looks only at stretches whose words the block knows,
looks up their hashes and verifies every hit word by word.

Defined cases: null texts have no words; a null item id is the text ``null``; items with the same words
are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, as_bytes, own_columns, saved, session_of, stored, with_text

WINDOW = 13
BLOCK_CHARS = 2_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class WindowSet:
    """Distinct windows of a block of items: for each length, sorted hashes with their words and items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.lengths: dict[int, tuple] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.odd = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        for size, windows in found.items():
            rows = np.array(list(windows), dtype=np.int64).reshape(-1, size)
            hashes = self.hashes(rows)
            order = np.argsort(hashes, kind="stable")
            owners = list(windows.values())
            self.lengths[size] = hashes[order], rows[order], [sorted(owners[i]) for i in order]

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return (self.mix[rows] * self.odd[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with occurring windows."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        hit, items = np.zeros(len(words), bool), set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, (hashes, rows, owners) in self.lengths.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else ()
            if not len(starts):
                continue
            seen = ids[starts[:, None] + np.arange(size)]
            h = self.hashes(seen)
            at = np.searchsorted(hashes, h)
            while True:  # equal hashes of different windows stand side by side
                inside = at < len(hashes)
                starts, seen, h, at = starts[inside], seen[inside], h[inside], at[inside]
                same = hashes[at] == h
                starts, seen, h, at = starts[same], seen[same], h[same], at[same]
                if not len(starts):
                    break
                right = (rows[at] == seen).all(axis=1)
                for i in range(size):
                    hit[starts[right] + i] = True
                for k in set(at[right].tolist()):
                    items.update(owners[k])
                at = at + 1
        return hit, items


def _cut_item(words: list[bytes], n: int, block_chars: int) -> list[bytes]:
    """An item in stretches of about block_chars, which share n - 1 words, so that each of its windows stands in one."""
    out, first, size = [], 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size > block_chars and k - first >= 2 * n:
            out.append(b" ".join(words[first : k + 1]))
            first = k - n + 2
            size = sum(len(x) + 1 for x in words[first : k + 1])
    if not out or len(words) - first >= n:
        out.append(b" ".join(words[first:]))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_chars: int):
    """The benchmark as one or more sets of bounded size."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, longest = rows.agg(F.coalesce(F.sum(F.length("text") + 20), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    if longest > block_chars:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    parts = _cut_item(words_of(text), n, block_chars) if len(text) > block_chars else [text]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts)), pa.array(parts, pa.binary()).cast(pa.string())], ["item", "text"])

        rows = saved(rows.mapInArrow(cut, "item string, text string"))
    count = max(1, -(-size // block_chars))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for k in range(count):
        yield WindowSet([(r.item, r.text.encode()) for r in (rows if count == 1 else rows.filter(part == k)).collect()], n)


_HITS = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _spans(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist() if hit.any() else []


def _scanner(sent):
    """Adds what one block hits to what earlier blocks hit."""
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        done = []
        for t, old in zip(as_bytes(text), before.to_pylist()):
            words = words_of(t)
            hit, items = sent.value.scan(words) if words else (np.zeros(0, bool), set())
            if old:
                for a, b in zip(old["spans"][::2], old["spans"][1::2]):
                    hit[a:b] = True
                items |= set(old["items"])
            done.append({"n_words": len(words), "spans": _spans(hit), "items": sorted(items)})
        return pa.array(done, _ARROW_HITS)

    return scan


def _together(spans: pa.Array, items: pa.Array) -> pa.Array:
    """What several blocks hit in a text as one: spans that overlap or touch are joined."""
    done = []
    for own, named in zip(spans.to_pylist(), items.to_pylist()):
        pairs: list[list[int]] = []
        for a, b in sorted((a, b) for s in own for a, b in zip(s[::2], s[1::2])):
            if pairs and a <= pairs[-1][1]:
                pairs[-1][1] = max(b, pairs[-1][1])
            else:
                pairs.append([a, b])
        done.append({"n_words": 0, "spans": [x for p in pairs for x in p], "items": sorted({i for x in named for i in x})})
    return pa.array(done, _ARROW_HITS)


def _hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, n: int, block_chars: int) -> DataFrame:
    """docs with __hits: n_words, spans (first, end, first, end, ... of hit words) and items.

    A block at a time is in the workers' memory. Of all blocks but the last, what they hit is written by the text's hash
    alone and joined with the documents once.
    """
    spark = session_of(docs)
    out, earlier, before = docs, [], None
    for block in _blocks(benchmark, item_col, item_text_col, n, block_chars):
        if before is not None:
            found = docs.select(F.xxhash64(text_col).alias("__hash"), arrow_column(_scanner(before), _HITS, F.col(text_col), F.lit(None).cast(_HITS)).alias("h"))
            earlier.append(stored(found.filter(F.size("h.spans") > 0).dropDuplicates(["__hash"]).select("__hash", "h.spans", "h.items"), "hits"))
        before = spark.sparkContext.broadcast(block)
    old = F.lit(None).cast(_HITS)
    if earlier:
        listed = reduce(DataFrame.unionByName, earlier).groupBy("__hash").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # a row of each block
        joined = listed.select("__hash", arrow_column(_together, _HITS, F.col("spans"), F.col("items")).alias("__old"))
        out, old = out.join(joined, F.xxhash64(text_col) == F.col("__hash"), "left").drop("__hash"), F.col("__old")
    return out.withColumn("__hits", arrow_column(_scanner(before), _HITS, F.col(text_col), old)).drop("__old")


def _n_hit():
    """Spans alternate first and end, so folding x - s over them sums their lengths."""
    return F.aggregate(F.col("__hits.spans"), F.lit(0).cast("bigint"), lambda s, x: x - s)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", n=WINDOW, block_chars=BLOCK_CHARS, share=20) -> DataFrame:
    """One row per document: the id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and share * n_hit >= n_words), items."""
    done = _hits(docs.select(id_col, text_col), benchmark, text_col, item_col, item_text_col, n, block_chars)
    done = done.select(id_col, F.col("__hits.n_words").alias("n_words"), _n_hit().alias("n_hit"), F.col("__hits.items").alias("items"))
    return done.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def _without(text: bytes, spans: list[int]) -> bytes:
    """A text without the words of spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    for a, b in reversed(list(zip(spans[::2], spans[1::2]))):
        text = text[: at[a][0]] + text[at[b - 1][1] :]
    return text


_CLEAN = "struct<gone:boolean,text:string>"


def _cleaner(sent, share: int, mode: str):
    """For each text whether its document goes, and the text that is left where it is another."""

    def clean(text: pa.Array) -> pa.Array:
        gone, left = [], []
        for t in as_bytes(text):
            words = words_of(t)
            spans = _spans(sent.value.scan(words)[0]) if words else []
            hit = sum(spans[1::2]) - sum(spans[::2])
            gone.append(mode != "spans" and hit > 0 and hit * share >= len(words))
            cut = None
            if spans and not gone[-1] and mode != "documents":
                cut = _without(t, spans)
                while mode == "both" and (words := words_of(cut)) and (spans := _spans(sent.value.scan(words)[0])):
                    cut = _without(cut, spans)
            left.append(cut)
        return pa.StructArray.from_arrays([pa.array(gone, pa.bool_()), pa.array(left, pa.binary()).cast(pa.string())], ["gone", "text"])

    return clean


@own_columns
def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", n=WINDOW, block_chars=BLOCK_CHARS, share=20, mode="documents") -> DataFrame:
    """docs, all columns. mode "documents": without contaminated documents; "spans": all documents, without
    the hit words and what stands between neighbouring ones; "both": without contaminated documents, and the others
    without such spans, cut again where what is left makes a window anew, so that no window remains."""
    if mode not in ("documents", "spans", "both"):
        raise ValueError(f"mode must be documents, spans or both, not {mode!r}")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sets = _blocks(benchmark, item_col, item_text_col, n, block_chars)
    first, second = next(sets), next(sets, None)
    if second is None:  # a benchmark of one block: each text is sent to Python once
        sent = session_of(docs).sparkContext.broadcast(first)
        done = docs.withColumn("__clean", arrow_column(_cleaner(sent, share, mode), _CLEAN, F.col(text_col), once=True)).filter("not __clean.gone")
        return with_text(done, F.coalesce(F.col("__clean.text"), F.col(text_col)), text_col).select(*columns)
    del first, second
    hits = lambda rows: _hits(rows, benchmark, text_col, item_col, item_text_col, n, block_chars).withColumn("__n_hit", _n_hit())
    done = hits(docs)
    if mode != "spans":
        done = done.filter(~((F.col("__n_hit") > 0) & (F.col("__n_hit") * share >= F.col("__hits.n_words"))))
    if mode == "documents":
        return done.select(*columns)

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_without(t, s) if s else t for t, s in zip(as_bytes(text), spans.to_pylist())], pa.binary()).cast(pa.string())

    def cleaned(rows: DataFrame) -> DataFrame:
        return with_text(rows, F.when(F.col("__n_hit") > 0, arrow_column(cut, "string", F.col(text_col), F.col("__hits.spans"))).otherwise(F.col(text_col)), text_col)

    if mode == "spans":
        return cleaned(done).select(*columns)
    rows = saved(cleaned(done))
    out, rest = rows.filter("__n_hit = 0").select(*columns), rows.filter("__n_hit > 0").select(*columns)
    while not rest.isEmpty():  # what one cut has joined may be a window of another block
        rows = saved(cleaned(hits(rest)))
        out, rest = out.unionByName(rows.filter("__n_hit = 0").select(*columns)), rows.filter("__n_hit > 0").select(*columns)
    return out
