"""Substring dedup: words in passages that an earlier document has too are removed.

A word goes if some window of ``size`` words that covers it also starts in a document with a smaller id.
Windows are judged on the input.  An FM-index of everything can't be asked by everything, so the windows are
dealt out first, without losing a match:

1. Each window has an anchor, the smallest hash of its ``GRAM``-word grams, and consecutive windows with one
   anchor make a run (about twenty windows).  Equal windows have equal anchors.  Anchors that only one
   document has are done with; these are most of them.
2. Runs with equal words are one row, with the smallest document that has it.  That takes in copies of
   any number before their words are ever moved.  The words of one run of each kind are fetched.
3. An anchor decides on a shard; shards hold about ``SHARD_WORDS`` words, and each gets a compressed FM-index (BWT in a
   wavelet matrix).  The runs that documents have in the shard, each kind once, are streamed through it by backward search,
   which keeps the longest match up to a window and reports the least document of each window's interval.
4. An anchor with over ``VARIANTS`` different runs is split: within its runs windows get longer anchors (``LONGER`` words, in the
   end all of the window's), and the runs that these make go the same way, step 2 on.  So no shard grows with the largest group.
5. Verdicts go back to all runs with those words, and intervals to the documents.

Words are compared by 64-bit hashes. Two unequal windows pass for equal only if they differ just in words whose
hashes are equal, which takes a pair of near copies and one chance in 2**64. Runs of one anchor are told apart by a 64-bit hash of their words.

Defined cases: a null text has no words; rows without an id lose nothing and cost others nothing; rows that repeat an
id are judged each, against smaller ids only, so they do not remove each other's words; windows that
repeat inside one document are no reason to remove anything; ids may be of any type that has an order, as text or numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, as_bytes, free_names, give_back, own_columns, session_of, stored, with_text
from .fm_index import FmIndex

WINDOW, GRAM, RUN = 50, 10, 64
SHARD_WORDS, VARIANTS = 500_000, 1000
#: Words of the anchors that split a hot one, one after another; the last are whole windows.
LONGER = (20, 40, 50)
#: Word hashes that a worker keeps.
KEPT_HASHES = 500_000

_SEED = 0x5851F42D4C957F2D
_STEP = 0x9E3779B97F4A7C15
_kept: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    if len(_kept) > KEPT_HASHES:
        _kept.clear()
    for w in set(words).difference(_kept):
        _kept[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_kept.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_SEED)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, in time that doesn't depend on the width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_STEP, -1, 2**64)


def _spans_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of the words of each span, the same wherever the span stands."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h)))))
    back = np.full(len(h) + 1, _INVERSE, np.uint64)
    back[0] = 1
    return _mixed((sums[end] - sums[begin]) * np.multiply.accumulate(back)[begin])


def runs_of(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, content, begin (word), windows of each run of a document's word hashes."""
    if len(h) < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    power = _powers(gram)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams += h[k : k + len(grams)] * power[k]
    least = _sliding_min(_mixed(grams), size - gram + 1)
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(begin, len(least)))
    if (count > RUN).any():  # periodic texts have runs of any length
        parts = -(-count // RUN)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end = np.repeat(begin, parts) + inner * RUN, np.repeat(begin + count, parts)
        count = np.minimum(end - begin, RUN)
    return least[begin], _spans_hash(h, begin, begin + count + size - 1), begin, count


def _runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """id, hash (of the text), anchor, content, begin, windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, row = [], []
            for i, text in enumerate(as_bytes(batch.column(2))):
                words = text.split()
                if len(words) >= size:
                    parts.append(runs_of(word_hashes(words), size, gram))
                    row.append(np.full(len(parts[-1][0]), i))
            if not parts:
                continue
            at = pa.array(np.concatenate(row))
            anchor, content, begin, windows = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(windows.astype(np.int32))],
                ["id", "hash", "anchor", "content", "begin", "windows"],
            )

    return docs.mapInArrow(find, f"id {_type(docs, 'id')}, hash bigint, anchor bigint, content bigint, begin int, windows int")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _fetcher(size: int):
    """For documents, sorted, with the runs that are wanted of them: the word hashes of each run."""
    names = ["anchor", "content", "windows"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of rows that repeat an id and a text one is enough
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in [*names, "owner", "words"]}
            for i, k, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3)):
                if (i, k) == last:
                    continue
                last = i, k
                h = word_hashes(text.split())
                for s in want.as_py():
                    for n in names:
                        columns[n].append(s[n])
                    columns["owner"].append(i)
                    columns["words"].append(h[s["begin"] : s["begin"] + s["windows"] + size - 1].tobytes())
            kinds = [pa.int64(), pa.int64(), pa.int32(), batch.schema.field(0).type, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds)], list(columns))

    return fetch


def _spans(least: np.ndarray, names: list) -> list[dict]:
    """The windows of a run as stretches with one least owner."""
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return [{"a": a, "b": b, "owner": names[o]} for a, b, o in zip(cut.tolist(), [*cut[1:].tolist(), len(least)], least[cut].tolist())]


def _indexer(size: int):
    """For rows sorted by shard: the spans of every run, from an FM-index of the shard."""

    def judge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = pa.Table.from_batches(rows).combine_chunks()
        owners = shard.column("owner").to_pylist()
        names = sorted(set(owners))
        number = {o: i for i, o in enumerate(names)}
        words = shard.column("words").to_pylist()
        length = np.fromiter((len(w) // 8 for w in words), np.int64, len(words))
        symbols = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)[1] + 1
        first = np.cumsum(length) - length
        index = FmIndex(symbols, first, np.array([number[o] for o in owners], np.int64), size)
        least = index.matches(symbols, first, length)
        spans = [_spans(least[a : a + n], names) for a, n in zip(first.tolist(), shard.column("windows").to_pylist())]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("owner", shard.schema.field("owner").type)]))
        out = [shard.column(n).combine_chunks() for n in ("anchor", "content", "windows")]
        return pa.RecordBatch.from_arrays([*(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out), pa.array(spans, kind)], ["anchor", "content", "windows", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield judge(held)
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield judge(held)
        give_back()

    return run


def _splitter(size: int, gram: int):
    """For runs: the shorter runs that windows make by anchors of `gram` words. at: the window of the run that each begins with."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts, words = [], [], []
            for i, w in enumerate(batch.column("words").to_pylist()):
                h = np.frombuffer(w, np.uint64)
                parts.append(runs_of(h, size, gram))
                row.append(np.full(len(parts[-1][0]), i))
                words += [h[a : a + n + size - 1].tobytes() for a, n in zip(parts[-1][2].tolist(), parts[-1][3].tolist())]
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
            anchor, content, begin, windows = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, np.uint64, np.int64, np.int64), zip(*parts)))
            own = [batch.column(n).take(at) for n in ("anchor", "content", "windows", "owner")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(begin.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(windows.astype(np.int32)), pa.array(words, pa.binary())],
                ["of_anchor", "of_content", "of_windows", "owner", "at", "anchor", "content", "windows", "words"],
            )

    return split


_RUN = ["anchor", "content", "windows"]


def _judged(found: DataFrame, size: int, longer: tuple[int, ...], shard_words: int, variants: int) -> DataFrame:
    """anchor, content, windows, spans of different runs (anchor, content, windows, owner, words): the least owner of every window."""
    owner = _type(found, "owner")
    hot = stored(found.groupBy("anchor").count().filter(F.col("count") > (variants if longer else 1 << 62)).select("anchor"), "hot")
    some = not hot.isEmpty()
    cold = found.join(hot, "anchor", "left_anti") if some else found
    words = cold.agg(F.coalesce(F.sum(F.col("windows") + (size - 1)), F.lit(0))).first()[0]
    # enough shards for all tasks too, where a few of full size would hold everything
    shards = max(-(-words // shard_words), 2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cold.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *_RUN, "owner", "words").repartition("shard").sortWithinPartitions("shard")
    done = dealt.mapInArrow(_indexer(size), f"anchor bigint, content bigint, windows int, spans array<struct<a:int,b:int,owner:{owner}>>")
    if not some:
        return done
    schema = f"of_anchor bigint, of_content bigint, of_windows int, owner {owner}, at int, anchor bigint, content bigint, windows int, words binary"
    parts = stored(found.join(hot, "anchor", "left_semi").mapInArrow(_splitter(size, min(longer[0], size)), schema), "parts")
    kinds = stored(parts.groupBy(*_RUN).agg(F.min("owner").alias("owner"), F.first("words").alias("words")), "kinds")
    inner = stored(_judged(kinds, size, longer[1:], shard_words, variants), "judged")
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b"), s["owner"].alias("owner")))
    back = parts.drop("words", "owner").join(inner, _RUN).select(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), F.col("of_windows").alias("windows"), moved.alias("spans"))
    return done.unionByName(back.groupBy(*_RUN).agg(F.flatten(F.collect_list("spans")).alias("spans")))  # a run has at most RUN windows


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", size=WINDOW, gram=GRAM, shard_words=SHARD_WORDS, variants=VARIANTS, longer=LONGER) -> DataFrame:
    """__id, __hash (xxhash64 of the text), spans (array of word numbers first, end): what goes from each document."""
    session_of(docs)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).filter("id is not null")
    runs = stored(_runs(texts, size, min(gram, size)), "runs")
    # written, so that the join has a plain exchange on either side and hot anchors can be split
    shared = stored(runs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"), "shared")
    runs = stored(runs.join(shared, "anchor"), "runs")
    kinds = stored(runs.groupBy(*_RUN).agg(F.min(F.struct("id", "hash", "begin")).alias("one"), F.max("id").alias("last")), "kinds")
    wanted = kinds.select(F.col("one.id").alias("id"), F.col("one.hash").alias("hash"), F.struct(*_RUN, F.col("one.begin").alias("begin")).alias("want"))
    wanted = wanted.groupBy("id", "hash").agg(F.collect_list("want").alias("want"))
    asked = texts.join(wanted, ["id", "hash"]).select("id", "hash", "text", "want").sortWithinPartitions("id", "hash")
    found = stored(asked.mapInArrow(_fetcher(size), f"anchor bigint, content bigint, windows int, owner {_type(texts, 'id')}, words binary"), "found")
    judged = _judged(found, size, (*[g for g in longer if gram < g < size], size), shard_words, variants)
    # rows that repeat an id and a text bring the same runs twice; and a kind matters if some document that has it follows an owner
    judged = judged.dropDuplicates(_RUN).join(kinds.select(*_RUN, "last"), _RUN)
    # written: the runs of a large group of copies meet one verdict, and that join can be split if nothing else shares its stage
    judged = stored(judged.filter(F.exists("spans", lambda s: s["owner"] < F.col("last"))).drop("last"), "judged")
    hit = runs.join(judged, _RUN).withColumn("spans", F.filter("spans", lambda s: s["owner"] < F.col("id"))).filter(F.size("spans") > 0)
    pairs = F.transform("spans", lambda s: F.struct((F.col("begin") + s["a"]).alias("first"), (F.col("begin") + s["b"] + (size - 1)).alias("end")))
    return hit.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), pairs.alias("spans")).groupBy("__id", "__hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))


_KEPT = "struct<n_words:bigint,n_removed:bigint,text:string,sha256:string>"


def _keep(text: pa.Array, spans: pa.Array) -> pa.Array:
    columns = [[], [], [], []]
    for t, gone in zip(as_bytes(text), spans.to_pylist()):
        words = t.split()
        n = len(words)
        if gone:
            lost = np.zeros(n + 1, np.int64)
            np.add.at(lost, [s["first"] for s in gone], 1)
            np.add.at(lost, [s["end"] for s in gone], -1)
            words = [w for w, k in zip(words, (np.cumsum(lost) > 0).tolist()) if not k]
        kept = b" ".join(words)
        for c, x in zip(columns, (n, n - len(words), kept, hashlib.sha256(kept).hexdigest())):
            c.append(x)
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.string())], ["n_words", "n_removed", "text", "sha256"])


def _annotated(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """docs with what is kept of each text, under a free name that is returned too."""
    own_id, key, found, kept = free_names(docs, "__id", "__key", "__spans", "__kept")
    spans = repeated_spans(docs, id_col, text_col, **options).toDF(own_id, key, found)
    hashed = free_names(docs, "__text_hash")[0]
    left = docs.withColumn(hashed, F.xxhash64(text_col))
    joined = left.join(spans, (left[id_col] == spans[own_id]) & (left[hashed] == spans[key]), "left")
    return joined.withColumn(kept, arrow_column(_keep, _KEPT, left[text_col], F.col(found))), kept


def substring_dedup_report(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: the id, n_words, n_removed, kept_sha256, text (the kept words joined by a space)."""
    done, kept = _annotated(docs.select(id_col, text_col), id_col, text_col, **options)
    return done.select(id_col, F.col(f"{kept}.n_words").alias("n_words"), F.col(f"{kept}.n_removed").alias("n_removed"), F.col(f"{kept}.sha256").alias("kept_sha256"), F.col(f"{kept}.text").alias("text"))


@own_columns
def substring_dedup(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs, all rows and columns; texts that lost words are the kept words joined by a space."""
    done, kept = _annotated(docs, id_col, text_col, **options)
    text = F.when(F.col(f"{kept}.n_removed") > 0, F.col(f"{kept}.text")).otherwise(F.col(text_col))
    return with_text(done, text, text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
