"""Spelling variants: words one edit apart, each led to its most frequent near word.

Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, with A-Z in lower case, of at least ``MIN_CHARS`` code points and ``MIN_COUNT``
occurrences.  Two words are near if exactly one code point is inserted, deleted or replaced.  A word's form is its near word
with most occurrences (of equal ones the first in code-point order), if those are at least ``RATIO`` times its own; its
root is what following forms leads to.

Near pairs come from positional q-gram indexes.  One edit leaves the first or the second half of the shorter word as it is, so
words meet in shards of one length and one half; a word also asks the shards of words that are shorter by one.
In a shard, postings are kept by (position, gram) of what the half doesn't cover, with padded ends.  One edit spoils at
most q of a word's grams, and moves no other by more than the difference of the lengths: that is the length and position limit.  Of
a word's postings the q + 1 shortest are merged by a heap; what comes out is looked up in the longer ones until it
has all of the word's grams but q, or can't reach that, and is then verified.  No pair is found twice: with the first half
equal too it is the first half's.

A shard of more than ``SHARD`` words is dealt to several by hash, and those who ask visit all of them, so a half that very
many words share is no single task, and a task holds one index of about ``SHARD`` words at a time.

Defined cases: a null or empty text has no words; a null id is empty text where a run's hash is taken; rows that repeat an
id or a text count as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, give_back, saved, session_of, stored

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
Q = 3
#: Words of an index, on average at most.
SHARD = 2000
#: A task adds up so many counted words before it passes them on.
HELD_WORDS = 400_000
#: Runs of up to so many bytes are hashed by table.
SHORT = 64
RUN = re.compile("[a-zÀ-ÿ]+")
_PAD_LEFT, _PAD_RIGHT = "\x02", "\x03"


def _crc_steps() -> np.ndarray:
    """What a CRC-32 register of one byte becomes after eight bits."""
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _drop_some(words: pa.DictionaryArray, doc: np.ndarray, ids: list, every: int) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """How often each word of the dictionary stays, and what becomes of the others: (word without a code point, occurrences).

    CRC-32 is linear: that of "<id>:<run>" is the run's own, combined with the register after "<id>:" moved on by
    the run's length. The first is taken once a word, the second once a document and length.
    """
    code, names = words.indices.to_numpy(), words.dictionary
    raw = as_bytes(names)
    size, chars = np.array([len(x) for x in raw], np.int64), pc.utf8_length(names).to_numpy()
    own = np.array([zlib.crc32(x) for x in raw], np.uint32)
    start = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    moved, steps = np.zeros((len(ids), SHORT + 1), np.uint32), _crc_steps()
    x = np.array(start, np.uint32)
    for n in range(SHORT + 1):
        moved[:, n] = x
        x = steps[x & 255] ^ (x >> 8)
    h = own[code] ^ moved[doc, np.minimum(size[code], SHORT)]
    for k in np.flatnonzero(size[code] > SHORT):
        h[k] = zlib.crc32(raw[code[k]], start[doc[k]])
    hit = h % every == 0
    stay = np.bincount(code[~hit], minlength=len(raw))
    pairs, n = np.unique(np.stack([code[hit], h[hit] % chars[code[hit]]]), axis=1, return_counts=True)
    gone = [(w[:at] + w[at + 1 :], int(m)) for c, at, m in zip(*pairs.tolist(), n) for w in [names[c].as_py()]]
    return stay, gone


def _counting(min_chars: int, drop_every: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added(tables: list[pa.Table]) -> pa.Table:
            out = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": out["word"], "n": out["n_sum"]})

        for batch in batches:
            found, sizes = [], []
            for t in as_bytes(batch.column(1)):
                words = RUN.findall(t.lower().decode())  # bytes.lower knows A-Z only
                found += words
                sizes.append(len(words))
            if not found:
                continue
            words = pa.array(found, pa.string()).dictionary_encode()
            del found
            if drop_every:
                n, gone = _drop_some(words, np.repeat(np.arange(len(sizes)), sizes), batch.column(0).to_pylist(), drop_every)
            else:
                n, gone = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)), []
            names = pa.concat_arrays([words.dictionary, pa.array([w for w, _ in gone], pa.string())])
            table = pa.table({"word": names, "n": pa.array(np.concatenate([n, np.array([m for _, m in gone], np.int64)]), pa.int64())})
            held.append(table.filter(pc.and_(pc.greater_equal(pc.utf8_length(names), min_chars), pc.greater(table["n"], 0))))
            if sum(len(x) for x in held) > HELD_WORDS:
                held = [added(held)]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from held.pop().to_batches(max_chunksize=10_000)
            give_back()
        if held:
            yield from added(held).to_batches(max_chunksize=10_000)
        give_back()

    return count


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_count=MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """word, n. With drop_every a run loses a code point where the CRC-32 h of "<id>:<run>" is divisible by it: the one at h mod its length."""
    session_of(docs)
    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counting(min_chars, drop_every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _one_edit(longer: str, other: str, begin: int) -> bool:
    """Whether two different words, equal up to begin and of lengths that differ by one at most, are one edit apart."""
    end = len(other)
    while begin < end and longer[begin] == other[begin]:
        begin += 1
    return longer[begin + 1 :] == other[begin + (len(longer) == end) :]


class GramIndex:
    """Words of one length that share their first `shared` code points, by (position, gram) of the rest."""

    def __init__(self, words: list[str], shared: int, q: int = Q):
        self.words, self.shared, self.q = words, shared, q
        self.postings: dict[tuple[int, str], list[int]] = {}
        for k, w in enumerate(words):
            for at in self._grams(w):
                self.postings.setdefault(at, []).append(k)

    def _grams(self, word: str) -> list[tuple[int, str]]:
        q = self.q
        text = _PAD_LEFT * (q - 1) + word + _PAD_RIGHT * (q - 1)
        return [(i, text[i : i + q]) for i in range(self.shared, len(word) + q - 1)]

    def near(self, word: str) -> list[int]:
        """The numbers of the words one edit from `word`, which is as long or longer by one and begins with what they share."""
        grams, get = self._grams(word), self.postings.get
        lists = [get(at, ()) for at in grams]
        if len(word) > len(self.words[0]):  # behind the code point too many, grams stand one place further left
            lists = [list(heapq.merge(x, y)) if x and y else x or y for x, y in zip(lists, [get((i - 1, g), ()) for i, g in grams])]
        lists.sort(key=len)
        need, few = len(grams) - self.q, self.q + 1
        short, long = [x for x in lists[:few] if x], lists[few:]
        out = []
        for k, same in groupby(heapq.merge(*short) if len(short) > 1 else short[0] if short else ()):
            if self.words[k] == word:
                continue
            have = sum(1 for _ in same)
            for left, postings in zip(range(len(long), 0, -1), long):
                if have >= need or have + left < need:
                    break
                i = bisect_left(postings, k)
                have += i < len(postings) and postings[i] == k
            if have >= need and _one_edit(word, self.words[k], self.shared):
                out.append(k)
        return out


def _pairs(q: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))))
        out: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["a", "b", "na", "nb"])
            out.clear()
            return batch

        for key, group in groupby(rows, key=lambda r: r[0]):
            size, second = map(int, key.split(" ", 2)[:2])
            shared = size - size // 2 if second else size // 2
            turn = (lambda w: w[::-1]) if second else (lambda w: w)
            members, index, counts = [], None, []
            for _, role, word, n in group:
                if role == 0:
                    members.append(word)
                    counts.append(n)
                    continue
                if not members:
                    break
                index = index or GramIndex([turn(w) for w in members], shared, q)
                _ask(index, members, counts, word, n, turn, second, out)
                if len(out) > 20_000:
                    yield flush()
            if len(members) > 1:
                index = index or GramIndex([turn(w) for w in members], shared, q)
                for word, n in zip(members, counts):
                    _ask(index, members, counts, word, n, turn, second, out)
                    if len(out) > 20_000:
                        yield flush()
        if out:
            yield flush()
        give_back()

    return pairs


def _ask(index: GramIndex, members: list[str], counts: list[int], word: str, n: int, turn, second: int, out: list) -> None:
    half = len(members[0]) // 2
    for k in index.near(turn(word)):
        other = members[k]
        # words of one length are asked from either side; a pair whose first half is equal too is that half's
        if (len(word) > len(other) or word < other) and not (second and word[:half] == other[:half]):
            out.append((word, other, n, counts[k]))


def near_pairs(words: DataFrame, min_chars=MIN_CHARS, q=Q, shard=SHARD) -> DataFrame:
    """a, b, na, nb: each pair of words (word, n: distinct words of at least min_chars) one edit apart, once."""
    if min_chars < 4 or q < 2:
        raise ValueError("words have four code points at least, grams two")
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    less = F.floor((size - 1) / 2).cast("int")
    place = lambda n, second, part: F.struct(n.alias("size"), F.lit(second).alias("second"), part.alias("half"))
    rest = size - 1 - less
    own = words.select("word", "n", F.explode(F.array(place(size, 0, F.substring("word", F.lit(1), half)), place(size, 1, F.substring("word", half + 1, size - half)))).alias("at"))
    longer = words.filter(size > min_chars).select("word", "n", F.explode(F.array(place(size - 1, 0, F.substring("word", F.lit(1), less)), place(size - 1, 1, F.substring("word", size - rest + 1, rest)))).alias("at"))
    hot = saved(own.groupBy("at").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > shard).select("at", F.ceil(F.col("c") / shard).cast("int").alias("parts")))
    own, longer = (x.join(hot, "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (own, longer))
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    row = lambda part, role: [F.concat_ws(" ", F.col("at.size"), F.col("at.second"), part, F.col("at.half")).alias("key"), F.lit(role).alias("role"), "word", "n"]
    placed = own.select(*row(mine, 0))
    asking = longer.select("at", "word", "n", F.explode(every).alias("part")).unionByName(own.filter("parts > 1").select("at", "word", "n", F.explode(F.filter(every, lambda p: p != mine)).alias("part")))
    dealt = placed.unionByName(asking.select(*row(F.col("part"), 1))).repartition("key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(_pairs(q), "a string, b string, na bigint, nb bigint")


def follow(links: DataFrame) -> DataFrame:
    """word, root of rows (word, form): what following forms leads to, by pointer doubling. Forms must not lead in a circle."""
    at = saved(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_forms(words: DataFrame, min_chars=MIN_CHARS, ratio=RATIO, q=Q, shard=SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n)."""
    if ratio <= 1:
        raise ValueError("a form occurs more often than the word")
    session_of(words)
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words, min_chars, q, shard), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("x"))
    formed = words.join(best, "word", "left").withColumn("led", -F.col("x.less") >= ratio * F.col("n"))
    formed = stored(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("led"), F.col("x.near")).alias("form"), F.when(F.col("led"), -F.col("x.less")).alias("form_n")), "forms")
    roots = follow(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_count=MIN_COUNT, ratio=RATIO, drop_every: int | None = None, q=Q, shard=SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs."""
    return spelling_forms(word_counts(docs, id_col, text_col, min_chars, min_count, drop_every), min_chars, ratio, q, shard)
