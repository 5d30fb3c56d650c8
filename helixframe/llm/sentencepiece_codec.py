"""SentencePiece encoding and decoding by suffix-array matching.

The texts of an Arrow batch are cut into words (a run of spaces and what follows up to the next space; pieces
never cross that unless the vocabulary says so, and then a text is one word).  The distinct words that
the task has not met yet (it keeps the ids of the last ``KEPT_WORDS`` to twice as many) are put one after another, their suffixes are sorted as far as the longest piece
reaches, and every piece of the vocabulary is looked up by binary search, which gives the range of its
occurrences.  The occurrences are the edges of a lattice; sorted by position (BPE: by counting, as each position and length has its place) they are relaxed:

* unigram models: forward, keeping the best sum of scores at each position;
* BPE models: by merge rank, leftmost first, an edge replacing the two symbols that it spans, until no edge
  fits.  A sum of BPE scores has no meaning, and only this gives the ids that the model defines.

Characters that no piece has become byte pieces, or the unknown piece in models without them.  Decoding
joins the pieces' bytes, turns the space mark into spaces and drops the one put in front.  The round trip
is exact but for the mark itself (U+2581) in a text, which comes back as a space, as in the format.

Defined cases: a null or empty text has no pieces and decodes to the empty text; bytes that aren't UTF-8 in a
list of ids decode to U+FFFD; null lists decode to null.
"""

from __future__ import annotations

import copy
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, give_back, own_columns, session_of
from .pieces import BPE, DEFAULT_MODEL, SPACE, UNUSED, Pieces, load_pieces

#: Words whose ids a task keeps before it sets about forgetting the older ones, and characters that it indexes at once.
KEPT_WORDS, INDEXED_CHARS = 100_000, 200_000
#: Bytes of texts whose words are held at once.
SPLIT_BYTES = 1_000_000
#: Longer words are merged one at a time, with a heap.
LOCKSTEP = 48
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int32).max


def suffix_array(code: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The suffixes of code (0 < symbol < symbols) in the order of their first `depth` symbols, by prefix doubling.

    Also the packed symbols behind each position that the first step sorts by, and how many one number holds.
    """
    bits = int(symbols - 1).bit_length()
    reach = 63 // bits
    padded = np.concatenate((code, np.zeros(reach * (depth // reach + 2), np.int64)))
    packed = np.zeros(len(padded) - reach + 1, np.int64)
    for k in range(reach):
        packed = (packed << bits) | padded[k : k + len(packed)]
    key, per = packed[: len(code)], reach
    while True:
        order = np.argsort(key)
        if reach >= depth:
            return order, packed, per
        step = key[order]
        rank = np.empty(len(code), np.int64)
        rank[order] = np.cumsum(np.append(False, step[1:] != step[:-1]))
        after = np.zeros(len(code), np.int64)
        after[: max(0, len(code) - reach)] = rank[reach:] + 1
        key = rank * (len(code) + 1) + after
        reach *= 2


class Matcher:
    """Encodes words with a vocabulary."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = [i for i, t in enumerate(pieces.texts) if t and (pieces.kind == BPE or pieces.scores[i] > UNUSED)]
        self.length = np.array([len(pieces.texts[i]) for i in usable])
        self.depth = int(self.length.max())
        self.ids, self.scores = pieces.ids[usable].astype(np.int32), pieces.scores[usable]
        self.rank = np.unique(-self.scores, return_inverse=True)[1]  # 0 is merged first
        self.code = np.zeros((len(usable), self.depth), np.int64)
        for row, i in enumerate(usable):
            self.code[row, : self.length[row]] = [ord(c) for c in pieces.texts[i]]
        self.whole_texts = pieces.inner_space
        self.surface: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        #: Words and their ids: those met lately, and those met before them.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fresh(self) -> Matcher:
        """The same tables with no words yet, for a task of its own: idle Python workers outnumber the busy ones, and
        would each hold on to the words that they met."""
        one = copy.copy(self)
        one.kept, one.older = {}, {}
        return one

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position * (depth + 1) + length, piece) of every occurrence of a piece."""
        present = np.zeros(0x110001, bool)
        present[code] = True
        dense = np.cumsum(present)  # symbols 1, 2, ... of what occurs, the separator last
        symbols = int(dense[-1]) + 1
        order, packed, per = suffix_array(dense[code], symbols, self.depth)
        possible = np.flatnonzero((present[self.code] | (np.arange(self.depth) >= self.length[:, None])).all(axis=1))
        width = -(-self.depth // per)
        bits = int(symbols - 1).bit_length()
        inside = np.arange(width * per) < self.length[possible, None]
        low = np.zeros(inside.shape, np.int64)
        low[:, : self.depth] = dense[self.code[possible]] * inside[:, : self.depth]
        high = np.where(inside, low, (1 << bits) - 1)

        def pack(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), width), np.int64)
            for k in range(per):
                out = (out << bits) | x[:, k::per]
            return out

        # the first symbols decide for most pieces, by numpy's own binary search
        ranked = packed[order]
        low, high = pack(low), pack(high)
        first, last = np.searchsorted(ranked, low[:, 0]), np.searchsorted(ranked, high[:, 0], side="right")

        def first_not(rows: np.ndarray, bound: np.ndarray, after_equal: bool) -> np.ndarray:
            """Inside the ranges found so far, the first suffix that isn't below (or at) each bound."""
            low, high = first[rows], last[rows]
            left = np.flatnonzero(low < high)
            while len(left):
                middle = (low[left] + high[left]) >> 1
                at, below, equal = order[middle], np.zeros(len(left), bool), np.ones(len(left), bool)
                for k in range(1, width):
                    have, want = packed[at + per * k], bound[rows[left], k]
                    below |= equal & (have < want)
                    equal &= have == want
                below |= equal & after_equal
                low[left[below]] = middle[below] + 1
                high[left[~below]] = middle[~below]
                left = left[low[left] < high[left]]
            return low

        long = np.flatnonzero((self.length[possible] > per) & (first < last))
        first[long], last[long] = first_not(long, low, False), first_not(long, high, True)
        times = last - first
        piece = np.repeat(possible.astype(np.int32), times)
        within = np.repeat(first - (np.cumsum(times) - times), times)
        within += np.arange(len(piece))
        key = order[within]
        key *= self.depth + 1
        key += np.repeat(self.length[possible], times)
        return key, piece

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        out, batch, size = [], [], 0
        for w in words:
            if len(w) > INDEXED_CHARS and self.pieces.kind == BPE:
                out += [*(self._encode(batch) if batch else []), self._encode_long(w)]
                batch, size = [], 0
                continue
            batch.append(w)
            size += len(w) + 1
            if size > INDEXED_CHARS:
                out += self._encode(batch)
                batch, size = [], 0
        return out + (self._encode(batch) if batch else [])

    def _segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, piece (-1: unknown) of what the words, put one after another, are cut into, in order; their characters; where each word ends."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(length + 1) - length - 1
        code[(first + length)[:-1]] = 0x110000  # between words; no character
        key, piece = self.edges(code)
        relax = self._merge if self.pieces.kind == BPE else self._forward
        start, found = relax(first, length, code, key, piece)
        order = np.argsort(start, kind="stable")
        return start[order], found[order], code, first + length

    def _encode(self, words: list[str]) -> list[bytes]:
        start, found, code, ends = self._segments(words)
        ids, count = self._ids(found, lambda k: chr(code[start[k]]))
        data = ids.tobytes()
        ends = (4 * np.append(0, np.cumsum(count))[np.searchsorted(start, ends)]).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, found: np.ndarray, character) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in order, and how many each has: unknown characters are spelled in bytes where there are pieces for these."""
        ids = np.where(found >= 0, self.ids[found], self.pieces.unknown).astype("<i4")
        count = np.ones(len(found), np.int64)
        unknown = np.flatnonzero(found < 0)
        if len(unknown) and self.pieces.bytes_:
            encoded = [character(k).encode() for k in unknown]
            count[unknown] = [len(b) for b in encoded]
            ids = np.repeat(ids, count)
            at = np.cumsum(count) - count
            for k, b in zip(unknown, encoded):
                ids[at[k] : at[k] + len(b)] = [self.pieces.bytes_[x] for x in b]
        return ids, count

    def _encode_long(self, word: str) -> bytes:
        """The same for a word of any length, a window of INDEXED_CHARS at a time.

        Merging by rank gives a sequence of pieces if and only if it gives every two neighbours of it for what these two spell: no
        merge over a boundary comes first anywhere if none does between its neighbours. So what a window gives but its last few pieces is kept,
        and the next window begins there if the pieces on either side are neighbours like that; if not, it begins earlier.
        """
        starts, founds = array("q"), array("i")
        at, reach, back = 0, INDEXED_CHARS, 1
        while True:
            start, found, *_ = self._segments([word[at:reach]])
            if starts:
                end = at + (int(start[1]) if len(start) > 1 else min(reach, len(word)) - at)
                if self._segments([word[starts[-1] : end]])[0].tolist() != [0, at - starts[-1]]:
                    back = min(back, len(starts))
                    at = starts[-back]
                    del starts[-back:], founds[-back:]
                    back *= 2
                    continue
            keep = len(start) if reach >= len(word) else max(1, int(np.searchsorted(start, reach - at - 8 * self.depth)))
            starts.frombytes((start[:keep] + at).astype(np.int64).tobytes())
            founds.frombytes(found[:keep].astype(np.int32).tobytes())
            if reach >= len(word):
                return self._ids(np.frombuffer(founds, np.int32), lambda k: word[starts[k]])[0].tobytes()
            at += int(start[keep])
            reach, back = at + INDEXED_CHARS, 1

    def _merge(self, first, length, code, key, piece):
        """(start, piece) of the symbols that are left when no edge spans two neighbours."""
        wide = self.depth + 1
        #: The edges sorted by position, and by length for each: a place for every (position, length), -1 without an edge.
        edges = np.full((len(code) + 1) * wide, -1, np.int32)
        edges[key] = piece
        ranks = np.append(self.rank, _NONE).astype(np.int32)  # -1 finds the last
        short = length <= LOCKSTEP
        word = np.repeat(np.flatnonzero(short), length[short]).astype(np.int32)
        start = (first[word] + np.arange(len(word)) - np.repeat(np.cumsum(length[short]) - length[short], length[short])).astype(np.int32)
        starts, founds = [], []
        # what is known of each symbol: where it begins, how long it is, its piece, and the edge over it and the next
        size = np.ones(len(start), np.int32)
        found = edges[start.astype(np.int64) * wide + 1]

        def over(k):
            """The edges over symbols k and k + 1, -1 where there is none or they are not of one word."""
            both = size[k] + size[k + 1]
            fits = (word[k] == word[k + 1]) & (both <= self.depth)
            return np.where(fits, edges[start[k].astype(np.int64) * wide + np.where(fits, both, 0)], -1)

        edge = np.append(over(np.arange(len(word) - 1)), -1) if len(word) else np.zeros(0, np.int32)
        rank = ranks[edge]
        while len(word):
            new = np.append(True, word[1:] != word[:-1])
            heads = np.flatnonzero(new)
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(word))))
            open_ = best != _NONE
            hit = np.flatnonzero(open_ & (rank == best))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])] if len(hit) else hit  # the leftmost in each word
            size[hit] += size[hit + 1]
            found[hit] = edge[hit]
            done = ~open_
            if done.any():
                starts.append(start[done])
                founds.append(found[done])
            keep = open_
            keep[hit + 1] = False  # taken in
            left = np.flatnonzero(keep)
            at = np.searchsorted(left, hit)
            word, start, size, found, edge, rank = (x.take(left) for x in (word, start, size, found, edge, rank))
            for k in (at, at[at > 0] - 1):
                inner = k[k + 1 < len(word)]
                edge[k] = -1
                edge[inner] = over(inner)
                rank[k] = ranks[edge[k]]
        for w in np.flatnonzero(~short):
            s, f = self._merge_one(int(first[w]), int(length[w]), edges)
            starts.append(s)
            founds.append(f)
        none = np.zeros(0, np.int64)
        return np.concatenate(starts or [none]).astype(np.int64), np.concatenate(founds or [none])

    def _merge_one(self, first: int, n: int, edges: np.ndarray):
        """The same for one long word, with a heap of candidate edges."""
        wide = self.depth + 1
        edge = edges[first * wide : (first + n) * wide].tolist()
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        found = [edge[i * wide + 1] for i in range(n)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (both := size[i] + size[j]) <= self.depth and (p := edge[i * wide + both]) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), i, both, p))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both, p = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != both:
                continue  # one of the two is merged already
            size[i], size[j], found[i] = both, 0, p
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        left = [i for i in range(n) if size[i]]
        return first + np.array(left), np.array([found[i] for i in left])

    def _forward(self, first, length, code, key, piece):
        """(start, piece) of the best path through each word; unknown characters cost ten below the least score."""
        start, size, score = key // (self.depth + 1), key % (self.depth + 1), self.scores[piece]
        inside = np.ones(len(code), bool)
        inside[(first + length)[:-1]] = False
        inside[start[size == 1]] = False
        alone = np.flatnonzero(inside)
        start, size = np.concatenate((start, alone)), np.concatenate((size, np.ones(len(alone), np.int64)))
        piece = np.concatenate((piece, np.full(len(alone), -1)))
        score = np.concatenate((score, np.full(len(alone), self.scores.min() - 10)))
        word = np.searchsorted(first, start, side="right") - 1
        target = start + size  # positions are nodes: a word's last one is its separator
        step = target - first[word]
        order = np.lexsort((target, step))
        start, target, piece, score, step = (x[order] for x in (start, target, piece, score, step))
        best, back = np.zeros(len(code) + 1), np.full(len(code) + 1, -1)
        new = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        bounds = np.searchsorted(step, np.arange(1, int(length.max(initial=0)) + 2))
        groups = np.searchsorted(new, bounds)
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            heads = new[groups[k] : groups[k + 1]]
            if not len(heads):
                continue
            sums = best[start[a:b]] + score[a:b]
            most = np.maximum.reduceat(sums, heads - a)
            best[target[heads]] = most
            count = np.diff(np.append(heads, b))
            right = np.flatnonzero(sums == np.repeat(most, count)) + a
            back[target[right][::-1]] = right[::-1]  # the first of equal ones
        node, starts, founds = (first + length)[length > 0], [], []
        head = first[length > 0]
        while len(node):
            edge = back[node]
            starts.append(start[edge])
            founds.append(piece[edge])
            node = start[edge]
            node, head = node[node > head], head[node > head]
        none = np.zeros(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(founds or [none])

    def _words(self, text: str) -> list[str]:
        """The words of a text, without the mark of a single space in front."""
        if not text:
            return []
        if self.whole_texts:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " not in text and text[0] != " " and SPACE not in text:
            return text.split(" ")
        return [w[1:] if w[1:2] != SPACE else w for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words met before are not encoded again."""
        split = [self._words(t) for t in texts]
        met = set().union(*split)
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        missing = met.difference(kept)
        for w in missing.intersection(older):
            kept[w] = older[w]
        new = list(missing.difference(older))
        kept.update(zip(new, self.encode_words([w if w[:1] == SPACE else SPACE + w for w in new])))
        return [b"".join(map(kept.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """What the ids stand for; ids outside the vocabulary are an error."""
        return self.decode_lists(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of several lists, ids[ends[0]:ends[1]] and so on, without the space put in front of each."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.pieces.size:
            raise IndexError("an id stands for no piece")
        if self.surface is None:
            sizes = np.array([len(x) for x in self.pieces.surface])
            self.surface = np.frombuffer(b"".join(self.pieces.surface), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, begin, sizes = self.surface
        out: list[bytes] = []
        for k in range(0, len(ends) - 1, 64):  # some lists at a time
            some = ends[k : k + 65]
            part = ids[some[0] : some[-1]]
            size = sizes[part]
            after = np.cumsum(size)
            text = data[np.repeat(begin[part] - after + size, size) + np.arange(after[-1] if len(after) else 0)].tobytes()
            cut = np.append(0, after)[some - some[0]].tolist()
            out += [text[a + (text[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(cut, cut[1:])]
        return out


def _matcher(df: DataFrame, model_file: str):
    return session_of(df).sparkContext.broadcast(Matcher(load_pieces(model_file)))


def _parts(text: pa.Array) -> list[pa.Array]:
    """A batch in parts of about SPLIT_BYTES, a text at least each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(size // SPLIT_BYTES)) + 1 if len(size) else []
    bounds = [0, *cuts, len(text)]
    return [text.slice(a, b - a) for a, b in zip(bounds, bounds[1:])]


@own_columns
def encode_texts(docs: DataFrame, text_col="text", ids_col="piece_ids", model_file=DEFAULT_MODEL, check: bool = False) -> DataFrame:
    """docs with the ids of each text (replacing a column of that name). With check they are decoded at once, and ids that
    don't give a text back raise an error."""
    sent = _matcher(docs, model_file)

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = sent.value.fresh()
        for batch in texts:
            yield pa.concat_arrays([encoded(matcher, part) for part in _parts(batch)])
            give_back()
        del matcher
        give_back()

    def encoded(matcher: Matcher, text: pa.Array) -> pa.Array:
        plain = [t or "" for t in text.to_pylist()]
        coded = matcher.encode(plain)
        ends = np.cumsum([0] + [len(c) // 4 for c in coded])
        ids = np.frombuffer(b"".join(coded), "<i4")
        if check:
            for t, back in zip(plain, matcher.decode_lists(ids, ends)):
                if t.encode() != back and t.replace(SPACE, " ").encode() != back:  # the mark of spaces comes back as one
                    raise ValueError(f"piece ids do not give back the text {t[:80]!r}")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    return docs.withColumn(ids_col, arrow_column(encode, "array<int>", F.col(text_col)))


@own_columns
def decode_ids(rows: DataFrame, ids_col="piece_ids", text_col="decoded", model_file=DEFAULT_MODEL) -> DataFrame:
    """rows with the text of each list of ids (replacing a column of that name)."""
    sent = _matcher(rows, model_file)

    def decode(ids: pa.Array) -> pa.Array:
        texts = sent.value.decode_lists(ids.values.to_numpy(), ids.offsets.to_numpy())
        valid = pa.array([t if known else None for t, known in zip(texts, ids.is_valid().to_pylist())], pa.binary())
        try:
            return valid.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([None if t is None else t.decode("utf-8", "replace") for t in valid.to_pylist()], pa.string())

    return rows.withColumn(text_col, arrow_column(decode, "string", F.col(ids_col)))


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", model_file=DEFAULT_MODEL) -> DataFrame:
    """One row per document: the id, n_pieces, ids_sha256 (ids joined by commas), decoded_sha256, exact (the text came back)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    done = decode_ids(encode_texts(rows, "__text", "__ids", model_file), "__ids", "__decoded", model_file)
    return done.select(
        F.col("__id").alias(id_col),
        F.size("__ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join(F.col("__ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("__decoded", 256).alias("decoded_sha256"),
        (F.col("__decoded") == F.col("__text")).alias("exact"),
    )
