"""LM scoring: the marginal probability of a document under a subword lattice.

Words are lower-cased (A-Z) stretches without white space; every document ends with one end token.
The lattice of a word has an edge for each vocabulary piece that matches inside it (behind the usual
leading space mark) and, where no piece has a character, one for the bytes of that character.  Pieces are matched along a
trie, symbol by symbol.  A forward recursion in log space adds up all segmentations.
Pieces never cross words, so a document's log probability is the sum over its words and its end, and
each distinct word's lattice is worked out once for the corpus.

Piece weights: a unigram vocabulary's scores are log probabilities and are taken as they are.  The installed vocabulary is
BPE, whose scores are only minus the merge rank r; they give first weights, 1 / (r + ``OFFSET``) and ``END`` for the end, and
``ROUNDS`` rounds of expectation-maximization fit them to the training documents: forward-backward gives how often each piece is
expected in each distinct training word, times its count; sums over all of them (and ``ADDED`` for each piece, one of the 256
bytes and the end) are the next weights.  The vocabulary stays as it is.

Beside it stands the corpus's own word model: with c the training count of a token, N of all and V
distinct ones, log10((c + 0.1) / (N + 0.1 (V + 1))).  Counts come from every document whose
crc32(id) mod 10 isn't 0.  Tokens that make up at least one in ``FREQUENT`` of all tokens (so at most
FREQUENT of them) are sent to the tasks; all others are joined by token, without their documents' texts.

Defined cases: a null text is empty and has the end only; a row without an id is held out (its id's text is
empty, crc32 0); without training rows N and V are 0 and the first weights stay; repeated rows are scored each.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, session_of, stored
from .pieces import DEFAULT_MODEL, SPACE, UNIGRAM, UNUSED, load_pieces

ADDED, HELD_OUT_OF = 0.1, 10
OFFSET, END, ROUNDS = 2.7, 1e-3, 2
FREQUENT = 300_000
#: Distinct tokens that a task gathers before it passes them on.
HELD_TOKENS = 400_000


class Lattice:
    """Log probabilities of words (natural logarithm). log: of each piece, then of a byte, then of the end."""

    def __init__(self, model_file: str = DEFAULT_MODEL, end: float = END, offset: float = OFFSET):
        p = load_pieces(model_file)
        usable = np.flatnonzero(p.scores > UNUSED)
        self.trained = p.kind == UNIGRAM
        weight = np.exp(p.scores[usable] - p.scores[usable].max()) if self.trained else 1 / (offset - p.scores[usable])
        byte = weight.min(initial=1.0)
        scale = (1 - end) / (weight.sum() + 256 * byte)
        self.log = np.log(np.concatenate((weight * scale, [byte * scale, end])))
        self.byte, self.end = len(usable), len(usable) + 1
        node: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        found: dict[int, int] = {}
        for k, i in enumerate(usable.tolist()):
            text = p.texts[i]
            for n in range(1, len(text) + 1):
                if text[:n] not in node:
                    edges[node[text[: n - 1]] << 21 | ord(text[n - 1])] = node[text[:n]] = len(node)
            found[node[text]] = k
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[int(k)] for k in self.keys], np.int64)
        self.piece = np.array([found.get(n, -1) for n in range(len(node))], np.int64)

    def fitted(self, counts: dict[int, float]) -> Lattice:
        """The same pieces with weights from expected counts (of a byte: of all 256 together)."""
        one = copy.copy(self)
        weight = np.full(len(self.log), ADDED)
        weight[list(counts)] += list(counts.values())
        whole = weight.sum()
        weight[self.byte] /= 256
        one.log = np.log(weight / whole)
        return one

    def words(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word; words that aren't UTF-8 can't occur in Arrow texts."""
        parts = [self._forward(e)[1] for _, _, e in self._batches(words)]
        return np.concatenate([np.zeros(0), *parts])

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece, and a byte, is expected in words that occur so many times."""
        out = np.zeros(len(self.log))
        for a, b, edges in self._batches(words):
            first, source, target, piece, many, log, _, word = edges
            alpha, total = self._forward(edges)
            beta = self._backward(edges)
            share = np.exp(alpha[source] + log + beta[target] - total[word]) * times[a:b][word]
            out += np.bincount(piece, share * many, len(out))
        return out

    def _batches(self, words: list[bytes]):
        """(a, b, edges of the lattices of words a to b - 1), a bounded number of characters at a time."""
        batch, size, at = [], 0, 0
        for i, w in enumerate(words):
            batch.append(SPACE + w.decode())
            size += len(batch[-1])
            if size > 500_000 or i + 1 == len(words):
                yield at, i + 1, self._edges(batch)
                batch, size, at = [], 0, i + 1

    def _edges(self, texts: list[str]):
        """first node of each word and one past the last; source, target, piece, times (of bytes), log, step of the target and word of every edge, by step and target."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(length) - length
        word = np.repeat(np.arange(len(texts)), length)
        left = (first + length)[word] - np.arange(len(code))  # characters from here to the end of the word
        starts, sizes, pieces = [], [], []
        live, node, k = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        single = np.zeros(len(code), bool)
        while len(live):
            inside = left[live] > k
            live, node = live[inside], node[inside]
            key = node << 21 | code[live + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, node, k = live[found], self.child[at[found]], k + 1
            piece = self.piece[node]
            whole = piece >= 0
            starts.append(live[whole])
            sizes.append(np.full(int(whole.sum()), k))
            pieces.append(piece[whole])
            if k == 1:
                single[live[whole]] = True
        alone = np.flatnonzero(~single)
        starts.append(alone)
        sizes.append(np.ones(len(alone), np.int64))
        pieces.append(np.full(len(alone), self.byte))
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        c = code[start]
        many = np.where(piece == self.byte, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
        own = word[start]
        source, target = start + own, start + own + size  # each word has one node more than characters
        step = start + size - first[own]  # how far into its word an edge ends
        order = np.lexsort((target, step))
        log = self.log[piece] * many
        nodes = np.append(first + np.arange(len(texts)), len(code) + len(texts))
        return nodes, *(x[order] for x in (source, target, piece, many, log, step, own))

    def _forward(self, edges) -> tuple[np.ndarray, np.ndarray]:
        """The log of what reaches each node, and of what reaches the end of each word."""
        first, source, target, _, _, log, step, _ = edges
        alpha = np.zeros(first[-1])
        new = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        bounds = np.searchsorted(step, np.arange(1, step[-1] + 2)) if len(step) else np.zeros(1, np.int64)
        groups = np.searchsorted(new, bounds)
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            at = new[groups[k] : groups[k + 1]]
            alpha[target[at]] = np.logaddexp.reduceat(alpha[source[a:b]] + log[a:b], at - a)
        return alpha, alpha[first[1:] - 1]

    def _backward(self, edges) -> np.ndarray:
        """The log of what leads from each node to the end of its word."""
        first, source, target, _, _, log, _, word = edges
        beta = np.zeros(first[-1])
        step = source - first[word]
        order = np.lexsort((source, step))
        source, target, log, step = (x[order] for x in (source, target, log, step))
        new = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        bounds = np.searchsorted(step, np.arange(0, step[-1] + 2)) if len(step) else np.zeros(1, np.int64)
        groups = np.searchsorted(new, bounds)
        for k in range(len(bounds) - 2, -1, -1):
            a, b = bounds[k], bounds[k + 1]
            at = new[groups[k] : groups[k + 1]]
            if len(at):
                beta[source[at]] = np.logaddexp.reduceat(beta[target[a:b]] + log[a:b], at - a)
        return beta


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text; bytes.lower and bytes.split know ASCII only. The end is counted apart, as b''."""
    return text.lower().split()


def _held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_OF)) == 0


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """token (the end is empty), c: every token of the corpus with its count in the training documents, t: in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            seen, unseen = held
            tokens = list(seen.keys() | unseen.keys())
            c = [seen[w] for w in tokens]
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(c, pa.int64()), pa.array([n + unseen[w] for n, w in zip(c, tokens)], pa.int64())], ["token", "c", "t"])

        held: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, unseen in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = tokens_of(text)
                words.append(b"")
                held[unseen].update(words)
                if sum(map(len, held)) > HELD_TOKENS:
                    yield out(held)
                    held = Counter(), Counter()
        if any(held):
            yield out(held)

    found = docs.select(F.col(text_col).alias("text"), _held_out(id_col).alias("held_out")).mapInArrow(count, "token binary, c bigint, t bigint")
    return found.groupBy("token").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def fit(counts: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Lattice:
    """The lattice with weights fitted to training tokens (token, c). What is collected in a round is a number for each piece."""
    spark = counts.sparkSession
    if lattice.trained:
        return lattice
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = sent.value  # noqa: B023  sent before the next round
            sums = np.zeros(len(lattice.log))
            for batch in batches:
                words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                ends = np.array([not w for w in words], bool)
                sums[lattice.end] += times[ends].sum()
                sums += lattice.expected([w for w in words if w], times[~ends])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

        found = counts.filter("c > 0").select("token", "c").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if found:
            lattice = lattice.fitted({r.piece: r.n for r in found})
    return lattice


def lm_scores(docs: DataFrame, id_col="doc_id", text_col="text", model_file=DEFAULT_MODEL, frequent=FREQUENT, rounds=ROUNDS) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = session_of(docs)
    counts = stored(token_counts(docs, id_col, text_col), "tokens")
    lattice = spark.sparkContext.broadcast(fit(counts, Lattice(model_file), rounds))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            logs = lattice.value.words(words)
            logs[[i for i, w in enumerate(words) if not w]] = lattice.value.log[lattice.value.end]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs / math.log(10))], ["token", "c", "t", "log"])

    tokens = stored(counts.mapInArrow(weigh, "token binary, c bigint, t bigint, log double"), "tokens")
    total = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n, v = total["n"], total["v"]
    below = math.log10(n + ADDED * (v + 1))
    often = F.col("t") * frequent >= max(total["t"], 1)
    known = {bytes(r.token): (r.c, r.log) for r in tokens.filter(often).collect()}  # at most `frequent`, as their shares add up to 1
    sent = spark.sparkContext.broadcast({t: (math.log10(c + ADDED) - below, log, c > 0) for t, (c, log) in known.items()})
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            columns = [[], [], [], []]
            for text in as_bytes(batch.column(3)):
                words = tokens_of(text)
                words.append(b"")
                n_known, base, score = 0, 0.0, 0.0
                for w, k in Counter(words).items():
                    if got := get(w):
                        n_known += k * got[2]
                        base += k * got[0]
                        score += k * got[1]
                for c, x in zip(columns, (len(words), n_known, base, score)):
                    c.append(x)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([1] * len(batch), pa.int64()), *arrays], names)

    names = ["id", "hash", "held_out", "rows", "n_tokens", "n_known", "base", "score"]
    id_type = docs.schema[id_col].dataType.simpleString()
    whole = texts.mapInArrow(sums, f"id {id_type}, hash bigint, held_out boolean, rows bigint, n_tokens bigint, n_known bigint, base double, score double")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            row, token, times = [], [], []
            for i, text in enumerate(as_bytes(batch.column(3))):
                for w, k in Counter(tokens_of(text)).items():
                    if w not in held:
                        row.append(i)
                        token.append(w)
                        times.append(k)
            if b"" not in held:  # only where nothing is frequent
                row += range(len(batch))
                token += [b""] * len(batch)
                times += [1] * len(batch)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(token, pa.binary()), pa.array(times, pa.int64())], ["id", "hash", "held_out", "token", "k"])

    others = texts.mapInArrow(rare, f"id {id_type}, hash bigint, held_out boolean, token binary, k bigint").join(tokens.filter(~often).drop("t"), "token")
    zero = F.lit(0).cast("bigint")
    others = others.select(
        "id", "hash", "held_out", zero.alias("rows"), zero.alias("n_tokens"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * (F.log10(F.col("c") + ADDED) - F.lit(below))).alias("base"), (F.col("k") * F.col("log")).alias("score")
    )
    done = whole.unionByName(others).groupBy("id", "hash", "held_out").agg(*[F.sum(c).alias(c) for c in names[3:]])
    each = done.withColumn("copy", F.explode(F.expr("array_repeat(1, cast(rows as int))")))  # repeated rows were added up
    share = lambda c: (F.col(c) / F.col("rows")).alias(c)
    each = each.select("id", "held_out", share("n_tokens"), share("n_known"), share("base"), share("score"))
    return each.select(F.col("id").alias(id_col), "held_out", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("n_known").cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
