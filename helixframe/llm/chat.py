"""Chat formatting by token-level assembly.

Every turn is encoded by itself: its escaped text with the ordinary vocabulary, its marks as reserved
ids above it, so no text can ever encode to a mark.  A conversation is its turns' ids one after another;
where each turn begins, and so the loss mask, are prefix sums over the turns, which a window computes
without bringing a conversation into memory.  ``chat_segments`` returns a row per turn;
``chat_examples`` joins the rows of a conversation into one example (ids and mask), for
conversations that fit a task; ``read_back`` restores the turns from ids and mask, as a stream.

In the formatted text a control string inside a turn is escaped: a backslash goes after its first
character, and a backslash becomes two.  Neither changes what a reader of marks sees, and both are
undone exactly.

Template: ``<s>`` before the first turn; system ``<<SYS>>`` text ``<</SYS>>``; user ``[INST]`` text
``[/INST]``; assistant text ``</s>``; any other role ``[ROLE]`` role ``[/ROLE]`` text ``</s>``.
The loss mask covers the ids of assistant texts, and with ``learn_close`` the mark after them.

Defined cases: a null text or role is empty; rows go by turn (nulls first), then role, then a hash of the text, so ties and
repeated rows have an order; rows with a null conversation id are one conversation; ids may be of any type that can be
ordered; roles are told apart exactly (``User`` is another role than ``user``); a text of any length is one segment.
A conversation's rows pass through one task, in order and one at a time, as its digests are taken over the whole of it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session_of

#: The reserved marks, in the order of their ids from the vocabulary's end.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_TO_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(\\?)")
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Added to what is read: a pattern that cuts a text into pieces for byte-level BPE (public, as in the vocabulary's notes).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: What SPLIT takes for white space. Longer runs than LONG_RUN are encoded by themselves: the tokenizer's matcher steps back over
#: a run to its last character, and keeps a place for each step.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1000
_LONG_WHITE = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Codec:
    """Ids of texts and marks, and back. Holds the vocabulary file's content, so it can be sent to workers."""

    def __init__(self, vocabulary: bytes):
        self.vocabulary = vocabulary

    @property
    def first_mark(self) -> int:
        return _encoding(self.vocabulary)[1]

    def mark(self, control: str) -> int:
        return self.first_mark + CONTROLS.index(control)

    def encode(self, text: str) -> list[int]:
        """One segment, whole whatever its length. SPLIT cuts a run of white space before its last character, which goes with what
        follows; where the text ends with it, the run is one piece. So a run but that character is encoded as the piece that it is."""
        encoding, ids, at = _encoding(self.vocabulary)[0], [], 0
        for m in _LONG_WHITE.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += encoding.encode_ordinary(text[at : m.start()])
            ids += encoding.encode_ordinary(text[m.start() : end])  # the text's end comes behind it now: one piece
            at = end
        return ids + encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return _encoding(self.vocabulary)[0].decode_bytes(ids)

    def turn(self, role: str, text: str, learn_close: bool) -> tuple[list[int], int, int, int]:
        """The ids of a turn, where its loss begins and ends, and the characters it takes when formatted."""
        before, after = MARKS.get(role, (None, "</s>"))
        body = escape(text)
        chars = len(body) + len(after)
        if before is None:
            name = escape(role)
            ids = [self.mark("[ROLE]"), *self.encode(name), self.mark("[/ROLE]")]
            chars += len("[ROLE]") + len(name) + len("[/ROLE]")
        else:
            ids = [self.mark(before)] if before else []
            chars += len(before)
        first = len(ids)
        ids += self.encode(body)
        end = len(ids)
        ids.append(self.mark(after))
        return (ids, first, end + learn_close, chars) if role == "assistant" else (ids, 0, 0, chars)


def load_codec(spark: SparkSession, vocabulary: str = DEFAULT_VOCABULARY) -> Codec:
    """The vocabulary file is part of the installation, as large for any corpus, and is read on the driver."""
    with open(vocabulary, "rb") as f:
        return Codec(f.read())


_SEGMENT = "struct<ids:array<int>,loss_first:int,loss_end:int,chars:bigint>"
_ARROW_SEGMENT = pa.struct([("ids", pa.list_(pa.int32())), ("loss_first", pa.int32()), ("loss_end", pa.int32()), ("chars", pa.int64())])


def chat_segments(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", vocabulary=DEFAULT_VOCABULARY, learn_close=False) -> DataFrame:
    """One row per turn: conv_id, position (0, 1, ... in the conversation), ids (the first turn's with <s>),
    token_start, loss_start and loss_end (tokens of the conversation; equal if no loss), chars (formatted)."""
    spark = session_of(turns)
    sent = spark.sparkContext.broadcast(load_codec(spark, vocabulary))

    def encode(role: pa.Array, text: pa.Array) -> pa.Array:
        rows = (sent.value.turn(r or "", t or "", learn_close) for r, t in zip(role.to_pylist(), text.to_pylist()))
        return pa.array([dict(zip(("ids", "loss_first", "loss_end", "chars"), r)) for r in rows], _ARROW_SEGMENT)

    encoder = F.arrow_udf(encode, _SEGMENT)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    done = rows.select("conv_id", "__turn", "__role", F.xxhash64("__text").alias("__hash"), encoder("__role", "__text").alias("s"))
    order = Window.partitionBy("conv_id").orderBy("__turn", "__role", "__hash", "s.ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.array(F.lit(sent.value.mark("<s>")))
    first = F.row_number().over(order) == 1
    placed = done.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("position"),
        "s",
        first.alias("first"),
        (F.coalesce(F.sum(F.size("s.ids").cast("bigint")).over(before), F.lit(0)) + F.when(first, 0).otherwise(1)).alias("token_start"),
    )
    ids = F.when(F.col("first"), F.concat(begin.cast("array<int>"), F.col("s.ids"))).otherwise(F.col("s.ids"))
    shift = F.col("token_start") + F.when(F.col("first"), 1).otherwise(0)
    return placed.select("conv_id", "position", ids.alias("ids"), "token_start", (shift + F.col("s.loss_first")).alias("loss_start"), (shift + F.col("s.loss_end")).alias("loss_end"), (F.col("s.chars") + F.when(F.col("first"), len("<s>")).otherwise(0)).alias("chars"))


def chat_examples(segments: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, input_ids, loss_mask (0/1 for each id)."""
    spans = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ((F.col("token_start") + i >= F.col("loss_start")) & (F.col("token_start") + i < F.col("loss_end"))).cast("tinyint"))
    rows = F.array_sort(F.collect_list(F.struct("position", "ids", spans.alias("mask"))))
    done = segments.groupBy("conv_id").agg(rows.alias("r"))
    return done.select("conv_id", F.flatten(F.transform("r", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("r", lambda x: x["mask"])).alias("loss_mask"))


class _Reader:
    """Takes the ids of a conversation in order and restores turns, loss text and formatted text."""

    def __init__(self, codec: Codec):
        self.codec, self.first_mark, self.role = codec, codec.first_mark, None
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.started = False

    def text(self, ids: np.ndarray) -> str:
        formatted = self.codec.decode(ids.tolist()).decode()
        if _CONTROL.search(formatted):
            raise ValueError("a mark stands inside a text")
        self.chars += len(formatted)
        return formatted

    def feed(self, ids: np.ndarray, loss_start: int, loss_end: int) -> None:
        """One row's ids, and which of them are under the loss mask."""
        begin, under = 0, []
        for at in np.flatnonzero(ids >= self.first_mark).tolist():
            plain = ids[begin:at]
            a, b = max(begin, loss_start), min(at, loss_end)
            if a < b:
                under.append(ids[a:b])
            begin = at + 1
            mark = CONTROLS[ids[at] - self.first_mark]
            self.chars += len(mark)
            if mark == "<s>":
                if self.started or len(plain):
                    raise ValueError("<s> doesn't begin the conversation")
                self.started = True
            elif mark in ("[INST]", "<<SYS>>"):
                self.role = "user" if mark == "[INST]" else "system"
            elif mark == "[ROLE]":
                self.role = None
            elif mark == "[/ROLE]":
                self.role = unescape(self.text(plain))
            else:
                role = "assistant" if self.role is None else self.role
                text = unescape(self.text(plain))
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n_turns += 1
                if under:
                    learnt = unescape(self.codec.decode(np.concatenate(under).tolist()).decode())
                    self.loss.update(learnt.encode())
                    self.loss_chars += len(learnt)
                self.role, under = None, []
        if begin < len(ids):
            raise ValueError("a turn isn't closed")


_READ = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_back(segments: DataFrame, vocabulary=DEFAULT_VOCABULARY) -> DataFrame:
    """One row per conversation, from ids and mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Turns pass in order, one at a time, so a conversation of any length is read in little memory."""
    spark = session_of(segments)
    sent = spark.sparkContext.broadcast(load_codec(spark, vocabulary))
    kind = segments.schema["conv_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, done, schema = None, None, [], pa.schema(_READ)

        def ended():
            done.append((now, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_READ])
            lists = batch.column("ids")
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token_start", "loss_start", "loss_end")), ends, ends[1:])
            for conv, start, a, b, first, end in rows:
                if reader is None or conv != now:
                    if reader is not None:
                        ended()
                    reader, now, expected = _Reader(sent.value), conv, 0
                if start != expected:
                    raise ValueError(f"conversation {now}: tokens {expected} to {start} are missing")
                expected += end - first
                reader.feed(ids[first:end], a - start, b - start)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if reader is not None:
            ended()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    rows = segments.select("conv_id", "position", "ids", "token_start", "loss_start", "loss_end")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return placed.mapInArrow(read, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_and_read(turns: DataFrame, vocabulary=DEFAULT_VOCABULARY) -> DataFrame:
    """The digests of every conversation of `turns`, as read back from what was formatted."""
    return read_back(chat_segments(turns, vocabulary=vocabulary), vocabulary)
