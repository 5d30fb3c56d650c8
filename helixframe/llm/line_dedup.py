"""Line dedup: lines that stand in many documents stay in one of them only.

A line's key is the line without white space (\\x20, \\x09-\\x0D) at its ends and with A-Z in lower case.
Keys are hashed to 128 bits per document, once for each document, and counted over the corpus with
partial aggregation, so a line that a third of all documents hold is one row per task before the
shuffle.  Keys of at least ``min_chars`` code points that ``min_docs`` documents hold are dropped
everywhere but in the largest document id.

Defined cases: a null or empty text is one empty line; a row without an id counts as a document,
loses its lines to any id, and keeps them if no row with an id holds them; rows that repeat an id
are documents of their own, and where that id is the largest holder all of them keep the line.
A repeated line in the keeping document stays there as often as it stands there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, as_bytes, own_columns, saved, session_of, stored, with_text

MIN_CHARS, MIN_DOCS = 40, 5
#: A drop list of up to so many keys is sent to the executors (32 bytes a key); a longer one is joined.
BROADCAST_KEYS = 200_000


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, None if the key is short. bytes.strip and bytes.lower know ASCII only."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_of(min_chars: int):
    def keys(text: pa.Array) -> pa.Array:
        out = []
        for t in as_bytes(text):
            found = {_key(line, min_chars) for line in t.split(b"\n") if len(line) >= min_chars}
            found.discard(None)
            out.append(list(found))
        return pa.array(out, pa.list_(pa.binary()))

    return keys


def frequent_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """key, n_docs, keeper: what at least min_docs documents hold, and the largest id among them."""
    keys = docs.select(F.col(id_col).alias("__id"), arrow_column(_keys_of(min_chars), "array<binary>", F.col(text_col)).alias("__keys"))
    return (
        keys.select("__id", F.explode("__keys").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("__id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )


_RESULT = "struct<text:string,n_lines:bigint,n_dropped:bigint,sha256:string>"


def _rebuilt(rows, min_chars: int) -> pa.Array:
    """rows: (text, is_dropped(key)). The lines that stay, by position."""
    text, n_lines, n_dropped, digest = [], [], [], []
    for t, dropped in rows:
        lines = t.split(b"\n")
        kept = lines
        if dropped is not None:
            kept = [x for x in lines if len(x) < min_chars or (k := _key(x, min_chars)) is None or not dropped(k)]
        joined = b"\n".join(kept)
        text.append(joined)
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        digest.append(hashlib.sha256(joined).hexdigest())
    return pa.StructArray.from_arrays(
        [pa.array(text, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())],
        ["text", "n_lines", "n_dropped", "sha256"],
    )


def _annotated(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, broadcast_keys: int) -> DataFrame:
    """docs with __lines, a struct of the new text and its figures."""
    spark = session_of(docs)
    frequent = saved(frequent_lines(docs, id_col, text_col, min_chars, min_docs).filter("keeper is not null").select("key", "keeper"))
    if frequent.count() <= broadcast_keys:
        sent = spark.sparkContext.broadcast({bytes(k): v for k, v in frequent.collect()})

        def rebuild(text: pa.Array, doc: pa.Array) -> pa.Array:
            keeper = sent.value

            def test(i):
                if i is None:
                    return keeper.__contains__
                return lambda key: (k := keeper.get(key)) is not None and i < k

            return _rebuilt(((t, test(i)) for t, i in zip(as_bytes(text), doc.to_pylist())), min_chars)

        return docs.withColumn("__lines", arrow_column(rebuild, _RESULT, F.col(text_col), F.col(id_col)))
    # by row, not by id: rows that repeat an id or have none would pile up their keys in one list
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    keys = docs.select("__row", F.col(id_col).alias("__id"), arrow_column(_keys_of(min_chars), "array<binary>", F.col(text_col)).alias("__keys"))
    lost = (
        keys.select("__row", "__id", F.explode("__keys").alias("key"))
        .join(frequent, "key")
        .filter(F.col("__id").isNull() | (F.col("__id") < F.col("keeper")))
        .groupBy("__row")
        .agg(F.collect_set("key").alias("__lost"))
    )

    def rebuild_joined(text: pa.Array, lost_keys: pa.Array) -> pa.Array:
        return _rebuilt(((t, set(k).__contains__ if k else None) for t, k in zip(as_bytes(text), lost_keys.to_pylist())), min_chars)

    joined = docs.join(lost, "__row", "left").drop("__row")
    return joined.withColumn("__lines", arrow_column(rebuild_joined, _RESULT, F.col(text_col), F.col("__lost"))).drop("__lost")


def line_dedup_report(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS, broadcast_keys=BROADCAST_KEYS) -> DataFrame:
    """One row per document: the id, text (what is left), n_lines before dropping, n_dropped, kept_sha256."""
    done = _annotated(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs, broadcast_keys)
    return done.select(id_col, F.col("__lines.text").alias("text"), F.col("__lines.n_lines").alias("n_lines"), F.col("__lines.n_dropped").alias("n_dropped"), F.col("__lines.sha256").alias("kept_sha256"))


@own_columns
def line_dedup(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS, broadcast_keys=BROADCAST_KEYS) -> DataFrame:
    """docs, all rows and columns, with the text that is left."""
    done = _annotated(docs, id_col, text_col, min_chars, min_docs, broadcast_keys)
    return with_text(done, F.col("__lines.text"), text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
