"""HTML extraction with wrappers inferred for each host.

All pages take part: each task aligns the pages of a host that it meets into a partial wrapper, and the partial
wrappers of a host are aligned in two more steps, salted, so a host with a third of all pages costs a task no more
than a share of its partial wrappers (a few kilobytes each).  A host's wrapper says which box holds
the article, and which texts in it stand on all of its pages.  Each page is then read by its host's wrapper and gives the blocks
of that box, whole.  A page is wrapped by itself, told only which texts most of its host's pages share, where it lacks
the box, has one of a more telling name, or has most of its text in another.

Defined cases: a null or empty html has no text; a null url, or one without a host, is a host of its own (empty);
pages of one host may differ in any way; markup that is cut off or not closed is read as far as it goes, and nested as deep as it is.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, session_of, stored
from .wrapper import Node, combine, fixed_texts, main_box, parse, texts_at, wrap

#: Partial wrappers that a task holds before it passes them on, and the salts of a host's.
HELD_HOSTS, SALTS = 500, 32
#: Wrappers of up to so many characters in all are sent to the tasks, more are joined by host.
BROADCAST_CHARS = 8_000_000


def host_of(url: str | None) -> str:
    """The host of a url in lower case, without user and port."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _add(held: dict[str, Node], host: str, wrapper: Node) -> None:
    held[host] = combine(held[host], wrapper) if host in held else wrapper


def _out(held: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.plain()) for w in held.values()], pa.string())], ["host", "wrapper"])


def host_wrappers(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """host, wrapper (JSON): one row per host, from all of its pages."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _add(held, host_of(url), wrap(parse(html or "")))
                if len(held) > HELD_HOSTS:
                    yield _out(held)
                    held = {}
        if held:
            yield _out(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:  # sorted, so a host's rows come together
            for host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host != now and held:
                    yield _out(held)
                    held = {}
                now = host
                _add(held, host, Node.of(json.loads(wrapper)))
        if held:
            yield _out(held)

    columns = "host string, wrapper string"
    parts = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(first, columns)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).repartition("host", "salt").select("host", "wrapper")
    fewer = salted.sortWithinPartitions("host", "wrapper").mapInArrow(again, columns)
    return fewer.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(again, columns)


def _hosts(url: pa.Array) -> pa.Array:
    return pa.array([host_of(u) for u in url.to_pylist()], pa.string())


class Host:
    """What the pages of a host are read with."""

    def __init__(self, wrapper: Node):
        self.wrapper, self.box, self.known = wrapper, main_box(wrapper), frozenset(fixed_texts(wrapper))


def extract(html: str, host: Host | None = None) -> str:
    """The article of a page, its blocks joined by \\n; empty if the box is there and has no text."""
    page = parse(html)
    known = host.known if host else frozenset()
    own = main_box(page, known)
    texts = texts_at(page, host.box, host.wrapper) if host else None
    if texts is not None and own.path != host.box.path:
        size = sum([len(t) for t in texts])
        fresh = sum([len(t) * (0.1 if zlib.crc32(t.encode()) in known else 1.0) for t in texts])
        if own.rank > host.box.rank or (own.rank == host.box.rank and own.weight > (2 * fresh if 2 * fresh > size else fresh)):
            texts = None
    if texts is None:
        texts = texts_at(page, own)
    return "\n".join(texts or ())


@lru_cache(64)
def _host(wrapper: str | None) -> Host | None:
    return Host(Node.of(json.loads(wrapper))) if wrapper else None


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", broadcast_chars=BROADCAST_CHARS) -> DataFrame:
    """One row per page: the id, url, text, n_chars, host."""
    spark = session_of(pages)
    wrappers = stored(host_wrappers(pages, url_col, html_col), "wrappers")
    chars = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), arrow_column(_hosts, "string", F.col(url_col)).alias("host"))
    if chars <= broadcast_chars:
        sent = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})

        def texts(html: pa.Array, host: pa.Array) -> pa.Array:
            return pa.array([extract(h or "", _host(sent.value.get(k))) for h, k in zip(html.to_pylist(), host.to_pylist())], pa.string())

        done = rows.select("__id", "__url", "host", arrow_column(texts, "string", F.col("__html"), F.col("host")).alias("__text"))
    else:

        def read(html: pa.Array, wrapper: pa.Array) -> pa.Array:
            return pa.array([extract(h or "", _host(w)) for h, w in zip(html.to_pylist(), wrapper.to_pylist())], pa.string())

        joined = rows.join(wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")), F.col("host") == F.col("__host"), "left")
        done = joined.select("__id", "__url", "host", arrow_column(read, "string", F.col("__html"), F.col("__wrapper")).alias("__text"))
    return done.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.col("__text").alias("text"), F.length("__text").cast("bigint").alias("n_chars"), "host")
