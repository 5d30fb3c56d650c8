"""Quality rules with host verdicts.

Every document is measured once.  Hard rules (too few words; repeated five-word windows) reject it alone.
Soft rules have two limits: a lenient one that holds everywhere and a strict one that holds on hosts
with a bad record.  A host's record for a rule is the share of its documents beyond the strict limit,
shrunk towards the corpus by a beta prior whose parameters are estimated from all hosts (method of
moments on rates of unequal counts); a host is bad if the shrunk rate is at least ``BAD_RATE``.
A document that breaks no rule is kept on any host.

Defined cases: a null text has no words and fails; a null host is a host of its own; a host of one
document is judged by the prior mostly; where all hosts agree the prior is so strong that only the
corpus rate counts; a corpus without rows gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, own_columns, saved, session_of

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Soft rules: the strict and the lenient limit of a ratio of two measures.
SOFT = {
    "symbols": ("n_symbols", "n_words", 0.3, 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3, 0.5),
    "long_words": ("word_chars", "n_words", 12.0, 20.0),
}
BAD_RATE = 0.3
#: Verdicts of up to so many hosts are broadcast (about 100 bytes each), more are joined by shuffle.
BROADCAST_HOSTS = 200_000
#: The prior's weight, in documents, is kept in these bounds.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat, len(lines)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_MEASURES = "struct<" + ",".join(f"{n}:bigint" for n in _NAMES) + ">"


def _measures(text: pa.Array) -> pa.Array:
    rows = [measure(t or "") for t in text.to_pylist()]
    columns = zip(*rows) if rows else [()] * len(_NAMES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_NAMES))


def _over(rule: str, limit: int, m: str = "") -> Column:
    """Whether a ratio is beyond the strict (0) or lenient (1) limit; nothing is beyond it without words."""
    top, bottom, *limits = SOFT[rule]
    return (F.col(m + bottom) > 0) & (F.col(m + top) > F.lit(limits[limit]) * F.col(m + bottom))


def _base_failed(m: str = "") -> Column:
    return (F.col(m + "n_words") < MIN_WORDS) | (100 * F.col(m + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(m + "n_words"))


def host_verdicts(measured: DataFrame, host_col: str, m: str = "", bad_rate: float = BAD_RATE) -> DataFrame:
    """One row per host: __host, __docs, and for each soft rule __rate_<rule> (shrunk) and __bad_<rule>."""
    fails = [F.sum(_over(r, 0, m).cast("double")).alias(f"__fails_{r}") for r in SOFT]
    hosts = saved(measured.groupBy(F.col(host_col).alias("__host")).agg(F.count(F.lit(1)).alias("__docs"), *fails))
    n = F.col("__docs").cast("double")
    moments = [F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for r in SOFT:
        f = F.col(f"__fails_{r}")
        moments += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / n).alias(f"ff_{r}")]
    s = hosts.agg(*moments).first()  # one row of sums
    out = hosts
    for r in SOFT:
        mean, weight = 0.0, MOST_PRIOR
        if s["n"]:
            mean = s[f"f_{r}"] / s["n"]
            free = s["n"] - s["nn"] / s["n"]
            between = (s[f"ff_{r}"] - s[f"f_{r}"] ** 2 / s["n"] - (s["hosts"] - 1) * mean * (1 - mean)) / free if free > 0 else 0.0
            if between > 0:
                weight = min(MOST_PRIOR, max(LEAST_PRIOR, mean * (1 - mean) / between - 1))
        rate = (F.col(f"__fails_{r}") + F.lit(mean * weight)) / (n + F.lit(weight))
        out = out.withColumn(f"__rate_{r}", rate).withColumn(f"__bad_{r}", F.col(f"__rate_{r}") >= bad_rate)
    return out.drop(*[f"__fails_{r}" for r in SOFT])


def _judged(measured: DataFrame, host_col: str, m: str, bad_rate: float, broadcast_hosts: int, stats: DataFrame | None = None) -> DataFrame:
    """measured with __kept."""
    verdicts = host_verdicts(measured if stats is None else stats, host_col, m, bad_rate)
    if verdicts.count() <= broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    out = measured.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    broken = F.lit(False)
    for r in SOFT:
        broken = broken | _over(r, 1, m) | (_over(r, 0, m) & F.col(f"__bad_{r}"))
    return out.withColumn("__kept", ~_base_failed(m) & ~broken)


def quality_report(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", bad_rate=BAD_RATE, broadcast_hosts=BROADCAST_HOSTS) -> DataFrame:
    """One row per document: the id, the measures, base_failed, host_docs, a shrunk rate for each soft rule, kept."""
    session_of(docs)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__source"), arrow_column(_measures, _MEASURES, F.col(text_col)).alias("__m"))
    measured = saved(rows.select("__id", "__source", "__m.*"))
    done = _judged(measured, "__source", "", bad_rate, broadcast_hosts)
    rates = [F.col(f"__rate_{r}").alias(f"host_rate_{r}") for r in SOFT]
    names = [n for n in _NAMES if n != "n_lines"]
    return done.select(F.col("__id").alias(id_col), *names, _base_failed().alias("base_failed"), F.col("__docs").alias("host_docs"), *rates, F.col("__kept").alias("kept"))


@own_columns
def quality_filter(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", bad_rate=BAD_RATE, broadcast_hosts=BROADCAST_HOSTS) -> DataFrame:
    """The kept rows of docs with all their columns. Texts are measured once for the hosts and once to filter."""
    session_of(docs)
    measured = docs.withColumn("__source", F.col(host_col)).withColumn("__m", arrow_column(_measures, _MEASURES, F.col(text_col), once=True))
    done = _judged(measured, "__source", "__m.", bad_rate, broadcast_hosts, measured.select("__source", "__m"))
    return done.filter("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
