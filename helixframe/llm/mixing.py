"""Mixing sources to target weights by hash thresholds.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`.  Sources, in code-point order with the null source last,
weigh 1, 2, 3, repeating, and share the size of the whole corpus; no source is asked for more than ``CAP`` times what
it has, and what is over goes to the others by weight.  Which sources stop at their cap follows from their order by
cap / weight: one running total over the sources finds the level at which the rest settles.

A target is so many whole copies of a source and a rest.  The rest is met by a threshold on the documents' hashes.
Thresholds are nested: a document under the threshold of one more copy is under those of all copies before.  To find it,
sizes are summed by source and leading bits of the hash (partially aggregated, so a hot source is ``2 ** BITS`` rows a task);
the bucket in which the budget is reached is the boundary, and only documents in it are summed again by the next bits,
until the boundary is one hash.  Nothing is sorted but the buckets of a histogram.  The boundary itself is taken if that
comes nearer to the target, so a source misses its target by half a document at most.

Hashes are the first 60 bits of the MD5 digest of id, source and text: reruns, other partitions and other orders agree.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null id hashes like an absent one; rows that repeat id,
source and text have one hash, and as many of them are taken as come nearest to the target; rows that repeat an id are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import row_numbers, running_total
from .common import free_names, saved, session_of, stored

WEIGHTS, CAP = (1, 2, 3), 3
#: Bits of the hash that a histogram takes at a time, and how many there are.
BITS, ALL_BITS = 12, 60
#: Plans of up to so many sources are broadcast (about 150 bytes each), more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash(*columns: Column) -> Column:
    """60 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in columns])), 1, ALL_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of rows (source, source_size): shares by weight of all sizes, none above cap times its own."""
    if cap < 1 or not weights or min(weights) < 1:
        raise ValueError("weights are positive, and the cap is a whole copy at least")
    rows = row_numbers(sizes.select("source", "source_size", F.col("source").isNull().alias("last")), ["last", "source"], "no")
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("bigint"))
    rows = saved(rows.select("source", "source_size", "no", "weight", (cap * F.col("source_size")).alias("most")))
    total, heavy = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # in order of most / weight, sources stop at their caps up to the first that the level of those after it leaves below
    order = [F.col("most") / F.col("weight"), "no"]
    met = running_total(running_total(rows, order, "most", "capped"), order, "weight", "lighter")
    share = lambda left, weight: F.col("weight").cast("double") * left / weight
    left, weight = F.lit(total) - F.col("capped"), F.lit(heavy) - F.col("lighter")
    level = met.filter(share(left, weight) <= F.col("most")).agg(F.min(F.struct(order[0].alias("ratio"), "no", left.alias("left"), weight.alias("weight"))).alias("x")).first().x
    target = F.least(share(F.lit(level["left"]), F.lit(level["weight"])), F.col("most").cast("double")) if level else F.col("most").cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def _sent(plan: DataFrame, few: int) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= few else plan


def _boundaries(sized: DataFrame, plan: DataFrame, bits: int, few: int) -> DataFrame:
    """source, at (the boundary's hash), take (of the rows that have it), ties (how many those are), of sources with a rest."""
    found, shift = saved(plan.filter("rest > 0").select(F.col("source").alias("of"), "rest", F.lit(0.0).alias("below"), F.lit(0).cast("bigint").alias("prefix"))), ALL_BITS
    while True:
        # of each source the documents whose leading bits are those of the boundary
        inside = sized.join(_sent(found, few), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift) == F.col("prefix")))
        shift = max(shift - bits, 0)
        sums = inside.groupBy("of", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("ties"), (F.min("hash") == F.max("hash")).alias("one"), F.min("rest").alias("rest"), F.min("below").alias("base")
        )
        before = Window.partitionBy("of").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a source's buckets: 2 ** bits at most
        reached = sums.withColumn("below", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0))).filter(F.col("below") + F.col("words") >= F.col("rest"))
        found = saved(reached.groupBy("of").agg(F.min(F.struct("prefix", "below", "words", "ties", "one")).alias("x"), F.min("rest").alias("rest")).select("of", "rest", "x.*"))
        if shift == 0 or found.filter("not one").isEmpty():
            break
        found = found.select("of", "rest", "below", "prefix")
    each = F.col("words") / F.col("ties")  # rows of one hash are alike
    take = F.when(F.col("words") > 0, F.round((F.col("rest") - F.col("below")) / each)).otherwise(0).cast("bigint")
    # a bucket of one hash ends the search before the last bits are asked for: its documents are all that have the prefix
    return found.select("of", F.lit(shift).alias("shift"), F.col("prefix").alias("at"), take.alias("take"), "ties")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, weights, cap: int, bits: int, few: int, row: Column | None = None) -> DataFrame:
    """row (a number of its own, or what `row` gives), id, size, source_size, target, copies of each row of docs."""
    if not 1 <= bits <= ALL_BITS:
        raise ValueError(f"a histogram takes 1 to {ALL_BITS} bits")
    session_of(docs)
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    sized = stored(docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col).alias("id"), source.alias("source"), n_words(F.col(text_col)).alias("size"), _hash(F.col(id_col), source, F.col(text_col)).alias("hash")), "sizes")
    totals = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(totals, weights, cap)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("bigint")
    plan = saved(targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    edge = saved(_boundaries(sized, plan, bits, few))
    whole = saved(plan.join(edge, plan.source.eqNullSafe(edge.of), "left").select(F.col("source").alias("of"), "source_size", "target", "full", "shift", "at", "take", "ties"))
    met = sized.join(_sent(whole, few), F.col("source").eqNullSafe(F.col("of")))
    place = F.shiftright("hash", whole.select(F.coalesce(F.max("shift"), F.lit(0))).first()[0])
    extra = F.when(F.col("at").isNull(), False).when(place < F.col("at"), True).when(place > F.col("at"), False).when(F.col("take") >= F.col("ties"), True).otherwise(None)
    met = met.withColumn("extra", F.when((F.col("take") <= 0) & (place == F.col("at")), False).otherwise(extra))
    if not whole.filter("take > 0 and take < ties").isEmpty():
        # rows that repeat a boundary document: the first of them, in any order, since nothing tells them apart
        ties = row_numbers(met.filter("extra is null").select("row", "of", "take"), ["of", "row"], "no")
        first = ties.groupBy("of").agg(F.min("no").alias("first"))
        chosen = ties.join(first, ties.of.eqNullSafe(first.of)).filter(F.col("no") - F.col("first") < F.col("take")).select(F.col("row"), F.lit(True).alias("chosen"))
        met = met.join(chosen, "row", "left").withColumn("extra", F.coalesce("extra", "chosen", F.lit(False)))
    return met.select("row", "id", "size", "source_size", "target", (F.col("full") + F.coalesce("extra", F.lit(False)).cast("bigint")).alias("copies"))


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col: str | None = "source", weights=WEIGHTS, cap=CAP, bits=BITS, broadcast_sources=BROADCAST_SOURCES) -> DataFrame:
    """One row per document: the id, size, source_size, target (its source's), taken (words, repeats counted), copies."""
    done = _mixed(docs, id_col, text_col, source_col, weights, cap, bits, broadcast_sources)
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col: str | None = "source", weights=WEIGHTS, cap=CAP, bits=BITS, broadcast_sources=BROADCAST_SOURCES) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is copied, with all its columns. docs are written once, so that rows keep their numbers."""
    (number,) = free_names(docs, "row_of_mix")
    kept = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix")
    done = _mixed(kept, id_col, text_col, source_col, weights, cap, bits, broadcast_sources, F.col(number))
    copies = done.filter("copies > 0").select(F.col("row").alias(number), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return kept.join(copies, number).select(*[F.col(f"`{c}`") for c in docs.columns])
