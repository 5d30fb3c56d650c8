"""Slices of the two-strand text against the text itself."""

import random

import pytest

from helixframe.operators import text

RND = random.Random(31)
SEQS = ["".join(RND.choice("ACGTN") for _ in range(n)) for n in (1200, 0, 3, 511, 1, 512, 40)]
HALF = "".join(s + "$" for s in SEQS)
WHOLE = HALF + HALF[:-1][::-1].translate(str.maketrans("ACGT", "TGCA")) + "$"


@pytest.fixture(scope="module")
def seqs(spark):
    return text.with_coordinates(spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(SEQS)], "seq_id bigint, name string, seq string")).cache()


@pytest.mark.parametrize("length, bins", [(1, 1 << 16), (7, 64), (600, 100), (3000, 1 << 16), (10_000, 300)])
def test_any_range(spark, seqs, monkeypatch, length, bins):
    monkeypatch.setattr(text, "BIN", bins)
    at = sorted({0, 1, 1200, 1201, len(HALF) - 1, len(HALF), len(HALF) + 1, len(WHOLE) - 2, len(WHOLE) - 1} | {RND.randrange(len(WHOLE)) for _ in range(60)})
    points = spark.createDataFrame([(p, "x") for p in [*at, at[3]]], "pos bigint, seq_id string")  # a repeated row, a name that sequences have too
    got = text.two_strand_slice(points, seqs, "pos", length)
    assert got.columns == ["pos", "seq_id", "slice"]
    assert sorted(got.collect()) == sorted((p, "x", WHOLE[p : p + length]) for p in [*at, at[3]])


def test_every_symbol(spark, seqs):
    points = spark.range(len(WHOLE)).withColumnRenamed("id", "pos")
    assert "".join(r.symbol for r in text.two_strand_symbol(points, seqs).orderBy("pos").collect()) == WHOLE


@pytest.mark.parametrize("pos", [-1, len(WHOLE), None])
def test_positions_outside_raise(spark, seqs, pos):
    with pytest.raises(Exception, match="the text has positions"):
        text.two_strand_slice(spark.createDataFrame([(0,), (pos,)], "pos bigint"), seqs, "pos", 4).collect()


def test_nothing_asked_and_no_text(spark, seqs):
    none = spark.createDataFrame([], "pos bigint")
    assert text.two_strand_slice(none, seqs, "pos", 4).count() == 0
    assert text.two_strand_slice(none, seqs.limit(0), "pos", 4).count() == 0
