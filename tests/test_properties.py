"""Random texts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.alphabet import DNA, Alphabet
from helixframe.operators import neighbors, search, suffix, text
from tests.test_golden import sequences

RC = str.maketrans("ACGT", "TGCA")


def named(seed, n=5, size=60):
    rnd = random.Random(seed)
    out = {f"s{i}": "".join(rnd.choice("ACGT" * 5 + "N") for _ in range(rnd.randrange(size))) for i in range(n)}
    out["empty"] = ""
    out["again"] = out["s0"]
    out["runs"] = "A" * 45 + "AC" * 20
    return out


def doubled(seqs):
    half = "".join(s + "$" for s in seqs.values())
    return half + half[:-1][::-1].translate(RC) + "$"


def order(x):
    return x.replace("N", "Z")


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_index(spark, seed):
    body = named(seed)
    whole = doubled(body)
    placed = text.with_coordinates(sequences(spark, body)).cache()
    positions, sa = suffix.sa_of_text(sequences(spark, body))
    expected = sorted(range(len(whole)), key=lambda p: order(whole[p:]))
    assert [r.pos for r in sa.orderBy("rank").collect()] == expected
    assert "".join(r.symbol for r in suffix.bwt(positions, sa).orderBy("rank").collect()) == "".join(whole[p - 1] for p in expected)
    # labels and positions are inverse to each other, on symbols
    points = spark.range(len(whole)).withColumnRenamed("id", "pos")
    labels = text.pos_to_str(points, placed).cache()
    assert labels.count() == len(whole) - 1  # the last separator mirrors to nothing
    back = {r.label: r.pos for r in text.str_to_pos(labels.select("label"), placed).filter("pos is not null").collect()}
    assert {p for p in back.values()} == {p for p, c in enumerate(whole) if c != "$"}
    assert all(back[r.label] == r.pos for r in labels.collect() if whole[r.pos] != "$")
    symbols = {r.pos: r.symbol for r in text.symbol_at(points.filter(F.col("pos") < len(whole) // 2), placed).collect()}
    assert "".join(symbols[p] for p in range(len(whole) // 2)) == whole[: len(whole) // 2]
    patterns = sorted({s[i : i + n] for s in body.values() for n in (1, 2, 6, 20) for i in range(0, max(0, len(s) - n + 1), 9)} | {"GATTACA", "NN", "A" * 45})
    got = {r.pattern: (r.fp, r.rp, r.sz, r.dp) for r in search.fm_interval(spark.createDataFrame([(p,) for p in patterns], "pattern string"), placed).collect()}
    suffixes = [order(whole[p:]) for p in range(len(whole))]
    for p in patterns:
        below = lambda q: sum(s < order(q) for s in suffixes)  # noqa: B023, E731
        assert got[p] == (below(p), below(p[::-1].translate(RC)), sum(s.startswith(order(p)) for s in suffixes), len(p)), p


def test_locate_finds_every_place(spark):
    body = named(3)
    whole = doubled(body)
    placed = text.with_coordinates(sequences(spark, body))
    patterns = sorted({s[i : i + 4] for s in body.values() for i in range(0, max(0, len(s) - 3), 5)})
    got = search.locate(spark.createDataFrame([(p,) for p in patterns], "pattern string"), placed, 4).collect()
    assert sorted((r.pattern, r.pos) for r in got) == sorted((p, i) for p in patterns for i in range(len(whole)) if whole.startswith(p, i))


@pytest.mark.parametrize("k, tau, unknowns", [(8, 1, 0), (9, 2, 1), (40, 3, 2)])
def test_search_with_free_unknowns(spark, k, tau, unknowns):
    body = named(4, 4, 90)
    rnd = random.Random(k)
    both = [t for s in body.values() for t in (s, s[::-1].translate(RC))]
    kmers = sorted({t[i : i + k] for t in both for i in range(len(t) - k + 1)})
    queries = []
    for q in rnd.sample(kmers, min(8, len(kmers))):
        q = list(q)
        for i in rnd.sample(range(k), unknowns):
            q[i] = "N"
        queries.append("".join(q))
    placed = text.with_coordinates(sequences(spark, body))
    got = neighbors.search(spark.createDataFrame([(q,) for q in queries], "query string"), placed, k, tau)
    found = {(r.query, r.hit): r.dist for r in got.collect()}
    want = {}
    for q in set(queries):
        for h in kmers:
            d = sum(x != y or y == "N" for x, y in zip(q, h) if x != "N")
            if d <= tau:
                want[q, h] = d
    assert found == want


def test_another_alphabet(spark):
    binary = Alphabet(("0o", "1lI"), ("01", "10"), 1)
    df = spark.createDataFrame([("0oO1lI-x",)], "s string")
    row = df.select(binary.encode("s").alias("e"), binary.reverse_complement(binary.encode("s")).alias("r"), binary.codes(binary.encode("s")).alias("c")).first()
    assert (row.e, row.r, row.c) == ("00111111", "00000011", [0, 0, 1, 1, 1, 1, 1, 1])
    assert DNA.complemented("N") is not None and binary.size == 2
    pairs = neighbors.hamming_join(df.select(F.lit("00110011").alias("kmer")), df.select(F.lit("00110111").alias("kmer")), 8, 1, alphabet=binary)
    assert [(r.dist, r.mism) for r in pairs.collect()] == [(1, [1 << 4])]
