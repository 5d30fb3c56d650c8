"""Queries with unknown symbols, which match anything: the same hits as comparing every query with every k-mer."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import neighbors, text

RND = random.Random(31)
TURN = str.maketrans("ACGT", "TGCA")


def sequences(spark, seqs):
    rows = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_id bigint, name string, seq string")
    return text.with_coordinates(rows).cache()


def kmers_of(seqs, k):
    return {s[i : i + k] for seq in seqs for s in (seq, seq.translate(TURN)[::-1]) for i in range(len(s) - k + 1)}


def blank(s, n):
    at = set(RND.sample(range(len(s)), n))
    return "".join("N" if i in at else c for i, c in enumerate(s))


def brute(queries, kmers, tau):
    out = set()
    for q in {q for q in queries if q is not None}:
        for s in kmers:
            places = [i for i, (x, y) in enumerate(zip(q, s)) if x == "N" or x != y or y == "N"]
            dist = sum(q[i] != "N" for i in places)
            if dist <= tau:
                out.add((q, s, dist, tuple(places)))
    return out


def hits(spark, queries, placed, k, tau):
    found = neighbors.search(spark.createDataFrame([(q,) for q in queries], "query string"), placed, k, tau)
    rows = [(r.query, r.hit, r.dist, tuple(r.at)) for r in found.select("query", "hit", "dist", neighbors.positions_of(F.col("mism"), k).alias("at")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("k, tau, bound", [(12, 2, 1 << 18), (12, 2, 300), (17, 3, 500), (33, 2, 100), (6, 3, 20)])
def test_hits_are_those_of_brute_force(spark, monkeypatch, k, tau, bound):
    monkeypatch.setattr(neighbors, "KEY_PAIRS", bound)
    seqs = ["".join(RND.choice("ACGT") for _ in range(150)) + "A" * 45, "".join(RND.choice("ACGTN") for _ in range(60)), "", "AC"]
    kmers = kmers_of(seqs, k)
    clean = sorted(s for s in kmers if "N" not in s)
    queries = [blank(RND.choice(clean), RND.randrange(0, k - tau)) for _ in range(120)] + ["A" * (k - 1) + "N", "N" + "A" * (k - 1), "A" * k, None, clean[0], clean[0]]
    assert hits(spark, queries, sequences(spark, seqs), k, tau) == brute(queries, kmers, tau)


def test_ten_thousand_kinds_of_places_are_one_plan(spark, monkeypatch):
    """No job for each kind: rounds depend on hot keys only."""
    k, seq = 24, "".join(RND.choice("ACGT") for _ in range(3000))
    queries = sorted({blank(seq[i : i + k], RND.randrange(1, 7)) for i in (RND.randrange(len(seq) - k) for _ in range(10_500))})[:10_000]
    rounds, real = [], neighbors._hot
    monkeypatch.setattr(neighbors, "_hot", lambda *a: rounds.append(1) or real(*a))
    found = {(q, s) for q, s, _, _ in hits(spark, queries, sequences(spark, [seq]), k, 1)}
    assert len(queries) == 10_000 and {q for q, _ in found} == set(queries) and len(rounds) <= 3
    some = RND.sample(queries, 40)
    assert {(q, s) for q, s in found if q in set(some)} == {(q, s) for q, s, _, _ in brute(some, kmers_of([seq], k), 1)}


def test_queries_without_enough_known_symbols_raise(spark):
    placed = sequences(spark, ["ACGTACGTACGT"])
    with pytest.raises(ValueError, match="matches everything"):
        neighbors.search(spark.createDataFrame([("NNNNNNAC",)], "query string"), placed, 8, 2)


def test_empty_sides(spark):
    assert not hits(spark, [], sequences(spark, ["ACGTACGT"]), 8, 1)
    assert not hits(spark, ["NACGTACG"], sequences(spark, [""]), 8, 1)
