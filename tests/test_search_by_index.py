"""Backward search, located positions, mapping and slices against plain Python on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import backward, mapping, suffix, text
from helixframe.plans.index import Index

TURN = str.maketrans("ACGTN", "TGCAN")
ORDER = str.maketrans("$ACGTN", "012345")


def turned(s):
    return s.translate(TURN)[::-1]


def doubled(seqs):
    forward = "".join(s + "$" for s in seqs)
    return forward + turned(forward[:-1]) + "$"


def table(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_id bigint, name string, seq string")


def random_seqs(seed, sizes, letters="ACGTN"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(n)) for n in sizes]


SEQS = [*random_seqs(1, (60, 1, 35), "ACGT"), "A" * 40 + "CA" * 12, "ACGTN" * 5]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("index") / "x")
    Index.build_from(table(spark, SEQS), base, rate=5)
    return Index.open(spark, base)


def mixed_patterns():
    rnd = random.Random(7)
    whole = doubled(SEQS)
    out = {"", "A", "AA", "A" * 24, "N", "NA", "ACGTNACGTNACGT", "T" * 23}
    while len(out) < 90:
        i, n = rnd.randrange(len(whole)), rnd.choice([1, 2, 5, 8, 9, 13, 22])
        if "$" not in (p := whole[i : i + n]):
            out |= {p, p[: n // 2] + rnd.choice("ACGT") + p[n // 2 + 1 :]}
    return sorted(out)


@pytest.mark.parametrize("few", [20_000, 0])
def test_intervals_of_patterns_of_all_lengths(spark, index, few):
    whole = doubled(SEQS)
    suffixes = sorted((whole[i:] for i in range(len(whole))), key=lambda s: s.translate(ORDER))
    patterns = mixed_patterns()
    below = lambda p: sum(s.translate(ORDER) < p.translate(ORDER) for s in suffixes)
    want = sorted((p, below(p), below(turned(p)), sum(s.startswith(p) for s in suffixes), len(p)) for p in patterns)
    steps = backward.Occurrences(backward.occ_blocks(index.table("bwt"), suffix.occ_marks(index.table("bwt"), mark=7), mark=7), index.table("c"), len(whole), mark=7, broadcast_blocks=few)
    got = steps.pattern_intervals(spark.createDataFrame([(p,) for p in [*patterns, patterns[3], None]], "pattern string"))
    assert sorted(map(tuple, got.select("pattern", "fp", "rp", "sz", "dp").collect())) == want


def test_places_of_patterns_of_all_lengths(spark, index):
    whole = doubled(SEQS)
    patterns = [p for p in mixed_patterns() if p]
    want = sorted((p, i) for p in patterns for i in range(len(whole)) if whole.startswith(p, i))
    found = index.locate(spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert sorted((r.pattern, r.pos) for r in found) == want
    assert {r.pattern: r.n for r in index.count(spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()} == {p: sum(q == p for q, _ in want) for p in patterns}
    back = text.str_to_pos(spark.createDataFrame(found), index.table("seqs")).collect()
    placed = [r for r in found if whole[r.pos] != "$"]
    assert len(placed) == len(found) == len(back)


def plain_map(reads, seqs, tau):
    out = []
    for i, r in reads:
        places = []
        for k, s in enumerate(seqs):
            for strand, t in (("+", s), ("-", turned(s))):
                for at in range(len(t) - len(r) + 1):
                    d = sum(x != y or x == "N" for x, y in zip(r, t[at:]))
                    if d <= tau:
                        places.append((d, f"s{k}", at + 1 if strand == "+" else len(s) - at - len(r) + 1, strand))
        if places and r:
            d, name, offset, strand = min(places)
            out.append((i, name, offset, strand, d))
    return sorted(out)


@pytest.mark.parametrize("tau, k, hot", [(1, 8, 1000), (2, 20, 3), (3, 5, 1)])
def test_no_read_is_lost(spark, tau, k, hot, monkeypatch):
    monkeypatch.setattr(mapping, "HOT_PLACES", hot)
    rnd = random.Random(tau)
    seqs = [*random_seqs(tau, (900, 400), "ACGT"), "A" * 120 + "ACAC" * 30, "AC" + "N" * 3 + "GT" * 10]
    reads = []
    for n in [*range(1, 41), 64, 100, 150, 299, 300]:
        s = rnd.choice([x for x in seqs if len(x) >= n])
        at = rnd.randrange(len(s) - n + 1)
        r = list(s[at : at + n] if rnd.random() < 0.5 else turned(s[at : at + n]))
        for _ in range(rnd.randrange(tau + 2)):
            r[rnd.randrange(n)] = rnd.choice("ACGTN")
        reads.append("".join(r))
    reads = list(enumerate([*reads, "ACGTACGTACGT", "", reads[20], "N" * 12]))
    df = spark.createDataFrame(reads, "ord bigint, seq string")
    got = mapping.map_reads(df, text.with_coordinates(table(spark, seqs)), k, tau)
    assert sorted(map(tuple, got.select("read", "name", "offset", "strand", "dist").collect())) == plain_map(reads, seqs, tau)


def test_twelve_letters_with_one_mismatch_in_the_middle(spark):
    (seq,) = random_seqs(3, (200,), "ACGT")
    read = seq[50:56] + ("A" if seq[56] != "A" else "C") + seq[57:62]
    df = spark.createDataFrame([(0, read)], "ord bigint, seq string")
    assert [r.dist for r in mapping.map_reads(df, text.with_coordinates(table(spark, [seq])), 8, 1).collect()] == [1]
