"""Golden values of the data model, the index and the searches."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions.alphabet import DNA, Alphabet
from helixframe.operators import neighbors, search, suffix, text
from helixframe.operators.suffix import text_positions

REPEATS = {
    "one": "ATCGATATCAGCCACTACGAGACAA",
    "two": "ATCGATATCAGgCACTACGAGACAA",
    "three": "ATCGATATCAGCCACTACGAtACAA",
    "four": "cTCGATATCAGCCACTACGAGACAA",
    "five": "ATCGATATCAGCCACTACGAGACAc",
    "six": "ATCGATATCAcCCACTACGAGACAA",
    "seven": "ATCGATATaAGCCACTACGAGACAA",
    "eight": "ATCGATATtAGCCACTACGAGACAA",
}


def sequences(spark, named):
    rows = [(i, n, s) for i, (n, s) in enumerate(named.items())]
    return spark.createDataFrame(rows, "seq_id bigint, name string, seq string")


@pytest.fixture(scope="module")
def repeats(spark):
    return text.with_coordinates(sequences(spark, REPEATS)).cache()


def test_alphabet_codes(spark):
    rows = spark.createDataFrame([("ATCGANTANTAGCGN",), ("ACGTACJFDKACGGAACTGT",), ("aé😀ß",)], "s string")
    got = [r[0] for r in rows.select(DNA.codes(DNA.encode("s"))).collect()]
    assert got[0] == [0, 3, 1, 2, 0, 4, 3, 0, 4, 3, 0, 2, 1, 2, 4]
    assert got[1] == [0, 1, 2, 3, 0, 1, 4, 4, 4, 4, 0, 1, 2, 2, 0, 0, 1, 3, 2, 3]
    assert got[2] == [0, 4, 4, 4]
    plain = Alphabet(("Aa", "Cc", "Gg", "Tt", "Nn"), (), 4)
    assert [plain.code(c) for c in "xK$"] == [4, 4, 4] and [plain.complement(i) for i in range(5)] == [0, 1, 2, 3, 4]
    assert DNA.complement(0) == 3 and DNA.complement(4) == 4 and DNA.is_canonical("A") and not DNA.is_canonical("a")


@pytest.mark.parametrize(
    "groups, complements, default",
    [((), (), 0), (("A",), (), 0), (("A", "A"), (), 0), (("Aa", "Ca"), (), 0), (("A", "C"), ("AX",), 0), (("A", "C"), ("A",), 0), (("Aa", "C"), ("aC",), 0), (("A", "C"), (), 2), (("A", ""), (), 0)],
)
def test_alphabet_rejects(groups, complements, default):
    with pytest.raises(ValueError):
        Alphabet(tuple(groups), tuple(complements), default)


def test_coordinates_and_labels(spark):
    seqs = text.with_coordinates(sequences(spark, {"seq0": "AACCGGTTNN", "seq1": "TGATCGATCNTAGCT"})).cache()
    assert [(r.beg, r.len) for r in seqs.orderBy("seq_id").collect()] == [(0, 11), (11, 16)]
    points = spark.createDataFrame([(9,), (12,), (27,), (52,), (54,)], "pos bigint")
    assert {r.pos: r.label for r in text.pos_to_str(points, seqs).collect()} == {9: "seq0:10:+", 12: "seq1:2:+", 27: "seq1:15:-", 52: "seq0:1:-"}
    labels = {"seq0:10:+": 9, "seq1:2:+": 12, "seq1:15:-": 27, "seq0:1:-": 52, "seq1:15:+": 25, "seq1:15": 25, "seq0:0:+": None, "seq0:100:+": None, "seq0:-1:+": None, "seq0,10,+": None, "other:1:+": None, "seq0:11:+": None, "seq0:99999999999999999999:+": None}
    got = text.str_to_pos(spark.createDataFrame([(x,) for x in labels], "label string"), seqs)
    assert {r.label: r.pos for r in got.collect()} == labels
    cuts = text.text_slice(spark.createDataFrame([(8,), (11,)], "pos bigint"), seqs, "pos", 4)
    assert {r.pos: r.slice for r in cuts.collect()} == {8: "NN$", 11: "TGAT"}


@pytest.mark.parametrize("body, doubled", [({"s": "AACCGGTTNN"}, "AACCGGTTNN$NNAACCGGTT$"), ({"a": "AC", "b": "GT", "c": "NN"}, "AC$GT$NN$NN$AC$GT$")])
def test_doubled_text(spark, body, doubled):
    seqs = text.with_coordinates(sequences(spark, body))
    rows = text_positions(suffix.text_rows(seqs)).orderBy("pos").collect()
    assert "".join(r.symbol for r in rows) == doubled
    stats = text.text_statistics(seqs).first()
    assert stats.text_length == len(doubled) and stats.wildcard_count == doubled.count("$")


def positions(spark, whole):
    parts, at = [], 0
    for p in whole.split("$")[:-1]:
        parts.append((at, p))
        at += len(p) + 1
    rows = spark.createDataFrame(parts, "at bigint, part string").select("at", F.concat(DNA.encode("part"), F.lit("$")).alias("part"))
    return text_positions(rows)


TWO = "TTAGCAGTAGTCGTA$TACGACTACTGCTAA$"


@pytest.mark.parametrize(
    "whole, expected",
    [
        ("TAGCNTCGACA$", [11, 10, 8, 1, 9, 6, 3, 7, 2, 0, 5, 4]),
        ("TGNGA$TCGAT$", [11, 5, 4, 9, 7, 3, 8, 1, 10, 6, 0, 2]),
        ("AAaaAAaaA$", [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]),
        ("acgTPGaKcnN$", [11, 0, 6, 1, 8, 5, 2, 3, 10, 7, 4, 9]),
        ("$TgAgcatGGC$acTCGA$", [18, 11, 0, 17, 12, 3, 6, 10, 5, 15, 13, 16, 2, 9, 4, 8, 14, 1, 7]),
        (TWO, [31, 15, 30, 14, 29, 17, 20, 23, 2, 5, 8, 4, 18, 11, 27, 21, 24, 19, 3, 26, 12, 6, 9, 13, 28, 16, 22, 1, 7, 10, 25, 0]),
        ("TGCAAAAAA$" * 40, [399 - j - 10 * i for j in range(10) for i in range(40)]),
    ],
)
def test_suffix_array(spark, whole, expected):
    rows = suffix.suffix_array(positions(spark, whole).cache()).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(len(whole)))
    got = [r.pos for r in rows]
    if whole.startswith("TGCAAAAAA"):
        key = lambda p: whole[p:]
        assert got == sorted(range(len(whole)), key=key)
    else:
        assert got == expected


def test_bwt_c_and_occ(spark):
    where = positions(spark, TWO).cache()
    sa = suffix.suffix_array(where).cache()
    transform = suffix.bwt(where, sa).cache()
    order = [r.pos for r in sa.orderBy("rank").collect()]
    expected = [TWO[p - 1] for p in order]
    assert [r.symbol for r in transform.orderBy("rank").collect()] == expected
    assert {r.symbol: r.start for r in suffix.c_array(where).collect()} == {"A": 2, "C": 11, "G": 17, "T": 23, "N": 32}
    marks = suffix.occ_marks(transform, mark=8).cache()
    assert {(r.block, r.symbol): r.cnt for r in marks.collect()} == {(b, c): expected[: 8 * b].count(c) for b in range(4) for c in "ACGTN"}
    points = spark.createDataFrame([(p, c) for p in (0, 7, 8, 20, 31) for c in "ACGTN"], "ptr bigint, symbol string")
    assert {(r.ptr, r.symbol): r.occ for r in suffix.occ_rank(points, transform, marks, 8).collect()} == {(p, c): expected[: p + 1].count(c) for p in (0, 7, 8, 20, 31) for c in "ACGTN"}
    assert sorted(r.pos for r in suffix.sa_range(sa, 2, 3).collect()) == sorted(order[2:5])


def test_fm_intervals(spark):
    seqs = text.with_coordinates(sequences(spark, {"s": "TTAGCAGTAGTCGTA"})).cache()
    expected = {"": (0, 0, 32, 0), "A": (2, 23, 9, 1), "AA": (4, 31, 1, 2), "TAA": (24, 31, 1, 3), "CTAA": (14, 31, 1, 4), "AC": (5, 20, 3, 2), "TAC": (25, 20, 2, 3), "TACT": (26, 9, 1, 4), "CTACT": (15, 9, 1, 5)}
    got = search.fm_interval(spark.createDataFrame([(p,) for p in expected], "pattern string"), seqs)
    assert {r.pattern: (r.fp, r.rp, r.sz, r.dp) for r in got.collect()} == expected
    grown = search.children(spark.createDataFrame([("",)], "pattern string"), seqs, 0)
    assert {r.next: r.n for r in grown.collect()} == {"A": 9, "C": 6, "G": 6, "T": 9}


def test_locate(spark, repeats):
    patterns = spark.createDataFrame([(REPEATS["one"],), ("A" * 25,)], "pattern string")
    assert [(r.pos, r.label) for r in search.locate(patterns, repeats, 25).collect()] == [(0, "one:1:+")]
    assert {r.pattern: r.n for r in search.count_patterns(patterns, repeats, 25).collect()} == {REPEATS["one"]: 1, "A" * 25: 0}
    half = text.forward_length(repeats)
    found = search.locate(spark.createDataFrame([("TTGTC",)], "pattern string"), repeats, 5).select("pos", "label")
    again = text.pos_to_str(found.select("pos"), repeats)
    assert sorted(found.collect()) == sorted(again.collect()) and found.filter(F.col("pos") >= half).count() > 0


def test_approximate_search(spark, repeats):
    up = {n: s.upper() for n, s in REPEATS.items()}
    queries = spark.createDataFrame([(up[n],) for n in ("one", "three", "five", "seven")] + [("NNNNATATCAGCCACTACGAGACAA",)], "query string")
    hits = neighbors.search(queries, repeats, 25, 1).cache()
    counts = {r.query: r["count"] for r in hits.groupBy("query").count().collect()}
    assert [counts[up[n]] for n in ("one", "three", "five", "seven")] == [8, 2, 2, 3] and counts["NNNNATATCAGCCACTACGAGACAA"] == 8
    below = hits.filter("hit <= query").groupBy("query").count().collect()
    assert {r.query: r["count"] for r in below}[up["one"]] == 3


def test_annotation(spark, repeats):
    ann = neighbors.annotate(repeats, 25, 1).cache()
    labels = [f"{n}:1:{s}" for n in REPEATS for s in "+-"] + ["one:2:+"]
    got = neighbors.annotation_query(spark.createDataFrame([(x,) for x in labels], "label string"), repeats, ann, 25)
    got = {r.label: (r.dist, r.neigh_cnt, r.align_pos) for r in got.collect()}
    assert got["one:1:+"] == (1, 7, []) and got["one:2:+"] == (0, 0, [])
    for name, n, p in (("two", 1, 11), ("three", 1, 20), ("four", 1, 0), ("five", 1, 24), ("six", 1, 10), ("seven", 2, 8), ("eight", 2, 8)):
        assert got[f"{name}:1:+"] == (1, n, [p]) and got[f"{name}:1:-"] == (1, n, [24 - p])


@pytest.mark.parametrize("k, tau", [(1, 1), (25, 0), (25, 4), (3, 3), (2, 2), (255, 1)])
def test_annotation_parameters(k, tau):
    with pytest.raises(ValueError):
        neighbors.check_parameters(k, tau)


def brute_annotation(kmers, tau):
    out = {}
    for a in kmers:
        if a.count("N") > tau:
            continue
        best, count, places = tau + 1, 0, set()
        for b in kmers:
            if a == b or b.count("N") > tau:
                continue
            mism = {i for i, (x, y) in enumerate(zip(a, b)) if x != y or x == "N"}
            if len(mism) > min(best, tau):
                continue
            if len(mism) < best:
                best, count, places = len(mism), 0, set()
            count += 1
            places |= mism
        out[a] = (best, count, sorted(places) if len(places) <= max(3, tau) else []) if count else (0, 0, [])
    return out


@pytest.mark.parametrize("k, tau, seed", [(9, 1, 1), (10, 2, 2), (12, 3, 3), (33, 2, 4)])
def test_annotation_against_brute_force(spark, k, tau, seed):
    import random

    rnd = random.Random(seed)
    body = "".join(rnd.choice("ACGT" * 12 + "N") for _ in range(260))
    body = body + body[40:90] + "ACGTACGTACGTTACGTACGTACGT" + body[100:140].replace("A", "T", 1)
    seqs = text.with_coordinates(sequences(spark, {"x": body, "y": "A" * 40 + "GAATTC" * 5})).cache()
    both = [s for r in seqs.collect() for s in (r.seq, r.seq[::-1].translate(str.maketrans("ACGT", "TGCA")))]
    kmers = {s[i : i + k] for s in both for i in range(len(s) - k + 1)}
    got = {r.kmer: (r.dist, r.neigh_cnt, r.align_pos) for r in neighbors.annotate(seqs, k, tau).collect()}
    assert got == brute_annotation(kmers, tau)
    binned = {r.kmer: r.neigh_cnt for r in neighbors.annotation_binned(spark.createDataFrame([("A", 1, n) for n in (1, 10, 11, 21, 51, 101, 501)], "kmer string, dist int, neigh_cnt bigint")).collect()}
    assert binned["A"] in (1, 10, 15, 40, 75, 300, 1000)


def test_hamming_plan_has_no_cartesian_product(spark, repeats):
    plan = neighbors.hamming_pairs(repeats, 25, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_spread_kmers_are_the_same(spark, repeats):
    from helixframe.operators import kmers as km

    long = repeats.withColumn("seq", F.repeat("seq", 100))
    rows = lambda spread: sorted(km.kmers(long, 40, spread=spread).collect())
    assert rows(True) == rows(False) and km.longest(repeats) == 26
    text_of = {r.seq_id: r.seq for r in long.collect()}
    assert all(text_of[r.seq_id][r.off : r.off + 40] == r.kmer for r in rows(True)) and len(rows(True)) == 8 * (2500 - 39)


def test_annotation_does_not_depend_on_partitions(spark, repeats):
    one = neighbors.annotate(repeats.repartition(1), 12, 2).collect()
    many = neighbors.annotate(repeats.repartition(7), 12, 2).collect()
    key = lambda r: r.kmer
    assert sorted(one, key=key) == sorted(many, key=key)


def test_annotation_of_the_reverse_strand_is_a_mirror(spark, repeats):
    ann = {r.kmer: r for r in neighbors.annotate(repeats, 12, 2).collect()}
    for kmer, r in ann.items():
        other = ann[kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))]
        assert (r.dist, r.neigh_cnt, sorted(11 - p for p in r.align_pos)) == (other.dist, other.neigh_cnt, other.align_pos)


def test_pairs_do_not_depend_on_the_fragments_joined_on(spark):
    import random

    rnd = random.Random(9)
    rows = {"".join(rnd.choice("ACGTN" if rnd.random() < 0.1 else "AC") for _ in range(11)) for _ in range(150)}
    df = spark.createDataFrame([(x,) for x in rows], "kmer string")
    for tau in (1, 2, 3):
        want = sorted((a, b, d) for a in rows for b in rows if a < b and (d := sum(x != y or x == "N" for x, y in zip(a, b))) <= tau)
        for shared in (1, 2, 3):
            got = neighbors.hamming_join(df, df, 11, tau, below=True, shared=shared).select("a", "b", "dist").collect()
            assert sorted(map(tuple, got)) == want and len(want) > 20
    assert neighbors.shared_fragments(25, 1, 10**6) == 1 and neighbors.shared_fragments(14, 3, 10_000) == 2 and neighbors.shared_fragments(25, 1, 10**10) == 2
    assert neighbors.shared_fragments(3, 2, 10**6) == 1 and neighbors.shared_fragments(10, 3, 10**9) == 3
