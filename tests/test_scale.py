"""Long repeats, long sequences and places that reach over pieces, against plain Python."""

import random

import pytest

from helixframe.functions import shared
from helixframe.operators import kmers as km
from helixframe.operators import mapping, suffix, text

RND = random.Random(17)
LONG = "".join(RND.choice("ACGT") for _ in range(3000))
OTHER = "".join(RND.choice("ACGTN") for _ in range(1700))


@pytest.fixture(scope="module")
def seqs(spark):
    return text.with_coordinates(spark.createDataFrame([(0, "long", LONG), (1, "other", OTHER)], "seq_id bigint, name string, seq string")).cache()


def test_suffixes_of_long_repeats(spark):
    rows = [(0, "a", "A" * 900), (1, "n", "N" * 300 + "ACGT"), (2, "b", "AC" * 200)]
    body = "".join(s + "$" for _, _, s in rows)
    body += body[:-1][::-1].translate(str.maketrans("ACGT", "TGCA")) + "$"
    key = body.translate(str.maketrans("$ACGTN", "012345"))
    _, sa = suffix.sa_of_text(spark.createDataFrame(rows, "seq_id bigint, name string, seq string"))
    assert [r.pos for r in sa.orderBy("rank").collect()] == sorted(range(len(body)), key=lambda p: key[p:])


@pytest.mark.parametrize("length", [1, 12, 512, 1300])
def test_slices_reach_over_pieces(spark, seqs, length):
    whole = LONG + "$" + OTHER + "$"
    at = [0, 511, 512, 1024, 2990, 3000, 3001, 3500, len(whole) - 1]
    done = text.text_slice(spark.createDataFrame([(p,) for p in [*at, at[2]]], "pos bigint"), seqs, "pos", length)
    want = [(p, (LONG + "$")[p : p + length] if p <= 3000 else (OTHER + "$")[p - 3001 :][:length]) for p in [*at, at[2]]]
    assert sorted((r.pos, r.slice) for r in done.collect()) == sorted(want)


def test_reads_reach_over_pieces(spark, seqs):
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    changed = lambda s, k: s[:k] + {"A": "C", "C": "G", "G": "T", "T": "A", "N": "A"}[s[k]] + s[k + 1 :]
    reads = [(0, LONG[480:560]), (1, turned(LONG[1000:1100])), (2, changed(LONG[500:1700], 600)), (3, turned(changed(LONG[2400:2500], 3)))]
    found = mapping.map_reads(spark.createDataFrame(reads, "ord bigint, seq string"), seqs, 11, 1)
    assert {r.read: (r.name, r.offset, r.strand, r.dist) for r in found.collect()} == {0: ("long", 481, "+", 0), 1: ("long", 1001, "-", 0), 2: ("long", 501, "+", 1), 3: ("long", 2401, "-", 1)}


def test_long_sequences_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(km, "LONG", 1000)
    placed = text.with_coordinates(spark.createDataFrame([(0, "long", LONG)], "seq_id bigint, name string, seq string")).coalesce(1)
    found = km.kmers(placed, 9)
    assert "Repartition" in found._jdf.queryExecution().logical().toString()
    assert sorted((r.off, r.kmer) for r in found.collect()) == [(i, LONG[i : i + 9]) for i in range(len(LONG) - 8)]


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.checkpoint_dir(Session())
