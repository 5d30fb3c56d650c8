"""FASTA in pieces: the same sequences, text and k-mers as from whole records, with files split in the middle of records."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import suffix, text
from helixframe.operators.kmers import kmers
from helixframe.sources import fasta_pieces as fp
from helixframe.sources import readers

RND = random.Random(37)


def letters(n):
    return "".join(RND.choice("ACGTacgtN") for _ in range(n))


@pytest.fixture()
def fasta(tmp_path):
    """Two files: lines of several widths, one long line, an empty sequence, carriage returns, empty lines, no line end at the end."""
    big = letters(20_000)
    one = ">a first\r\n" + "\n".join(big[i : i + 61] for i in range(0, len(big), 61)) + "\n>b\n" + letters(9_000) + "\n\n>empty\n>c x y\n" + letters(64) + "\r\n" + letters(3)
    two = ">d\nA\n>e\n" + letters(128)
    (tmp_path / "1.fa").write_bytes(one.encode())
    (tmp_path / "2.fa").write_bytes(two.encode())
    return str(tmp_path)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_pieces_are_the_whole_records(spark, fasta, small_splits, size):
    whole = {r.seq_id: (r.name, r.seq) for r in readers.read_fasta(spark, fasta).collect()}
    assert spark.read.text(fasta).rdd.getNumPartitions() > 10  # one file over many tasks
    names, pieces = fp.read_fasta_pieces(spark, fasta, size=size)
    got = {r.seq_id: [] for r in names.collect()}
    for r in sorted(pieces.collect()):
        assert r.at == size * len(got[r.seq_id]) and 0 < len(r.part) <= size
        got[r.seq_id].append(r.part)
    assert {(r.seq_id, r.name): "".join(got[r.seq_id]) for r in names.collect()} == {(i, n): s for i, (n, s) in whole.items()}
    assert all(len(p) == size for parts in got.values() for p in parts[:-1])
    assert {r.seq_id: (r.length, r.before) for r in names.collect()} == {i: (len(s), sum(len(whole[j][1]) for j in range(i))) for i, (_, s) in whole.items()}


@pytest.mark.parametrize("two_strands", [True, False])
def test_text_and_kmers(spark, fasta, small_splits, two_strands):
    seqs = text.with_coordinates(readers.read_fasta(spark, fasta)).cache()
    names, pieces = fp.read_fasta_pieces(spark, fasta, size=100)
    told = lambda rows: sorted((r.pos, r.symbol, r.ahead) for r in suffix.text_positions(rows).collect())
    assert told(fp.text_of_pieces(names, pieces, two_strands=two_strands)) == told(suffix.text_rows(seqs, two_strands=two_strands))
    if two_strands:
        raw = readers.read_fasta(spark, fasta)
        for k in (1, 9, 100):
            assert sorted(map(tuple, fp.kmers_of_pieces(pieces, k, 100).collect())) == sorted(map(tuple, kmers(raw, k).collect()))


@pytest.mark.parametrize("body, what", [(">a\nAC\n>a\nGT\n", "repeated name"), ("> \nAC\n", "no name"), ("AC\n>b\nGT\n", "begin with >")])
def test_wrong_files(spark, tmp_path, body, what):
    path = tmp_path / "bad.fa"
    path.write_text(body)
    with pytest.raises(ValueError, match=what):
        fp.read_fasta_pieces(spark, str(path))
    if what != "begin with >":
        names, _ = fp.read_fasta_pieces(spark, str(path), "permissive")
        assert names.filter(F.col("_corrupt").contains(what)).count() == names.count()


def test_an_empty_file(spark, tmp_path):
    path = tmp_path / "none.fa"
    path.write_text("")
    names, pieces = fp.read_fasta_pieces(spark, str(path))
    assert names.count() == 0 and pieces.count() == 0 and fp.text_of_pieces(names, pieces).count() == 0
