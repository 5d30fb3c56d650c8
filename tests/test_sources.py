"""Readers, the index bundle, the command line, streams and mapping."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import mapping, text
from helixframe.plans.cli import main
from helixframe.plans.index import Index, index_base
from helixframe.sources import readers
from helixframe.streaming.reads import chunked, process_stream, stream_reads

SEQS = ["ATGCGTACGTCGTATCA", "GTATCGACTACGAGCTA", "AGTCGANTATACNTACG", "ACGTACATGTATGACAC", "NNNNNNNNACGTACGCC", "NNNNNNLLYYYYJDFLS"]
QUALS = ["12391284194819241", "BACBABCA0ACBB00AC", "@2391284194819241", "12391284194819241", "+2391284194819241", "12391284194819241"]
REPEATS = ">  one first of them\nATCGATATCAGCCAC\r\nTACGAGACAA\n>two\nATCGATATCAGgCACTACGAGACAA\n>three\nATCGATATCAGCCACTACGAtACAA"


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_bytes(body.encode())
    return str(path)


@pytest.fixture()
def fasta(tmp_path):
    return put(tmp_path, "repeats.fa", REPEATS)


def test_reference_fasta(spark, fasta):
    rows = readers.read_fasta(spark, fasta).orderBy("seq_id").collect()
    assert [(r.seq_id, r.name, r.seq) for r in rows] == [(0, "one", "ATCGATATCAGCCACTACGAGACAA"), (1, "two", "ATCGATATCAGgCACTACGAGACAA"), (2, "three", "ATCGATATCAGCCACTACGAtACAA")]


@pytest.mark.parametrize("body, what", [(">a\nAC\n>a\nGT\n", "repeated name"), ("> \nAC\n", "no name"), ("AC\n>b\nGT\n", "begin with >")])
def test_reference_fasta_errors(spark, tmp_path, body, what):
    path = put(tmp_path, "bad.fa", body)
    with pytest.raises(Exception, match=what):
        readers.read_fasta(spark, path).collect()
    assert any(what in (r._corrupt or "") for r in readers.read_fasta(spark, path, "permissive").collect())


def test_header_on_the_last_line(spark, tmp_path):
    path = put(tmp_path, "x.fa", ">a\nAC\n>last")
    assert [(r.name, r.seq) for r in readers.read_fasta(spark, path).orderBy("seq_id").collect()] == [("a", "AC"), ("last", "")]


def test_queries_in_three_formats(spark, tmp_path):
    fq = put(tmp_path, "q.fastq", "".join(f"@seq{i + 1}\n{s}\n+\n{q}\n" for i, (s, q) in enumerate(zip(SEQS, QUALS))).rstrip("\n"))
    fa = put(tmp_path, "q.fasta", "\n".join(f">seq{i + 1}\n{s}" for i, s in enumerate(SEQS)))
    raw = put(tmp_path, "q.raw", "\n".join(SEQS))
    tags = [f"seq{i}" for i in range(1, 7)]
    for path, form, names, quals in ((fq, "fastq", tags, QUALS), (fa, "fasta", tags, [None] * 6), (raw, "raw", list("123456"), [None] * 6)):
        assert readers.sniff(spark, path) == form
        rows = readers.read_queries(spark, path).orderBy("ord").collect()
        assert [(r.ord, r.tag, r.seq, r.qscore) for r in rows] == list(zip(range(6), names, SEQS, quals))
    readers.write_sequences(readers.read_queries(spark, raw), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(SEQS)


@pytest.mark.parametrize("body, what", [("@a\nACGT\n+\n12\n", "differ in length"), ("@a\nACGT\n+\n1234\n@b\nAC\n", "incomplete"), ("@a\nAC\n+\n12\nb\nAC\n+\n12\n", "no @")])
def test_broken_fastq_is_reported(spark, tmp_path, body, what):
    path = put(tmp_path, "bad.fastq", body)
    with pytest.raises(Exception, match=what):
        readers.read_fastq(spark, path).collect()
    assert any(what in (r._corrupt or "") for r in readers.read_fastq(spark, path, "permissive").collect())


def test_empty_file(spark, tmp_path):
    path = put(tmp_path, "empty", "")
    assert readers.sniff(spark, path) == "raw" and readers.read_queries(spark, path).count() == 0


def test_index_round_trip_and_command_line(spark, tmp_path, fasta, capsys):
    base = str(tmp_path / "idx")
    assert main(["index", "build", "-o", base, fasta], spark) == 0
    assert main(["index", "add", "-k", "25", "-d", "1", base + ".sar"], spark) == 0
    assert main(["index", "add", "-k", "25", "-d", "1", base], spark) == 1
    index = Index.open(spark, base + ".ann.25.1")
    assert index.annotations == {(25, 1)} and index.alphabet.canonical == "ACGTN"
    n = 2 * 3 * 26
    ranks = [r.rank for r in index.table("sa").orderBy("rank").collect()]
    assert ranks == list(range(n)) and index.table("bwt").count() == n
    # the array is in the order of the text's suffixes
    half = "".join(s.upper() + "$" for s in ("ATCGATATCAGCCACTACGAGACAA", "ATCGATATCAGgCACTACGAGACAA", "ATCGATATCAGCCACTACGAtACAA"))
    body = half + half[:-1][::-1].translate(str.maketrans("ACGT", "TGCA")) + "$"
    assert [r.pos for r in index.table("sa").orderBy("rank").collect()] == sorted(range(n), key=lambda p: body[p:])
    assert index.annotation(25, 1).filter("dist = 1").count() == 6
    with pytest.raises(ValueError):
        index.annotation(25, 2)
    capsys.readouterr()
    assert main(["index", "view", base], spark) == 0
    shown = capsys.readouterr().out
    assert "parts\tocc_mark\tpresent" in shown and "annotations\tk=25\ttau=1" in shown and "text\ttext_length\t156" in shown
    reads = put(tmp_path, "r.raw", "ATCGATATCAGCCACTACGAGACAA\nTTGTCTCGTAGTGG\nGGGGGGGGGGGGGG\n")
    assert main(["map", base, reads], spark) == 0
    assert capsys.readouterr().out.split() == ["ATCGATATCAGCCACTACGAGACAA", "TTGTCTCGTAGTGG", "GGGGGGGGGGGGGG"]
    assert main(["map", base, reads, "-k", "10"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "0\tone\t1\t+\t0" and lines[1].startswith("1\tone\t12\t-\t0") and len(lines) == 2
    assert main(["index", "view", str(tmp_path / "none")], spark) == 1


def test_index_without_suffixes_shows_it(spark, tmp_path, fasta):
    index = Index.build(spark, fasta, str(tmp_path / "i"), suffixes=False)
    shown = {(r.part, r.item): r.value for r in index.view().collect()}
    assert shown["parts", "sa"] == "missing" and shown["parts", "bwt"] == "missing" and shown["parts", "seqs"] == "present"


@pytest.mark.parametrize("bad", [["index", "add", "-k", "5", "-d", "0", "x"], ["index", "add", "-k", "5", "x"], ["index", "build", "-o", "a", "-o", "b", "f"], ["index", "add", "-k", "2", "-d", "3", "x"], ["index"]])
def test_command_line_rejects(bad, spark):
    with pytest.raises(SystemExit):
        main(bad, spark)


@pytest.mark.parametrize("path, base", [("a.sym", "a"), ("a.ann.25.1", "a"), ("x", "x"), ("b.bwt", "b"), ("a.ann", "a")])
def test_index_base(path, base):
    assert index_base(path) == base


@pytest.mark.parametrize("form", ["fasta", "fastq", "raw"])
def test_stream_takes_whole_files_up_to_a_budget(spark, tmp_path, form):
    folder = tmp_path / "in"
    folder.mkdir()
    bodies = {"fasta": ">a\nAC\nGT\n>b\nTT\n", "fastq": "@a\nACGT\n+\n@@@@\n@b\nTT\n+\n12\n", "raw": "ACGT\nTT\n"}
    for i in range(3):
        (folder / f"f{i}").write_text(bodies[form])
    seen = []

    def work(batch, number):
        seen.append(sorted((r.ord, r.tag, r.seq) for r in batch.collect()))

    budget = len(bodies[form]) + 2
    query = process_stream(stream_reads(spark, str(folder), form, budget), work, str(tmp_path / "state"))
    query.awaitTermination(60)
    query.stop()
    one = [(0, "1" if form == "raw" else "a", "ACGT"), (1, "2" if form == "raw" else "b", "TT")]
    assert sum(len(s) for s in seen) == 6 and len(seen) >= 2 and sorted(x for s in seen for x in s) == sorted(one * 3)


def test_mapping_finds_the_best_place(spark):
    seqs = spark.createDataFrame([(0, "x", "ACGTTGCAAGGCTTAACCGGATATCGCGATTACAGG"), (1, "y", "TTTTGGGGCCCCAAAATTTGGGCCCAAATTGGCCAA")], "seq_id bigint, name string, seq string")
    seqs = text.with_coordinates(seqs)
    reads = [(0, "GCTTAACCGGATATCG"), (1, "GCTTAACCGGTTATCG"), (2, "CGATATCCGGTTAAGC"), (3, "GGGGGGGGGGGGGGGG")]
    got = mapping.map_reads(spark.createDataFrame(reads, "ord bigint, seq string"), seqs, 5, 1)
    assert {r.read: (r.name, r.offset, r.strand, r.dist) for r in got.collect()} == {0: ("x", 11, "+", 0), 1: ("x", 11, "+", 1), 2: ("x", 11, "-", 0)}
    shared = mapping.contamination_seeds(seqs.select("seq_id", "seq"), spark.createDataFrame([(9, "TTAACCGG")], "item bigint, seq string"), 4, "seq_id", "item", "seq", "seq")
    assert {(r.doc, r.item): r.n for r in shared.collect()}[0, 9] == 5


def test_numbers_without_a_single_task(spark):
    from helixframe.functions.shared import row_numbers, running_total

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.n for r in row_numbers(rows, ["k"], "n").collect())
    assert {r.k: r.s for r in running_total(rows, ["k"], "k", "s").collect()}[10] == sum(range(10))


@pytest.mark.parametrize("form, budget, sizes", [("raw", readers.CHUNK_BYTES, [6]), ("fasta", 80, [4, 2]), ("fastq", 50, [2, 2, 2])])
def test_chunks_end_at_the_record_that_fills_them(spark, form, budget, sizes):
    rows = [(i, f"seq{i + 1}", s, q if form == "fastq" else None) for i, (s, q) in enumerate(zip(SEQS, QUALS))]
    reads = spark.createDataFrame(rows, "ord bigint, tag string, seq string, qscore string").repartition(3)
    done = chunked(reads, form, budget)
    assert [r["count"] for r in done.groupBy("chunk").count().orderBy("chunk").collect()] == sizes
    assert [r.chunk for r in done.orderBy("ord").collect()] == [k for k, n in enumerate(sizes) for _ in range(n)]
    two = reads.withColumn("file", F.lit("a")).unionByName(reads.withColumn("file", F.lit("b")))
    assert [r["count"] for r in chunked(two, form, budget).groupBy("file", "chunk").count().orderBy("file", "chunk").collect()] == sizes * 2
    assert chunked(reads.limit(0), form, budget).count() == 0
