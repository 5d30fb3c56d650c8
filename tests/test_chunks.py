"""Chunks of records against a plain loop over them."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import readers
from helixframe.streaming.reads import chunked


def plain(sizes, budget):
    out, chunk, held = [], 0, 0
    for size in sizes:
        if held >= budget:
            chunk, held = chunk + 1, 0
        held += size
        out.append(chunk)
    return out


@pytest.mark.parametrize("budget, most, n", [(1, 3, 60), (40, 12, 300), (7, 40, 200), (10**6, 5, 50)])
def test_chunks_of_several_inputs(spark, budget, most, n):
    rnd = random.Random(budget)
    inputs = {"a": n, "b": 1, None: n // 2, "d": n // 3}
    rows, want = [], {}
    for file, many in inputs.items():
        lengths = [rnd.choice([0, 0, rnd.randrange(most)]) for _ in range(many)]
        ords = sorted(rnd.sample(range(3 * many), many))  # with gaps
        rows += [(file, o, "ACGT"[:1] * size) for o, size in zip(ords, lengths)]
        want |= {(file, o): c for o, c in zip(ords, plain(lengths, budget))}
    rnd.shuffle(rows)
    got = chunked(spark.createDataFrame(rows, "file string, ord bigint, seq string").repartition(5), readers.RAW, budget)
    assert got.columns == ["file", "ord", "seq", "chunk"]
    assert {(r.file, r.ord): r.chunk for r in got.collect()} == want and got.count() == len(rows)


def test_one_input_and_none(spark):
    rows = [(i, "A" * (i % 4)) for i in range(101)]
    got = chunked(spark.createDataFrame(rows, "ord bigint, seq string"), readers.RAW, 5)
    assert [r.chunk for r in got.orderBy("ord").collect()] == plain([len(s) for _, s in rows], 5)
    assert chunked(spark.createDataFrame([], "ord bigint, seq string"), readers.RAW, 5).count() == 0
    assert chunked(spark.createDataFrame([], "file string, ord bigint, seq string"), readers.RAW, 5).count() == 0
    with pytest.raises(ValueError):
        chunked(spark.createDataFrame(rows, "ord bigint, seq string"), readers.RAW, 0)


def test_chunks_of_a_stream_are_written_and_counted(spark, tmp_path):
    from helixframe.operators import mapping, text
    from helixframe.streaming.reads import report_chunks, stream_reads

    rnd = random.Random(7)
    seq = "".join(rnd.choice("ACGT") for _ in range(400))
    files = [[seq[i : i + 30] for i in range(0, 90, 30)], [seq[100:130]], [seq[200:240], "T" * 30]]
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(files):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
    seqs = text.with_coordinates(spark.createDataFrame([(0, "s", seq)], "seq_id bigint, name string, seq string")).cache()
    for name, mapped in (("plain", None), ("placed", lambda reads: mapping.map_reads(reads, seqs, 10, 1, read_id="seq"))):
        query = report_chunks(stream_reads(spark, str(tmp_path / "in"), readers.RAW, 1), str(tmp_path / name), str(tmp_path / f"{name}-state"), mapped)
        query.awaitTermination()
        assert query.exception() is None
        counts = {r.chunk: r.n for r in spark.read.parquet(str(tmp_path / name / "counts")).collect()}
        assert sorted(counts.values()) == sorted(map(len, files))  # a file is over a budget of one byte
    by = {}
    for c in counts:
        by[c] = [r.value for r in spark.read.text(str(tmp_path / "plain" / "seq" / f"chunk={c}")).collect()]
    assert sorted(by.values()) == sorted(files) and all(len(by[c]) == n for c, n in counts.items())
    places = {r.read: (r.offset, r.dist) for r in spark.read.parquet(str(tmp_path / "placed" / "mapped")).collect()}
    assert places == {s: (seq.index(s) + 1, 0) for lines in files for s in lines if s in seq}


def test_segments_are_entered_where_chunks_begin(spark):
    """Inputs and chunks that end in a segment, fill many, or lie within one."""
    from helixframe.streaming import reads as of

    rnd = random.Random(11)
    inputs = {"a": 150, "b": 3, None: 70, "d": 90}
    for budget, segment in ((1, 64), (12, 16), (200, 8)):
        rows, want = [], {}
        for file, many in inputs.items():
            lengths = [rnd.choice([0, rnd.randrange(9)]) for _ in range(many)]
            rows += [(file, o, size) for o, size in enumerate(lengths)]
            want |= {(file, o): c for o, c in enumerate(plain(lengths, budget))}
        rnd.shuffle(rows)
        got = of._chunk_numbers(spark.createDataFrame(rows, "file string, ord bigint, size bigint"), ["file"], budget, segment)
        assert {(r.file, r.ord): r.chunk for r in got.collect()} == want


def test_many_chunks_take_no_more_rounds(spark, monkeypatch):
    """Rounds double segments, of which there is one here, and not chunks."""
    from helixframe.streaming import reads as of

    written, save = [], of.saved
    monkeypatch.setattr(of, "saved", lambda df: (written.append(1), save(df))[1])
    rows = spark.range(3000).select(F.col("id").alias("ord"), F.repeat(F.lit("A"), (F.col("id") % 4).cast("int")).alias("seq"))
    got = [r.chunk for r in chunked(rows, readers.RAW, 2).orderBy("ord").collect()]
    assert got == plain([i % 4 for i in range(3000)], 2) and len(written) <= 10


def test_known_characters_are_taken_in_runs(spark):
    """What only_known leaves, and has_known says whether it leaves anything; a filter on it doesn't make the text."""
    from helixframe.functions.alphabet import DNA, Alphabet
    from helixframe.plans import catalog_files

    odd = Alphabet(("]x", "^\\", "-&", "[Y", "."), (), 4, ".")
    texts = [None, "", "xyz", "acgtnACGTN", "the \U0001f9ec cat\n\x00g", "a-]^[.\\&&xY", "\u00e9\u20ac", "nN..n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for alphabet in (DNA, odd):
        known = {c: g[0] for g in alphabet.groups if g[0] != alphabet.unknown for c in g}
        got = rows.select("text", alphabet.only_known("text"), alphabet.has_known("text")).collect()
        want = [None if t is None else "".join(known.get(c, "") for c in t) for t in texts]
        assert [r[1] for r in got] == want
        assert [r[2] for r in got] == [None if w is None else w != "" for w in want]
    plan = catalog_files._reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)


def test_a_segment_passed_over_whole_and_odd_columns(spark):
    """Chunks of many segments, of inputs told apart by two columns with names of the operator's own, keep their numbers."""
    rnd = random.Random(13)
    sizes = {("x", 1): [1] * 40, ("x", 2): [0] * 9, ("y", 1): [rnd.randrange(3) for _ in range(33)]}
    rows = [(p, n, o, "A" * s) for (p, n), of in sizes.items() for o, s in enumerate(of)]
    got = chunked(spark.createDataFrame(rows, "part string, n int, ord bigint, seq string"), readers.RAW, 17, ["part", "n"])
    want = {(*k, o): c for k, of in sizes.items() for o, c in enumerate(plain(of, 17))}
    assert {(r.part, r.n, r.ord): r.chunk for r in got.collect()} == want
