"""Lines are numbered where they are read, and what is written in order is made once."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import shared
from helixframe.functions.alphabet import DNA
from helixframe.plans import catalog_files
from helixframe.sources import readers


@pytest.fixture()
def folder(tmp_path):
    """Files of sizes that fall and rise, so that tasks don't meet them in the order of their names; one empty, one without a last line end."""
    texts = {}
    for i, many in enumerate((9, 40, 0, 1, 25, 2)):
        texts[f"{i}.txt"] = "".join(f"@f{i}r{k}\n{'ACGT'[k % 4] * (1 + k)}\r\n+\n{'!' * (1 + k)}\n" for k in range(many))
    texts["5.txt"] = texts["5.txt"].rstrip("\n")
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    lines = [line for name in sorted(texts) for line in texts[name].replace("\r", "").split("\n") if line]
    return str(tmp_path / "in"), lines


@pytest.fixture(params=["150", "700", "100000"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_where_they_are_read(spark, folder, splits, monkeypatch):
    path, lines = folder
    saves, save = [], shared.saved
    monkeypatch.setattr(shared, "saved", lambda df: (saves.append(1), save(df))[1])
    raw = readers.read_raw(spark, path)
    assert [(r.ord, r.seq) for r in raw.orderBy("ord").collect()] == list(enumerate(lines))
    reads = readers.read_fastq(spark, path).orderBy("ord").collect()
    assert [(r.ord, "@" + r.tag, r.seq, r.qscore) for r in reads] == [(i // 4, lines[i], lines[i + 1], lines[i + 3]) for i in range(0, len(lines), 4)]
    assert not saves  # no sort of whole lines, and no copy of them


def test_records_left_out_have_no_number(spark, tmp_path, splits):
    bodies = {"a": ">one\nAC\nGT\n>\n>\n>two\nTT\n", "b": "\n", "c": ">\n>three\r\n" + "A" * 400 + "\n>\n>four\nC\n>", "d": ">five\nG"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    rows = readers.read_query_fasta(spark, str(tmp_path), "permissive").orderBy("ord").collect()
    got = [(r.ord, r.tag.strip(), len(r.seq)) for r in rows if r.seq]
    assert [t for _, t, _ in got] == ["one", "two", "three", "four", "five"] and [n for *_, n in got] == [4, 2, 400, 1, 1]
    assert [r.ord for r in rows] == list(range(len(rows)))


def test_what_is_written_in_order_is_made_once(spark, tmp_path):
    """A sort by ranges samples its rows; what they are made of isn't taken again for that."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(i):
        made.add(1)
        return f"text {i}"

    rows = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("key")).select("key", text_of("key").alias("text"))
    path = catalog_files._written(rows, "key", F.concat("text", F.lit("!")), str(tmp_path / "out"))
    assert made.value == 500
    lines = readers.read_raw(spark, path).orderBy("ord").collect()
    assert [r.seq for r in lines] == [f"text {i}!" for i in range(500)]


def test_variants_become_capitals(spark):
    texts = ["acgtnACGTN", "ıſßaK", "", None, "xyz", "t\n\x00\U0001f9ecG"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", DNA.only_known("text").alias("s"))
    assert {r.text: r.s for r in rows.collect()} == {t: None if t is None else "".join(c.upper() for c in t if c in "ACGTacgt") for t in texts}
    assert "translate" not in rows._jdf.queryExecution().optimizedPlan().toString()
