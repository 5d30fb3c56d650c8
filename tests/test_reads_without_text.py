"""Documents without text are rows of read_parse like any other; rows made elsewhere are still checked where that is asked for."""

import hashlib

import pytest

from helixframe.plans import catalog
from helixframe.sources import readers
from tests.oracle import compare, connect

TEXTS = [(0, "acgt"), (1, ""), (2, None), (3, "\n"), (4, "é\U0001f9ec\x00x"), (None, "no key"), (None, None)]


def test_documents_without_text_are_rows(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query, sql = catalog.queries()["read_parse"], catalog.oracle_sql()["read_parse"]
    assert compare(spark, connect(str(tmp_path)), query, sql, str(tmp_path)) == ""
    rows = {r.ord: (r.tag, r.seq_len, r.seq_md5) for r in query(spark, str(tmp_path)).filter("ord < 3").collect()}
    assert rows == {0: ("1", 4, hashlib.md5(b"acgt").hexdigest()), 1: ("2", 0, hashlib.md5(b"").hexdigest()), 2: ("3", None, None)}


@pytest.mark.parametrize("seq", ["", None])
def test_reads_without_a_sequence_are_told(spark, seq):
    rows = spark.createDataFrame([(7, "t", "AC", None), (8, "u", seq, None)], readers.READ)
    with pytest.raises(Exception, match="no sequence in record 8"):
        readers.new_reads(rows).collect()
    kept = readers.new_reads(rows, "permissive").orderBy("ord").collect()
    assert [(r.ord, r.seq, r._corrupt) for r in kept] == [(7, "AC", None), (8, seq, "no sequence in record 8")]
