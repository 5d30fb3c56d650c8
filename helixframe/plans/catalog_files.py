"""Queries over files and index bundles: each writes what it reads from the provided tables into the shared folder first."""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.shared import checkpoint_dir, row_numbers, saved, spread, stored
from ..operators import suffix, text
from ..sources import fasta_pieces as fp
from ..sources import readers
from ..streaming.reads import chunk_counts, chunked
from . import cli
from .catalog import _LETTERS, _SEQS, _TEXT, _annotation_sql, _csv, _placed, _query, _sequences, _table
from .index import Index, index_base

#: Symbols on a line of a FASTA file.
LINE = 60


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(rows: DataFrame, key: str, value: Column | str, path: str) -> str:
    """value, made of rows, as lines of text, in the order of key over all files of the folder.

    A sort by ranges takes its sample of whole rows, so they are stored first: what they are made of is taken once, and value after the sort.
    """
    value = F.col(value) if isinstance(value, str) else value
    stored(rows).repartitionByRange(key).sortWithinPartitions(key).select(value.alias("value")).write.text(path)
    return path


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    """The benchmark's letters as a FASTA file with a description behind each name and lines of LINE symbols."""
    body = F.regexp_replace("seq", f"(.{{{LINE}}})(?=.)", "$1\n")
    return _written(_sequences(spark, sf_dir), "seq_id", F.concat(F.lit(">"), "name", F.lit(" of the benchmark\n"), body), _folder(spark))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tag, seq: the documents that have letters, as reads."""
    rows = spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).filter(DNA.has_known("text"))
    seq = DNA.only_known("text")
    return rows.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("-"))).alias("tag"), seq.alias("seq"))


_READS = f"""reads AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, 'doc' || doc_id || ' ' || coalesce(lang, '-') AS tag, seq, translate(seq, 'ACGT', '@+>#') AS qual
  FROM (SELECT doc_id, lang, {_LETTERS} AS seq FROM documents) WHERE seq <> '')"""


def _digest(reads: DataFrame) -> DataFrame:
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return reads.select("ord", "tag", F.length("seq").alias("seq_len"), md5("seq").alias("seq_md5"), md5("qscore").alias("qual_md5"))


def _digest_sql(tag: str, qual: str) -> str:
    return f"WITH {_READS} SELECT ord, {tag} AS tag, CAST(length(seq) AS INTEGER) AS seq_len, md5(seq) AS seq_md5, {qual} AS qual_md5 FROM reads"


@_query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS seq_id, 'item' || item_id AS name, CAST(length(seq) AS INTEGER) AS seq_len, md5(seq) AS seq_md5 FROM (SELECT item_id, " + _LETTERS + " AS seq FROM benchmark)")
def fasta_read(spark, sf_dir):
    seqs = readers.read_fasta(spark, _fasta(spark, sf_dir))
    return seqs.select("seq_id", "name", F.length("seq").alias("seq_len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


#: Symbols of a piece, fewer than a line's, so that pieces and lines cross.
PIECE = 37


@_query(f"""WITH {_SEQS}, numbered AS (SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, name, seq FROM seqs),
cut AS (SELECT seq_id, unnest(range(0, length(seq), {PIECE})) AS place FROM numbered)
SELECT seq_id, name, place AS at_place, substr(seq, CAST(place AS INTEGER) + 1, {PIECE}) AS part FROM numbered LEFT JOIN cut USING (seq_id)""")
def fasta_pieces(spark, sf_dir):
    """The benchmark's FASTA file as pieces; a sequence of no symbols has one row without a piece."""
    names, pieces = fp.read_fasta_pieces(spark, _fasta(spark, sf_dir), size=PIECE)
    return names.join(pieces, "seq_id", "left").select("seq_id", "name", F.col("at").alias("at_place"), "part")


@_query(f"WITH {_TEXT} SELECT rank, pos FROM sa")
def suffix_array_of_pieces(spark, sf_dir):
    """The suffix array of a FASTA file of which no sequence was ever one value."""
    names, pieces = fp.read_fasta_pieces(spark, _fasta(spark, sf_dir))
    return suffix.suffix_array(saved(suffix.text_positions(fp.text_of_pieces(names, pieces))))


@_query(_digest_sql("tag", "CAST(NULL AS VARCHAR)"))
def query_fasta_read(spark, sf_dir):
    path = _written(_reads(spark, sf_dir), "doc_id", F.concat(F.lit(">"), "tag", F.lit("\n"), "seq"), _folder(spark))
    return _digest(readers.read_query_fasta(spark, path))


def _fastq(spark: SparkSession, sf_dir: str) -> str:
    qual = F.translate("seq", "ACGT", "@+>#")
    return _written(_reads(spark, sf_dir), "doc_id", F.concat(F.lit("@"), "tag", F.lit("\n"), "seq", F.lit("\n+\n"), qual), _folder(spark))


@_query(_digest_sql("tag", "md5(qual)"))
def fastq_read(spark, sf_dir):
    return _digest(readers.read_fastq(spark, _fastq(spark, sf_dir)))


@_query(_digest_sql("CAST(ord + 1 AS VARCHAR)", "CAST(NULL AS VARCHAR)"))
def raw_read(spark, sf_dir):
    return _digest(readers.read_raw(spark, _written(_reads(spark, sf_dir), "doc_id", "seq", _folder(spark))))


@_query("SELECT * FROM (VALUES ('fasta', 'fasta'), ('fastq', 'fastq'), ('lines', 'raw'), ('nothing', 'raw')) t(file, format)")
def sniff_formats(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    paths = {"fasta": _fasta(spark, sf_dir), "fastq": _fastq(spark, sf_dir), "lines": _written(reads, "doc_id", "seq", _folder(spark)), "nothing": _written(reads.filter("false"), "doc_id", "seq", _folder(spark))}
    return spark.createDataFrame([(name, readers.sniff(spark, path)) for name, path in paths.items()], "file string, format string")


#: A budget that takes about three records.
CHUNK = 1500


def _chunks_sql(budget: int, then: str) -> str:
    return f"""WITH RECURSIVE {_READS}, sized AS (SELECT ord, strlen(tag) + 2 + 2 * length(seq) AS size FROM reads),
t(ord, held, chunk) AS (SELECT ord, size, CAST(0 AS BIGINT) FROM sized WHERE ord = 0
  UNION ALL SELECT s.ord, CASE WHEN t.held >= {budget} THEN s.size ELSE t.held + s.size END, CASE WHEN t.held >= {budget} THEN t.chunk + 1 ELSE t.chunk END FROM t JOIN sized s ON s.ord = t.ord + 1)
{then}"""


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of the FASTQ file, framed once: chunks take their sizes and then the reads themselves."""
    return stored(readers.read_fastq(spark, _fastq(spark, sf_dir)))


@_query(_chunks_sql(CHUNK, "SELECT ord, chunk FROM t"))
def chunk_reads(spark, sf_dir):
    return chunked(_framed(spark, sf_dir), readers.FASTQ, CHUNK).select("ord", "chunk")


@_query(_chunks_sql(CHUNK, "SELECT chunk, count(*) AS n FROM t GROUP BY chunk"))
def chunk_sizes(spark, sf_dir):
    return chunk_counts(chunked(_framed(spark, sf_dir), readers.FASTQ, CHUNK))


@_query(_chunks_sql(readers.CHUNK_BYTES, "SELECT chunk, count(*) AS n FROM t GROUP BY chunk"))
def chunk_sizes_by_default(spark, sf_dir):
    return chunk_counts(chunked(_framed(spark, sf_dir), readers.FASTQ))


@_query(f"WITH {_READS} SELECT seq FROM reads")
def printed_reads(spark, sf_dir):
    path = _folder(spark)
    readers.write_sequences(readers.read_queries(spark, _fastq(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("seq"))


@_query(
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, seq FROM (SELECT item_id, {_LETTERS} AS seq FROM benchmark) WHERE length(seq) > 1)
SELECT ord, 'r' || ord AS tag, CASE WHEN ord % 4 = 2 THEN 'no @ in record ' || ord WHEN ord % 4 = 1 THEN 'quality and sequence differ in length in record ' || ord END AS problem FROM r
UNION ALL SELECT count(*), 'last', 'incomplete record ' || count(*) FROM r"""
)
def read_problems(spark, sf_dir):
    """A FASTQ file with bad records, read in permissive mode."""
    seqs = _sequences(spark, sf_dir).filter("length(seq) > 1")
    rows = row_numbers(seqs.select("seq_id", "seq"), ["seq_id"], "ord")
    head = F.concat(F.when(F.col("ord") % 4 == 2, "!").otherwise("@"), F.lit("r"), F.col("ord").cast("string"))
    quality = F.when(F.col("ord") % 4 == 1, F.expr("substring(seq, 2)")).otherwise(F.col("seq"))
    good = rows.select("ord", F.concat(head, F.lit("\n"), "seq", F.lit("\n+\n"), quality).alias("value"))
    last = rows.agg(F.count(F.lit(1)).alias("ord"), F.lit("@last\nAC").alias("value"))
    path = _written(good.unionByName(last), "ord", "value", _folder(spark))
    return readers.read_fastq(spark, path, "permissive").select("ord", "tag", F.col("_corrupt").alias("problem"))


_CASES = [("none", ["a", "b"], None), ("empty", ["a", ""], "a sequence has no name"), ("null", ["a", None], "a sequence has no name"), ("twice", ["a", "b", "a"], "repeated name: a")]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if e is None else repr(e)})" for c, _, e in _CASES) + ") t(names, error)")
def name_checks(spark, sf_dir):
    rows = []
    for case, names, _ in _CASES:
        try:
            text.check_names(spark.createDataFrame([(n,) for n in names], "name string"))
            rows.append((case, None))
        except ValueError as e:
            rows.append((case, str(e)))
    return spark.createDataFrame(rows, "names string, error string")


_DEFINITIONS = {
    "plain": (("Aa", "Cc"), (), 0), "one symbol": (("A",), (), 0), "twice": (("Aa", "Ca"), (), 0), "no character": (("A", ""), (), 0), "default": (("A", "C"), (), 2),
    "one way": (("A", "C"), ("AC",), 0), "not canonical": (("Aa", "C"), ("aC",), 0), "short": (("A", "C"), ("A",), 0), "separator": (("A", "$"), (), 0),
}


@_query(
    """SELECT * FROM (VALUES ('plain', true), ('one symbol', false), ('twice', false), ('no character', false), ('default', false), ('one way', true), ('not canonical', false), ('short', false), ('separator', false)) t(definition, good)"""
)
def alphabet_definitions(spark, sf_dir):
    rows = []
    for name, (groups, complements, default) in _DEFINITIONS.items():
        try:
            Alphabet(groups, complements, default)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "definition string, good boolean")


_OWN = "regexp_replace(translate(translate(text, 'VD', 'CC'), 'aeiouAEIOU0123456789', 'VVVVVVVVVVDDDDDDDDDD'), '[^VD]', 'C', 'g')"


@_query(f"SELECT item_id, encoded, translate(encoded, 'VD', 'DV') AS complemented FROM (SELECT item_id, {_OWN} AS encoded FROM benchmark)")
def own_alphabet(spark, sf_dir):
    """Vowels, digits and the rest, which is the default, with complements of its own."""
    a = Alphabet(("VaeiouAEIOU", "C", "D0123456789"), ("VD", "DV"), 1)
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "VD", "CC").alias("text"))
    encoded = a.encode("text")
    return rows.select("item_id", encoded.alias("encoded"), a.complemented(encoded).alias("complemented"))


@_query(f"WITH {_SEQS} SELECT beg + len // 2 AS pos, substr(seq || '$', CAST(len // 2 AS INTEGER) + 1, 1) AS symbol FROM seqs")
def text_symbols(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return text.symbol_at(seqs.select((F.col("beg") + F.expr("len div 2")).alias("pos")), seqs)


# the index bundle


def _built(spark: SparkSession, sf_dir: str, suffixes: bool = True) -> Index:
    """Built from a FASTA file, and opened again by the name of one of its parts."""
    base = _folder(spark)
    Index.build(spark, _fasta(spark, sf_dir), base, suffixes=suffixes)
    return Index.open(spark, f"{base}.sar")


@_query("SELECT * FROM (VALUES (0, 'A', 'Aa', 3), (1, 'C', 'Cc', 2), (2, 'G', 'Gg', 1), (3, 'T', 'Tt', 0), (4, 'N', 'Nn', 4)) t(code, canonical, characters, complement)")
def index_alphabet(spark, sf_dir):
    return _built(spark, sf_dir, suffixes=False).table("alphabet")


@_query(f"WITH {_SEQS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, name, beg, len, md5(seq) AS seq_md5 FROM seqs")
def index_sequences(spark, sf_dir):
    return _built(spark, sf_dir, suffixes=False).table("seqs").select("seq_id", "name", "beg", "len", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@_query(f"WITH {_TEXT} SELECT sa.rank, pos, symbol FROM sa JOIN bwt USING (rank)")
def index_suffixes(spark, sf_dir):
    index = _built(spark, sf_dir)
    return index.table("sa").join(index.table("bwt"), "rank").select("rank", "pos", "symbol")


@_query(
    f"""{_annotation_sql(10, 1)} SELECT 10 AS k, 1 AS tau, kmer, dist, neigh_cnt, positions FROM ann
UNION ALL SELECT k, tau, NULL, NULL, NULL, again FROM (VALUES (10, 1, 'added'), (10, 1, 'there already')) t(k, tau, again)"""
)
def index_annotations(spark, sf_dir):
    """Added, added again, opened anew and read."""
    index = _built(spark, sf_dir, suffixes=False)
    said = ["added" if index.add(10, 1) else "there already" for _ in range(2)]
    again = Index.open(spark, f"{index.base}.ann.10.1")
    rows = [(k, t, x) for k, t in sorted(again.annotations) for x in said]
    log = spark.createDataFrame(rows, "k int, tau int, positions string")
    found = _csv(again.annotation(10, 1)).select(F.lit(10).alias("k"), F.lit(1).alias("tau"), "kmer", "dist", "neigh_cnt", "positions")
    return found.unionByName(log, allowMissingColumns=True)


@_query(
    f"""WITH {_SEQS} SELECT 'alphabet' AS part, canonical AS item, said AS value FROM (VALUES ('A', 'Aa complement T'), ('C', 'Cc complement G'), ('G', 'Gg complement C'), ('T', 'Tt complement A'), ('N', 'Nn complement N')) t(canonical, said)
UNION ALL SELECT 'parts', part, CASE WHEN part IN ('alphabet', 'seqs') THEN 'present' ELSE 'missing' END FROM (SELECT unnest(['alphabet', 'seqs', 'sa', 'bwt', 'c', 'occ_mark']) AS part)
UNION ALL SELECT 'annotations', 'k=10', 'tau=1'
UNION ALL SELECT 'text', unnest(['seq_count', 'text_length', 'wildcard_count', 'has_rc']), unnest([CAST(count(*) AS VARCHAR), CAST(CAST(2 * sum(len) AS BIGINT) AS VARCHAR), CAST(2 * count(*) AS VARCHAR), '1']) FROM seqs
UNION ALL SELECT 'sequences', name, CAST(len - 1 AS VARCHAR) FROM seqs"""
)
def index_view(spark, sf_dir):
    index = _built(spark, sf_dir, suffixes=False)
    index.add(10, 1)
    return Index.open(spark, index.base).view()


_NAMES = {"a.sym": "a", "a.txt": "a", "a.sar": "a", "a.bwt": "a", "a.ann": "a", "a.ann.25.1": "a", "dir/b.fa": "dir/b.fa", "a.sym.bwt": "a.sym", "a.ann.25": "a.ann.25", "c": "c"}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{b}')" for p, b in _NAMES.items()) + ") t(path, base)")
def index_names(spark, sf_dir):
    return spark.createDataFrame([(p, index_base(p)) for p in _NAMES], "path string, base string")


_BAD_CALLS = {
    "no command": [], "no action": ["index"], "no distance": ["index", "add", "-k", "10", "x"], "distance 0": ["index", "add", "-k", "10", "-d", "0", "x"], "distance of k": ["index", "add", "-k", "2", "-d", "2", "x"],
    "no threads": ["index", "add", "-k", "10", "-d", "1", "-t", "0", "x"], "output twice": ["index", "build", "-o", "a", "-o", "b", "f"],
}


@_query(
    f"""WITH {_SEQS}, n AS (SELECT count(*) AS n FROM seqs), p AS (SELECT string_agg(seq, chr(10) ORDER BY seq_id) || chr(10) AS p FROM seqs WHERE seq <> '')
SELECT * FROM (VALUES ('build', 0, CAST(0 AS BIGINT), md5('')), ('add', 0, 0, md5('')), ('add again', 1, 0, md5('')), ('no index', 1, 0, md5('')), ('version', 0, 1, md5('helixframe 0.1' || chr(10)))) t(call, code, lines, output_md5)
UNION ALL SELECT unnest([{", ".join(map(repr, _BAD_CALLS))}]), 2, 0, md5('')
UNION ALL SELECT 'map', 0, (SELECT count(*) FROM seqs WHERE seq <> ''), md5(p) FROM p
UNION ALL SELECT 'view', 0, 16 + n, NULL FROM n"""
)
def command_line(spark, sf_dir):
    """What the command line returns and prints; of a listing of all sequences only the lines are counted."""
    base, fasta = _folder(spark), _fasta(spark, sf_dir)
    reads = _written(_sequences(spark, sf_dir).filter("seq <> ''"), "seq_id", "seq", _folder(spark))
    add = ["index", "add", "-k", "10", "-d", "1", base]
    calls = {"build": ["index", "build", "-o", base, fasta], "add": add, "add again": add, "view": ["index", "view", base], "map": ["map", base, reads], "no index": ["index", "view", _folder(spark)], "version": ["--version"]}
    rows = []
    for call, arguments in (calls | _BAD_CALLS).items():
        out = io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
            try:
                code = cli.main(arguments, spark)
            except SystemExit as e:
                code = e.code
        rows.append((call, code, out.getvalue().count("\n"), None if call == "view" else out.getvalue()))
    done = spark.createDataFrame(rows, "call string, code int, lines bigint, output string")
    return done.select("call", "code", "lines", F.md5(F.col("output").cast("binary")).alias("output_md5"))


#: At every place of the sequences a pattern of 1 to 30 symbols, and the same with another first symbol, which mostly stands nowhere.
_MIXED = f"""cut AS (SELECT substr(seq, CAST(i AS INTEGER) + 1, CAST(1 + i * 7 % 30 AS INTEGER)) AS p FROM seqs, LATERAL (SELECT unnest(range(0, length(seq))) AS i)),
x AS (SELECT DISTINCT pattern, translate({{rc}}, 'N', 'Z') AS r FROM (SELECT p AS pattern FROM cut UNION SELECT translate(substr(p, 1, 1), 'ACGT', 'GTAC') || substr(p, 2) FROM cut))""".format(rc="reverse(translate(pattern, 'ACGT', 'TGCA'))")


def _mixed(seqs: DataFrame) -> DataFrame:
    off = seqs.filter("seq <> ''").select("seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i"))
    cut = off.select(F.substring("seq", F.col("i") + 1, 1 + F.col("i") * 7 % 30).alias("p"))
    other = F.concat(F.translate(F.substring("p", 1, 1), "ACGT", "GTAC"), F.expr("substring(p, 2)"))
    return cut.select(F.explode(F.array("p", other)).alias("pattern")).distinct()


def _opened(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the benchmark, built from a file, and opened again by its name."""
    base = f"{_folder(spark)}/searched"
    Index.build(spark, _fasta(spark, sf_dir), base, rate=8)
    return Index.open(spark, f"{base}.bwt")


@_query(
    f"""WITH {_TEXT}, {_MIXED}, suffixes AS (SELECT substr(t, pos + 1) AS suffix FROM sa)
SELECT pattern, count(*) FILTER (suffix < pattern) AS fp, count(*) FILTER (suffix < r) AS rp, count(*) FILTER (starts_with(suffix, pattern)) AS sz, CAST(length(pattern) AS INTEGER) AS dp FROM x, suffixes GROUP BY pattern"""
)
def index_interval(spark, sf_dir):
    index = _opened(spark, sf_dir)
    return index.intervals(_mixed(index.table("seqs")))


@_query(
    f"""WITH {_TEXT}, {_MIXED}, found AS (SELECT pattern, pos, pos >= h AS rev, CASE WHEN pos >= h THEN 2 * h - 2 - pos ELSE pos END AS place FROM x JOIN sa ON starts_with(substr(t, pos + 1), pattern), half)
SELECT pattern, pos, name || ':' || (place - beg + 1) || ':' || CASE WHEN rev THEN '-' ELSE '+' END AS label FROM found JOIN seqs ON place >= beg AND place < beg + len"""
)
def index_locate(spark, sf_dir):
    index = _opened(spark, sf_dir)
    return index.locate(_mixed(index.table("seqs")))
