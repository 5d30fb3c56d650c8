"""The engine's queries over the provided tables, and the SQL that they are held against.

`benchmark` is the reference text, `documents` are the reads.  Where a query needs a text of symbols, it takes the
letters A, C, G and T of each row, in upper case; elsewhere all other characters become N.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA
from ..functions.shared import saved, spread
from ..operators import kmers as km
from ..operators import mapping, neighbors, search, suffix, text
from ..sources.readers import new_reads, raw_reads

K_COUNT, K_PAIRS, K_SEED, K_READ = 8, {1: 10, 2: 12, 3: 14}, 20, 24

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as named sequences."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), DNA.only_known("text").alias("seq"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(text.with_coordinates(_sequences(spark, sf_dir)))


_LETTERS = "translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_SEQS = f"""s AS (SELECT item_id AS seq_id, 'item' || item_id AS name, {_LETTERS} AS seq FROM benchmark),
seqs AS (SELECT *, CAST(length(seq) + 1 AS BIGINT) AS len,
  CAST(coalesce(sum(length(seq) + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg FROM s),
half AS (SELECT CAST(sum(len) AS BIGINT) AS h FROM seqs)"""
_STRANDS = f"{_SEQS},\nstrands AS (SELECT seq_id, name, beg, len, '+' AS strand, seq FROM seqs UNION ALL SELECT seq_id, name, beg, len, '-', {_RC.format('seq')} FROM seqs)"


def _kmers(k: int, of: str = "strands") -> str:
    return f"(SELECT t.*, CAST(i AS BIGINT) AS off, substr(t.seq, i + 1, {k}) AS kmer FROM {of} t, LATERAL (SELECT unnest(range(0, length(t.seq) - {k} + 1)) AS i))"


_TEXT = f"""{_SEQS},
forward AS (SELECT string_agg(seq || '$', '' ORDER BY seq_id) AS f FROM seqs),
body AS (SELECT f || {_RC.format("substr(f, 1, length(f) - 1)")} || '$' AS t FROM forward),
sa AS (SELECT pos, row_number() OVER (ORDER BY suffix) - 1 AS rank, t FROM (SELECT CAST(i AS BIGINT) AS pos, t, substr(translate(t, 'N', 'Z'), i + 1) AS suffix FROM body, LATERAL (SELECT unnest(range(0, length(t))) AS i))),
bwt AS (SELECT rank, substr(t, CASE WHEN pos = 0 THEN length(t) ELSE pos END, 1) AS symbol FROM sa)"""
_SYMBOLS = "symbols AS (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS symbol, unnest([0, 1, 2, 3, 4]) AS code)"


@_query("SELECT item_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS encoded FROM benchmark")
def sym_encode(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", DNA.encode("text").alias("encoded"))


@_query(f"SELECT item_id, array_to_string(list_transform(regexp_extract_all({_LETTERS}, '.'), lambda c: strpos('ACGTN', c) - 1), ',') AS codes FROM benchmark")
def sym_codes(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(DNA.codes(DNA.only_known("text")).cast("array<string>"), ",").alias("codes"))


@_query(
    f"""WITH e AS (SELECT regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM documents), {_SYMBOLS}
SELECT code, symbol, CAST(sum(length(seq) - length(replace(seq, symbol, ''))) AS BIGINT) AS n FROM e, symbols GROUP BY code, symbol"""
)
def sym_counts(spark, sf_dir):
    seq = spread(_table(spark, sf_dir, "documents").select("text")).select(DNA.encode("text").alias("seq"))
    counts = seq.agg(*[F.sum(km.symbol_count(F.col("seq"), c).cast("bigint")).alias(c) for c in DNA.canonical])
    rows = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(c).alias("symbol"), F.col(c).alias("n")) for i, c in enumerate(DNA.canonical)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


@_query("SELECT item_id, CAST(length(regexp_replace(text, '[^ACGTN]', '', 'g')) AS BIGINT) AS n_canonical FROM benchmark")
def is_canonical(spark, sf_dir):
    each = F.filter(F.split("text", ""), lambda c: (c != "") & (DNA.canonical_flag(c) == 1))
    return _table(spark, sf_dir, "benchmark").select("item_id", F.size(each).cast("bigint").alias("n_canonical"))


@_query("WITH symbols AS (SELECT unnest(range(0, 6)) AS code) SELECT CAST(code AS INTEGER) AS code, nullif(substr('ACGTN', CAST(code AS INTEGER) + 1, 1), '') AS symbol, nullif(substr('TGCAN', CAST(code AS INTEGER) + 1, 1), '') AS complement FROM symbols")
def sym_characters(spark, sf_dir):
    symbol = DNA.character_of("code")
    return spark.range(DNA.size + 1).select(F.col("id").cast("int").alias("code")).select("code", symbol.alias("symbol"), DNA.complemented(symbol).alias("complement"))


@_query(
    f"""WITH e AS (SELECT item_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM benchmark),
c AS (SELECT item_id, substr(seq, i + 1, 1) AS symbol FROM e, LATERAL (SELECT unnest(range(0, length(seq))) AS i))
SELECT item_id, CAST(strpos('ACGTN', symbol) - 1 AS INTEGER) AS code, symbol, translate(symbol, 'ACGT', 'TGCA') AS complement, count(*) AS n, 5 AS n_symbols FROM c GROUP BY item_id, symbol"""
)
def sym_characters_of_codes(spark, sf_dir):
    """Of every code in the texts the character and its complement."""
    codes = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(DNA.codes(DNA.encode("text"))).alias("code"))
    symbol = DNA.character_of("code")
    counts = codes.groupBy("item_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("item_id", F.col("code").cast("int").alias("code"), symbol.alias("symbol"), DNA.complemented(symbol).alias("complement"), "n", F.lit(DNA.size).alias("n_symbols"))


@_query(f"SELECT item_id, {_RC.format(_LETTERS)} AS rc FROM benchmark")
def reverse_complement(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", DNA.reverse_complement(DNA.only_known("text")).alias("rc"))


@_query(f"WITH {_STRANDS} SELECT seq_id, strand, seq FROM strands")
def two_strand_text(spark, sf_dir):
    return text.both_strands(_sequences(spark, sf_dir)).select("seq_id", "strand", "seq")


@_query(f"WITH {_SEQS} SELECT seq_id, beg, len FROM seqs")
def seq_coords(spark, sf_dir):
    return text.with_coordinates(_sequences(spark, sf_dir)).select("seq_id", "beg", "len")


@_query(f"WITH {_SEQS} SELECT count(*) AS seq_count, CAST(2 * sum(len) AS BIGINT) AS text_length, 2 * count(*) AS wildcard_count, 1 AS has_rc FROM seqs")
def text_stats(spark, sf_dir):
    return text.text_statistics(text.with_coordinates(_sequences(spark, sf_dir)))


_POINTS = "points AS (SELECT beg + len // 2 AS pos FROM seqs UNION SELECT 2 * h - 2 - (beg + len // 3) FROM seqs, half)"


def _points(seqs: DataFrame) -> DataFrame:
    """The middle of each sequence, and a place on the other strand."""
    half = text.forward_length(seqs)
    at = F.array(F.col("beg") + F.expr("len div 2"), text.mirror(F.col("beg") + F.expr("len div 3"), half))
    return seqs.select(F.explode(at).alias("pos")).distinct()


@_query(
    f"""WITH {_SEQS}, {_POINTS},
p AS (SELECT pos, pos >= h AS rev, CASE WHEN pos >= h THEN 2 * h - 2 - pos ELSE pos END AS place FROM points, half)
SELECT pos, name || ':' || (place - beg + 1) || ':' || CASE WHEN rev THEN '-' ELSE '+' END AS label FROM p JOIN seqs ON place >= beg AND place < beg + len"""
)
def pos_to_str(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return text.pos_to_str(_points(seqs), seqs)


@_query(
    f"""WITH {_SEQS}, labels AS (
SELECT name || ':' || (len // 2) || ':-' AS label, CASE WHEN len // 2 BETWEEN 1 AND len - 1 THEN 2 * h - 2 - (beg + len // 2 - 1) END AS pos FROM seqs, half
UNION ALL SELECT name || ':1', CASE WHEN len > 1 THEN beg END FROM seqs
UNION ALL SELECT name || ':' || len || ':+', NULL FROM seqs
UNION ALL SELECT 'no' || name || ':1:+', NULL FROM seqs) SELECT label, pos FROM labels"""
)
def str_to_pos(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    made = F.array(
        F.concat_ws(":", "name", F.expr("len div 2").cast("string"), F.lit("-")), F.concat_ws(":", "name", F.lit("1")), F.concat_ws(":", "name", F.col("len").cast("string"), F.lit("+")), F.concat(F.lit("no"), "name", F.lit(":1:+"))
    )
    return text.str_to_pos(seqs.select(F.explode(made).alias("label")), seqs)


@_query(f"WITH {_SEQS}, {_POINTS} SELECT DISTINCT pos, 2 * h - 2 - pos AS mirrored FROM points, half")
def mirror_pos(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return _points(seqs).select("pos", text.mirror(F.col("pos"), text.forward_length(seqs)).alias("mirrored"))


@_query(f"WITH {_SEQS} SELECT beg + i AS pos, substr(seq || '$', CAST(i AS INTEGER) + 1, 12) AS slice FROM (SELECT *, unnest(range(0, len)) AS i FROM seqs)")
def text_slice(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    every = seqs.select(F.explode(F.sequence(F.col("beg"), F.col("beg") + F.col("len") - 1)).alias("pos"))
    return text.text_slice(every, seqs, "pos", 12)


@_query(f"WITH {_TEXT} SELECT CAST(i AS BIGINT) AS pos, substr(t, i + 1, 100) AS slice FROM body, LATERAL (SELECT unnest(range(0, length(t))) AS i)")
def two_strand_slices(spark, sf_dir):
    """From every position of the text, over sequences and from one strand to the other."""
    seqs = _placed(spark, sf_dir)
    return text.two_strand_slice(spark.range(2 * text.forward_length(seqs)).withColumnRenamed("id", "pos"), seqs, "pos", 100)


@_query(f"WITH {_TEXT} SELECT CAST(i AS BIGINT) AS pos, substr(t, i + 1, 1) AS symbol FROM body, LATERAL (SELECT unnest(range(0, length(t))) AS i)")
def two_strand_symbols(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return text.two_strand_symbol(spark.range(2 * text.forward_length(seqs)).withColumnRenamed("id", "pos"), seqs)


@_query(f"WITH {_STRANDS} SELECT kmer, count(*) AS n FROM {_kmers(K_COUNT)} GROUP BY kmer")
def kmer_count(spark, sf_dir):
    return km.count_kmers(text.both_strands(_sequences(spark, sf_dir)), K_COUNT)


@_query(f"WITH {_STRANDS} SELECT DISTINCT kmer FROM {_kmers(K_COUNT)}")
def kmer_distinct(spark, sf_dir):
    return km.distinct_kmers(text.both_strands(_sequences(spark, sf_dir)), K_COUNT)


@_query(f"WITH d AS (SELECT {_LETTERS} AS seq FROM documents) SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS n FROM {_kmers(K_COUNT, 'd')} GROUP BY 1")
def canonical_kmer_count(spark, sf_dir):
    return km.count_canonical(spread(_table(spark, sf_dir, "documents").select("text")).select(DNA.only_known("text").alias("seq")), K_COUNT)


_PATTERNS = f"patterns AS (SELECT DISTINCT kmer AS pattern FROM {_kmers(K_COUNT, 'seqs')})"


def _patterns(seqs: DataFrame, k: int = K_COUNT) -> DataFrame:
    """Every k-mer of the forward strand."""
    return km.distinct_kmers(seqs, k).withColumnRenamed("kmer", "pattern")


@_query(
    f"""WITH {_STRANDS}, {_PATTERNS}
SELECT kmer AS pattern, CASE WHEN strand = '+' THEN beg + off ELSE 2 * h - 2 - (beg + len - 2 - off) END AS pos,
  name || ':' || (CASE WHEN strand = '+' THEN off ELSE len - 2 - off END + 1) || ':' || strand AS label
FROM {_kmers(K_COUNT)} k JOIN patterns ON kmer = pattern, half"""
)
def kmer_locate(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return search.locate(_patterns(seqs), seqs, K_COUNT)


@_query(f"WITH {_STRANDS}, {_PATTERNS} SELECT pattern, count(kmer) AS n FROM patterns LEFT JOIN {_kmers(K_COUNT)} k ON kmer = pattern GROUP BY pattern")
def pattern_count(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return search.count_patterns(_patterns(seqs), seqs, K_COUNT)


@_query(f"WITH {_STRANDS}, p AS (SELECT DISTINCT kmer AS pattern FROM {_kmers(3, 'seqs')}) SELECT substr(kmer, 1, 3) AS pattern, substr(kmer, 4, 1) AS next, count(*) AS n FROM {_kmers(4)} k WHERE substr(kmer, 1, 3) IN (SELECT pattern FROM p) GROUP BY 1, 2")
def trie_children(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return search.children(_patterns(seqs, 3), seqs, 3)


@_query(
    f"""WITH {_TEXT}, patterns AS ({" UNION ".join(f"SELECT kmer AS pattern FROM {_kmers(n, 'seqs')}" for n in (1, 3, 5))} UNION SELECT ''),
x AS (SELECT DISTINCT pattern, translate(pattern, 'N', 'Z') AS p, {_RC.format('pattern')} AS r FROM patterns),
suffixes AS (SELECT translate(substr(t, pos + 1), 'N', 'Z') AS suffix FROM sa)
SELECT pattern, count(*) FILTER (suffix < p) AS fp, count(*) FILTER (suffix < r) AS rp, count(*) FILTER (starts_with(suffix, p)) AS sz, CAST(length(pattern) AS INTEGER) AS dp FROM x, suffixes GROUP BY pattern"""
)
def fm_interval(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    every = reduce(DataFrame.unionByName, [_patterns(seqs, n) for n in (1, 3, 5)], spark.createDataFrame([("",)], "pattern string"))
    return search.fm_interval(every, seqs)


def _extensions_sql(grown: str) -> str:
    return f"""WITH {_TEXT}, p AS (SELECT DISTINCT kmer AS pattern FROM {_kmers(3, 'seqs')}), {_SYMBOLS},
g AS (SELECT pattern, symbol, {grown} AS grown FROM p, symbols), x AS (SELECT *, translate(grown, 'N', 'Z') AS s, translate({_RC.format('grown')}, 'N', 'Z') AS r FROM g),
suffixes AS (SELECT translate(substr(t, pos + 1, 4), 'N', 'Z') AS suffix, count(*) AS c FROM sa GROUP BY 1)
SELECT pattern, symbol, CAST(coalesce(sum(c) FILTER (suffix < s), 0) AS BIGINT) AS fp, CAST(coalesce(sum(c) FILTER (suffix < r), 0) AS BIGINT) AS rp,
  CAST(coalesce(sum(c) FILTER (suffix = s), 0) AS BIGINT) AS sz, 4 AS dp FROM x, suffixes GROUP BY pattern, symbol"""


@_query(_extensions_sql("pattern || symbol"))
def fm_extend_suffix(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return search.extensions(_patterns(seqs, 3), seqs, "suffix")


@_query(_extensions_sql("symbol || pattern"))
def fm_extend_prefix(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return search.extensions(_patterns(seqs, 3), seqs, "prefix")


def _suffixes(spark, sf_dir):
    return suffix.sa_of_text(_sequences(spark, sf_dir))


@_query(f"WITH {_TEXT} SELECT rank, pos FROM sa")
def suffix_array(spark, sf_dir):
    return _suffixes(spark, sf_dir)[1]


@_query(f"WITH {_TEXT} SELECT rank, pos FROM sa WHERE rank BETWEEN 100 AND 149")
def sa_range(spark, sf_dir):
    return suffix.sa_range(_suffixes(spark, sf_dir)[1], 100, 50)


@_query(f"WITH {_TEXT} SELECT rank, symbol FROM bwt")
def bwt(spark, sf_dir):
    return suffix.bwt(*_suffixes(spark, sf_dir))


@_query(f"WITH {_TEXT}, {_SYMBOLS} SELECT symbol, (SELECT count(*) FROM sa WHERE strpos('ACGTN', substr(t, pos + 1, 1)) - 1 < code) AS start FROM symbols")
def c_array(spark, sf_dir):
    return suffix.c_array(_suffixes(spark, sf_dir)[0])


@_query(
    f"""WITH {_TEXT}, {_SYMBOLS}, blocks AS (SELECT DISTINCT rank // {suffix.MARK} AS block FROM bwt)
SELECT block, s.symbol, (SELECT count(*) FROM bwt b WHERE b.symbol = s.symbol AND b.rank < block * {suffix.MARK}) AS cnt FROM blocks, symbols s"""
)
def occ_marks(spark, sf_dir):
    return suffix.occ_marks(suffix.bwt(*_suffixes(spark, sf_dir)))


@_query(f"WITH {_TEXT}, {_SYMBOLS}, p AS (SELECT rank AS ptr, symbol AS own FROM bwt) SELECT ptr, s.symbol, count(*) FILTER (own = s.symbol) OVER (PARTITION BY s.symbol ORDER BY ptr) AS occ FROM p, symbols s")
def occ_rank(spark, sf_dir):
    transform = saved(suffix.bwt(*_suffixes(spark, sf_dir)))
    points = transform.select(F.col("rank").alias("ptr"), F.explode(F.array(*map(F.lit, DNA.canonical))).alias("symbol"))
    return suffix.occ_rank(points, transform, suffix.occ_marks(transform))


@_query(
    f"""WITH {_TEXT} SELECT rank AS ptr, """
    + ", ".join(f"count(*) FILTER (symbol = '{c}') OVER (ORDER BY rank) AS occ_{c}" for c in DNA.canonical)
    + " FROM bwt"
)
def occ_all(spark, sf_dir):
    transform = saved(suffix.bwt(*_suffixes(spark, sf_dir)))
    return suffix.occ_all(transform.select(F.col("rank").alias("ptr")), transform, suffix.occ_marks(transform))


def _pairs_sql(k: int, tau: int) -> str:
    return f"""WITH {_STRANDS}, k AS (SELECT DISTINCT kmer FROM {_kmers(k)}),
pairs AS (SELECT x.kmer AS a, y.kmer AS b, CAST(hamming(x.kmer, y.kmer) AS INTEGER) AS dist FROM k x JOIN k y ON x.kmer < y.kmer AND hamming(x.kmer, y.kmer) <= {tau})"""


def _add_pairs(tau: int) -> None:
    k = K_PAIRS[tau]

    def pairs(spark, sf_dir):
        return neighbors.hamming_pairs(_sequences(spark, sf_dir), k, tau).select("a", "b", "dist")

    pairs.__name__ = f"hamming_pairs_t{tau}"
    _query(f"{_pairs_sql(k, tau)} SELECT a, b, dist FROM pairs")(pairs)


for _tau in K_PAIRS:
    _add_pairs(_tau)


def _mism_sql(k: int) -> str:
    return f"list_filter(range(0, {k}), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))"


@_query(f"{_pairs_sql(12, 2)} SELECT a, b, array_to_string({_mism_sql(12)}, ',') AS positions FROM pairs")
def mismatch_positions(spark, sf_dir):
    pairs = neighbors.hamming_pairs(_sequences(spark, sf_dir), 12, 2)
    return pairs.select("a", "b", F.array_join(neighbors.positions_of(F.col("mism"), 12).cast("array<string>"), ",").alias("positions"))


@_query(f"WITH {_STRANDS}, k AS (SELECT DISTINCT kmer FROM {_kmers(12)}), q AS (SELECT DISTINCT kmer AS query FROM {_kmers(12, 'seqs')}) SELECT query, kmer AS hit, CAST(hamming(query, kmer) AS INTEGER) AS dist FROM q JOIN k ON hamming(query, kmer) <= 2")
def approximate_search(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return neighbors.search(_patterns(seqs, 12).withColumnRenamed("pattern", "query"), seqs, 12, 2).select("query", "hit", "dist")


_SEARCH = f"WITH {_STRANDS}, k AS (SELECT DISTINCT kmer FROM {_kmers(12)}), q AS (SELECT DISTINCT kmer AS query FROM {_kmers(12, 'seqs')}) SELECT query, kmer AS hit, CAST(hamming(query, kmer) AS INTEGER) AS dist FROM q JOIN k ON hamming(query, kmer) <= 2"


@_query(f"{_SEARCH} AND left(query, 5) = left(kmer, 5) AND hamming(query, kmer) >= 1")
def approximate_search_right(spark, sf_dir):
    """The first five symbols are matched already; the rest is searched to the right, with a mismatch at least."""
    seqs = _placed(spark, sf_dir)
    hits = neighbors.search(_patterns(seqs, 12).withColumnRenamed("pattern", "query"), seqs, 12, 2)
    return neighbors.within(hits, 12, 5, 12, 2, score_diff=1).select("query", "hit", "dist")


@_query(f"{_SEARCH} AND right(query, 5) = right(kmer, 5) AND hamming(query, kmer) >= 2")
def approximate_search_left(spark, sf_dir):
    """To the left of the last five symbols, with a mismatch more than a score of one."""
    seqs = _placed(spark, sf_dir)
    hits = neighbors.search(_patterns(seqs, 12).withColumnRenamed("pattern", "query"), seqs, 12, 2)
    return neighbors.within(hits, 12, 0, 7, 2, score_ref=1, score_diff=1).select("query", "hit", "dist")


@_query(f"{_SEARCH} AND kmer <= query")
def approximate_search_bounded(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return neighbors.search(_patterns(seqs, 12).withColumnRenamed("pattern", "query"), seqs, 12, 2, boundary=True).select("query", "hit", "dist")


def _blanked(kmer: str, first: str, second: str) -> str:
    """A 12-mer with N at two places (from 0), which may be one; the same text for both engines."""
    one = f"concat(substr({kmer}, 1, CAST({first} AS INT)), 'N', substr({kmer}, CAST({first} AS INT) + 2))"
    return f"concat(substr({one}, 1, CAST({second} AS INT)), 'N', substr({one}, CAST({second} AS INT) + 2))"


_BLANKED = _blanked("kmer", "off % 12", "(5 * off + 3) % 12")


@_query(f"""WITH {_STRANDS}, k AS (SELECT DISTINCT kmer FROM {_kmers(12)}), q AS (SELECT DISTINCT {_BLANKED} AS query FROM {_kmers(12, 'seqs')}),
n AS (SELECT query, length(query) - length(replace(query, 'N', '')) AS free FROM q)
SELECT query, kmer AS hit, CAST(hamming(query, kmer) - free AS INTEGER) AS dist FROM n JOIN k ON hamming(query, kmer) <= free + 1""")
def approximate_search_unknown(spark, sf_dir):
    """Every 12-mer with unknown symbols at two places of its own, which match anything."""
    seqs = _placed(spark, sf_dir)
    queries = km.kmers(seqs, 12).select(F.expr(_BLANKED).alias("query"))
    return neighbors.search(queries, seqs, 12, 1).select("query", "hit", "dist")


def _annotation_sql(k: int, tau: int) -> str:
    return f"""{_pairs_sql(k, tau)},
both_ways AS (SELECT a, b, dist FROM pairs UNION ALL SELECT b, a, dist FROM pairs),
least AS (SELECT a, min(dist) AS dist FROM both_ways GROUP BY a),
near AS (SELECT a, b, p.dist FROM both_ways p JOIN least USING (a, dist)),
cnt AS (SELECT a, dist, count(*) AS n FROM near GROUP BY a, dist),
places AS (SELECT a, list_sort(list(DISTINCT i)) AS l FROM (SELECT a, unnest({_mism_sql(k)}) AS i FROM near) GROUP BY a),
ann AS (SELECT kmer, coalesce(dist, 0) AS dist, coalesce(n, 0) AS neigh_cnt,
  CASE WHEN l IS NULL OR len(l) > {max(3, tau)} THEN '' ELSE array_to_string(l, ',') END AS positions
  FROM k LEFT JOIN cnt ON kmer = cnt.a LEFT JOIN places ON kmer = places.a)"""


def _csv(annotation: DataFrame) -> DataFrame:
    return annotation.withColumn("positions", F.array_join(F.col("align_pos").cast("array<string>"), ",")).drop("align_pos")


@_query(f"{_annotation_sql(10, 1)} SELECT kmer, dist, neigh_cnt, positions FROM ann")
def neighbor_annotation_t1(spark, sf_dir):
    return _csv(neighbors.annotate(_sequences(spark, sf_dir), 10, 1))


@_query(f"{_annotation_sql(12, 2)} SELECT kmer, dist, neigh_cnt, positions FROM ann")
def neighbor_annotation_t2(spark, sf_dir):
    return _csv(neighbors.annotate(_sequences(spark, sf_dir), 12, 2))


@_query(
    f"""{_annotation_sql(6, 1)} SELECT kmer, dist, CAST(CASE WHEN neigh_cnt <= 10 THEN neigh_cnt WHEN neigh_cnt <= 20 THEN 15 WHEN neigh_cnt <= 50 THEN 40 WHEN neigh_cnt <= 100 THEN 75 WHEN neigh_cnt <= 500 THEN 300 ELSE 1000 END AS BIGINT) AS neigh_cnt FROM ann"""
)
def annotation_binned(spark, sf_dir):
    return neighbors.annotation_binned(neighbors.annotate(_sequences(spark, sf_dir), 6, 1))


_BYTES = f"""{_annotation_sql(10, 1)}, loci AS (SELECT beg + off AS pos, dist, neigh_cnt, CASE WHEN positions = '' THEN [] ELSE list_transform(string_split(positions, ','), lambda x: CAST(x AS INTEGER)) END AS l FROM {_kmers(10, "seqs")} x JOIN ann USING (kmer) WHERE dist > 0),
bytes AS (SELECT pos, CAST(bit_or(info) AS INTEGER) AS info FROM (
  SELECT pos, CASE WHEN neigh_cnt <= 10 THEN neigh_cnt WHEN neigh_cnt <= 20 THEN 11 WHEN neigh_cnt <= 50 THEN 12 WHEN neigh_cnt <= 100 THEN 13 WHEN neigh_cnt <= 500 THEN 14 ELSE 15 END + 16 * (dist - 1) + CASE WHEN len(l) > 0 THEN 64 ELSE 0 END AS info FROM loci
  UNION ALL SELECT pos + unnest(l), 128 FROM loci) GROUP BY pos)"""


@_query(f"{_BYTES} SELECT pos, info FROM bytes")
def annotation_bytes(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return neighbors.annotation_bytes(seqs, neighbors.annotate(seqs, 10, 1), 10)


@_query(
    f"""{_BYTES}, marked AS (SELECT pos - i AS pos, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM bytes, (SELECT unnest(range(0, 10)) AS i) WHERE info >= 128 GROUP BY 1)
SELECT pos, CAST(((info >> 4) & 3) + 1 AS INTEGER) AS dist, CAST(CASE info & 15 WHEN 11 THEN 15 WHEN 12 THEN 40 WHEN 13 THEN 75 WHEN 14 THEN 300 WHEN 15 THEN 1000 ELSE info & 15 END AS BIGINT) AS neigh_cnt,
  CASE WHEN info & 64 > 0 THEN coalesce(positions, '') ELSE '' END AS positions FROM bytes LEFT JOIN marked USING (pos) WHERE info & 15 > 0"""
)
def annotation_decoded(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return _csv(neighbors.annotation_of_bytes(neighbors.annotation_bytes(seqs, neighbors.annotate(seqs, 10, 1), 10), 10))


@_query(
    f"""{_annotation_sql(10, 1)}, loci AS (SELECT seq_id, name, off + 1 AS place, kmer FROM {_kmers(10, 'seqs')})
SELECT name || ':' || place || ':+' AS label, coalesce(dist, 0) AS dist, coalesce(neigh_cnt, 0) AS neigh_cnt, coalesce(positions, '') AS positions FROM loci LEFT JOIN ann USING (kmer)
UNION ALL SELECT name || ':' || place || ':-', coalesce(dist, 0), coalesce(neigh_cnt, 0),
  coalesce(array_to_string(list_sort(list_transform(list_filter(string_split(positions, ','), lambda x: x <> ''), lambda x: 9 - CAST(x AS INTEGER))), ','), '') FROM loci LEFT JOIN ann USING (kmer)"""
)
def annotation_query(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    places = km.kmers(seqs, 10, ["name"]).select(F.concat_ws(":", "name", (F.col("off") + 1).cast("string")).alias("place"))
    labels = places.select(F.explode(F.array(F.concat("place", F.lit(":+")), F.concat("place", F.lit(":-")))).alias("label"))
    return _csv(neighbors.annotation_query(labels, seqs, neighbors.annotate(seqs, 10, 1), 10)).drop("align_cnt")


@_query(f"{_annotation_sql(10, 1)} SELECT kmer FROM ann WHERE dist = 0")
def unannotated_kmers(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    return neighbors.unannotated(seqs, neighbors.annotate(seqs, 10, 1), 10)


@_query("SELECT doc_id AS ord, CAST(doc_id + 1 AS VARCHAR) AS tag, CAST(length(text) AS INTEGER) AS seq_len, md5(text) AS seq_md5 FROM documents")
def read_parse(spark, sf_dir):
    """Every document as a read; one without text is kept, with the length and digest of what it has (null: null)."""
    reads = new_reads(raw_reads(_table(spark, sf_dir, "documents"), "doc_id", "text"), "permissive")
    return reads.select("ord", "tag", F.length("seq").alias("seq_len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


_SEEDS = f"""d AS (SELECT doc_id, {_LETTERS} AS seq FROM documents), b AS (SELECT item_id, {_LETTERS} AS seq FROM benchmark),
seeds AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT DISTINCT doc_id, kmer FROM {_kmers(K_SEED, "d")}) x JOIN (SELECT DISTINCT item_id, kmer FROM {_kmers(K_SEED, "b")}) y USING (kmer) GROUP BY 1, 2)"""


def _seeds(spark, sf_dir):
    letters = lambda name, key: spread(_table(spark, sf_dir, name).select(key, "text")).select(key, DNA.only_known("text").alias("seq"))
    return mapping.contamination_seeds(letters("documents", "doc_id"), letters("benchmark", "item_id"), K_SEED, "doc_id", "item_id", "seq", "seq")


@_query(f"WITH {_SEEDS} SELECT doc_id, item_id, n FROM seeds")
def contamination_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n")


@_query(f"WITH {_SEEDS} SELECT doc_id, arg_min(item_id, -n * 1000000 + item_id) AS item_id, max(n) AS n FROM seeds GROUP BY doc_id")
def best_hit(spark, sf_dir):
    best = _seeds(spark, sf_dir).groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("item"))).alias("x"))
    return best.select(F.col("doc").alias("doc_id"), F.col("x.item").alias("item_id"), (-F.col("x.less")).alias("n"))


_CHANGED = f"substr(kmer, 1, 12) || translate(substr(kmer, 13, 1), 'ACGT', 'CGTA') || substr(kmer, 14)"


@_query(
    f"""WITH {_STRANDS}, reads AS (SELECT seq_id * 100000 + off AS read, {_CHANGED} AS seq FROM {_kmers(K_READ, "seqs")}),
places AS (SELECT read, name, CASE WHEN strand = '+' THEN off + 1 ELSE length(k.seq) - off - {K_READ} + 1 END AS "offset", strand, CAST(hamming(r.seq, kmer) AS INTEGER) AS dist
  FROM reads r JOIN {_kmers(K_READ)} k ON hamming(r.seq, kmer) <= 1)
SELECT read, name, "offset", strand, dist FROM places QUALIFY row_number() OVER (PARTITION BY read ORDER BY dist, name, "offset", strand) = 1"""
)
def map_reads(spark, sf_dir):
    seqs = _placed(spark, sf_dir)
    kmer = lambda a, n: F.substring("kmer", a, n)
    changed = F.concat(kmer(1, 12), F.translate(kmer(13, 1), "ACGT", "CGTA"), kmer(14, K_READ))
    reads = km.kmers(seqs, K_READ).select((F.col("seq_id") * 100000 + F.col("off")).alias("ord"), changed.alias("seq"))
    return mapping.map_reads(reads, seqs, K_COUNT, 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_files  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
