"""The operators against plain versions, on a small corpus with copies, near copies and shared lines and passages."""

import copy
import glob
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, components, decontaminate, html_extract, line_dedup, lm_score, quality, sentencepiece_codec, simhash, substring_dedup, warc
from helixframe.llm.fm_index import FmIndex, WaveletMatrix
from helixframe.llm.pieces import load_pieces
from helixframe.llm.wrapper import main_box, parse, wrap
from tests.llm import brute

SHARED = "This line is shared by many documents and is longer than forty characters"


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    vocabulary = ["Wort", "été", "the", "of", "A", "naïve", "x1", "#", "日本語", "und", "don't", "ÀB"] + [f"w{i}" for i in range(150)]
    passage = [rnd.choice(vocabulary) for _ in range(90)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    texts = ["", " \t\n", "one", "one two", "one two three", "\n\n\n", "a" * 3000, "x y " * 400]
    while len(texts) < n:
        kind = len(texts) % 6
        if kind == 0 and len(texts) > 12:
            texts.append(texts[rnd.randrange(8, len(texts))])
        elif kind == 1:
            words = line(80).split(" ")
            a = rnd.randrange(0, 30)
            texts.append(" ".join(words[:20] + passage[a : a + 60] + words[20:]))
        elif kind == 2:
            texts.append("\n".join([line(9), rnd.choice(["  ", "\t", ""]) + rnd.choice([SHARED, SHARED.upper()]) + "\x0b", line(12)] + [SHARED] * rnd.randrange(2)))
        elif kind == 3 and len(texts) > 12:
            words = texts[-1].split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append("\r\n".join(line(rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 8))))
    ids = list(range(n))
    rnd.shuffle(ids)
    return [(i * 3, t) for i, t in zip(ids, texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "key", k, 1) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n_words int, spans int").repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, n_chars bigint")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, columns, rows):
    assert got(df, *columns.split()) == sorted(rows, key=repr)


# line dedup


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup(docs, broadcast):
    done = line_dedup.line_dedup_report(docs, broadcast_keys=broadcast).cache()
    same(done, "doc_id n_lines n_dropped kept_sha256", brute.line_dedup(DOCS))
    assert done.agg(F.sum("n_dropped")).first()[0] > 5
    kept = line_dedup.line_dedup(docs, broadcast_keys=broadcast)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup_of_odd_rows(spark, broadcast):
    rows = [(None, SHARED), (7, SHARED), (7, SHARED + "\nmore"), (1, SHARED + "\n" + SHARED), (2, None), (3, SHARED)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = line_dedup.line_dedup_report(df, broadcast_keys=broadcast)
    assert got(done, "doc_id", "text") == sorted([(None, ""), (7, SHARED), (7, SHARED + "\nmore"), (1, ""), (2, ""), (3, "")], key=repr)


# quality


def test_quality_base(spark, docs):
    done = quality.quality_report(docs, host_col="key")
    same(done, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", [(i, *brute.base_quality(t)) for i, t in DOCS])


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_quality_host_verdicts(spark, broadcast):
    text = lambda k: " ".join(f"word{i * 7 + k}" for i in range(20))
    marked = lambda k: text(k) + " ##########"
    rows = [(k, marked(k), "bad") for k in range(30)] + [(100 + k, text(k), "bad") for k in range(10)]
    rows += [(200 + k, marked(k) if k == 0 else text(k), "good") for k in range(40)] + [(300, text(1) + " " + "#" * 60, "good"), (400, text(2), None), (401, None, "good")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_report(df, broadcast_hosts=broadcast).collect()}
    assert not any(kept[k] for k in range(30)), "a bad host's documents fall to the strict limit"
    assert all(kept[100 + k] for k in range(10)), "clean documents stay on a bad host"
    assert kept[200], "the strict limit doesn't hold on a good host"
    assert not kept[300] and kept[400] and not kept[401]
    assert {r.doc_id for r in quality.quality_filter(df, broadcast_hosts=broadcast).collect()} == {i for i, k in kept.items() if k}


def test_quality_prior_shrinks_small_hosts(spark):
    rows = [("a", 60, 30), ("b", 60, 0), ("c", 1, 1), ("d", 60, 3)]
    df = spark.createDataFrame([(h, 10, 100 if i < f else 0) for h, n, f in rows for i in range(n)], "source string, n_words int, n_symbols int")
    for c in ("n_dup_lines", "n_lines", "word_chars"):
        df = df.withColumn(c, F.lit(1))
    rate = {r["__host"]: r["__rate_symbols"] for r in quality.host_verdicts(df, "source").collect()}
    assert rate["b"] < rate["d"] < rate["c"] < 1 and abs(rate["a"] - 0.5) < 0.1


# decontamination

ITEMS = [(1, " ".join(f"Item{i}" for i in range(40))), (2, "short ONE here"), (3, None), (4, "..."), (5, "Short one, HERE!"), (6, " ".join(f"item{i}" for i in range(10, 30)))]


def contaminated():
    item = ITEMS[0][1]
    words = item.split(" ")
    return DOCS + [(1001, "before " + item.upper() + " after"), (1002, " ".join(words[:12])), (1003, "it has short-one here, é"), (1004, " ".join(words[3:20]) + " z" * 400), (1005, None)]


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_decontamination(spark, block):
    rows = contaminated()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    done = decontaminate.decontamination_report(df, items, block_chars=block).cache()
    same(done, "doc_id n_words n_hit n_items items_sha256 contaminated", brute.decontaminate(rows, ITEMS))
    left = decontaminate.decontaminate(df, items, block_chars=block)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in done.collect() if not r.contaminated}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(df, items, block_chars=block, mode="spans").collect()}
    assert cut[1001] == "before  after" and cut[1003] == "it has , é" and cut[1002] == dict(rows)[1002] and cut[1005] is None


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_no_passage_leaves_the_pipelines_stage(spark, block, tmp_path, monkeypatch):
    import corpus_pipeline

    words, filler = ITEMS[0][1].split(" "), " filler" * 900
    nested = words[:12] + ["short", "one", "here"] + words[12:20]  # a cut joins what stands around it
    rows = [(1, " ".join(words[:20]) + filler), (2, " ".join(nested) + filler), (3, " ".join(words)), (4, "clean" + filler)]
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    plain = decontaminate.decontaminate
    monkeypatch.setattr(corpus_pipeline, "decontaminate", lambda *x, **y: plain(*x, block_chars=block, **y))
    left = corpus_pipeline.benchmark(spark, df, str(tmp_path)).collect()
    assert {r.doc_id: r.text.split() for r in left} == {1: filler.split(), 2: filler.split(), 4: ("clean" + filler).split()}
    assert all(r.n_chars == len(r.text) for r in left)
    assert not any(r[2] for r in brute.decontaminate([(r.doc_id, r.text) for r in left], ITEMS))


# substring dedup


@pytest.mark.parametrize("variants, shard_words", [(1000, 500_000), (0, 500_000), (3, 300)])
def test_substring_dedup(docs, variants, shard_words):
    done = substring_dedup.substring_dedup_report(docs, variants=variants, shard_words=shard_words).cache()
    same(done, "doc_id n_words n_removed kept_sha256", brute.substring_dedup(DOCS))
    assert done.filter("n_removed > 0 and n_removed < n_words").count() > 3


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(None, text), (5, text), (5, text), (3, "x " + text), (9, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = substring_dedup.substring_dedup_report(df)
    assert got(done, "doc_id", "n_words", "n_removed") == sorted([(None, 70, 0), (5, 70, 70), (5, 70, 70), (3, 71, 0), (9, 0, 0), (4, 0, 0)], key=repr)
    kept = substring_dedup.substring_dedup(df.withColumn("spans", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "spans"] and got(kept, "doc_id", "text") == sorted([(None, text), (5, ""), (5, ""), (3, "x " + text), (9, None), (4, "")], key=repr)


def test_substring_dedup_of_long_texts_and_text_ids(spark):
    """A passage in a hundred other contexts, a text of 60,000 words twice, and ids that are text."""
    rnd = random.Random(9)
    words = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    passage, long = words(120), words(60_000)
    rows = [(f"d{i:03}", " ".join(words(20) + passage[: rnd.randrange(60, 120)] + words(20))) for i in range(100)]
    rows += [("x1", " ".join(long)), ("x2", " ".join(["other", *long[10:]])), ("x3", " ".join(["same"] * 5000))]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    done = substring_dedup.substring_dedup_report(df, variants=20)
    same(done, "doc_id n_words n_removed kept_sha256", brute.substring_dedup(rows))


def test_bit_vectors():
    from helixframe.llm.fm_index import BitVector

    rnd = np.random.default_rng(5)
    for n, share in ((0, 0.5), (1, 1.0), (64, 0.5), (5000, 0.01), (5000, 0.9), (1024, 0.0), (3000, 1.0)):
        bits = rnd.random(n) < share
        v = BitVector(bits)
        assert v.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert v.select(np.arange(v.ones + 2)).tolist() == [*np.flatnonzero(bits).tolist(), n, n]


def test_fm_index_against_plain_search():
    rnd = np.random.default_rng(3)
    sequence = rnd.integers(0, 7, 500)
    matrix = WaveletMatrix(sequence, 7)
    for c in range(7):
        ends = np.arange(501)
        assert (matrix.rank(np.full(501, c), ends) == np.concatenate(([0], np.cumsum(sequence == c)))).all()
    size = 5
    parts = [rnd.integers(1, 4, n) for n in (3, 5, 9, 30, 30, 6)]
    parts.append(parts[3])
    owner = np.array([70, 60, 50, 40, 30, 20, 10])
    first = np.cumsum([0] + [len(p) for p in parts])[:-1]
    index = FmIndex(np.concatenate(parts), first, owner, size)
    # its own sequences, and others with symbols and windows that it lacks
    streamed = parts + [rnd.integers(0, 4, n) for n in (2, 5, 40, 60)] + [np.concatenate((parts[3][:12], [0], parts[4][3:20]))]
    length = np.array([len(p) for p in streamed])
    begin = np.cumsum(length) - length
    found = index.matches(np.concatenate(streamed), begin, length)
    for k, p in enumerate(streamed):
        for i in range(len(p)):
            w = p[i : i + size].tolist()
            least = min((owner[j] for j, q in enumerate(parts) for a in range(len(q) - size + 1) if q[a : a + size].tolist() == w and len(w) == size), default=-1)
            assert found[begin[k] + i] == least


def test_bytes_of_an_index():
    """What stays of an index of runs as the operator makes them, in bytes a symbol."""
    rnd = np.random.default_rng(1)
    vocabulary = rnd.zipf(1.3, 200_000).clip(max=20_000)
    parts = [vocabulary[a : a + 70] for a in rnd.integers(0, 199_000, 3000)]
    index = FmIndex(np.concatenate(parts).astype(np.int64), np.arange(3000) * 70, np.arange(3000), 50)
    assert index.nbytes / index.length < 5


# simhash


@pytest.mark.parametrize("bucket", [200_000, 2, 0])
def test_simhash_components(docs, bucket):
    same(simhash.simhash_components(docs, bucket=bucket), "doc_id fingerprint component_id", brute.simhash_components(DOCS))


@pytest.mark.parametrize("bucket", [200_000, 5])
def test_links_of_dense_prints(spark, bucket):
    rnd = random.Random(8)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rnd.randrange(4)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints |= {0, 1, 3, 7, 15, 2**64 - 1, 2**63}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "print bigint"), bucket=bucket).distinct()
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[find(a)] = find(b)
    classes = lambda f: {frozenset(q for q in signed if f(q) == f(p)) for p in signed}
    assert classes(find) == classes(lambda p: roots.get(p, p))


def test_simhash_dedup_keeps_one_of_each_group(spark, docs):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.simhash_components(DOCS)})
    odd = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (6, None), (7, "")], "doc_id bigint, text string")
    assert got(simhash.simhash_dedup(odd), "doc_id", "text") == sorted([(5, "a b c d"), (None, "q r s t u"), (6, None)], key=repr)


@pytest.mark.parametrize("sample, centers", [(10_000, 64), (20, 1)])
def test_near_copies_by_five_words(spark, sample, centers):
    from helixframe.llm import jaccard

    rnd = random.Random(3)
    rows = [(i, t) for i, t in DOCS]
    for group in range(12):  # copies with up to 5 of 150 words replaced, of texts that share a long passage
        words = [f"g{group}w{rnd.randrange(90)}" for _ in range(110)] + [f"passage{k}" for k in range(40)]
        for copy in range(6):
            other = list(words)
            for _ in range(copy):
                other[rnd.randrange(110)] = f"new{rnd.randrange(10**6)}"
            rows.append((1000 + group * 10 + copy, " ".join(other)))

    def alike(a, b):
        x, y = (set(zip(*(t.lower().split()[i:] for i in range(min(5, len(t.split())))))) for t in (a, b))
        return 5 * len(x & y) >= 4 * len(x | y) > 0

    heads = {c for _, _, c in brute.simhash_components(rows)}
    left = sorted((r for r in rows if r[0] in heads), key=lambda r: r[0])
    group = {i: i for i, _ in left}
    for k, (i, t) in enumerate(left):
        for j, u in left[:k]:
            if group[i] != group[j] and alike(t, u):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = {x: new if g == old else g for x, g in group.items()}
    assert len(set(group.values())) < len(left)  # SimHash alone leaves some
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, __id int, __hash int").repartition(3)
    kept = jaccard.near_dedup(df, sample=sample, centers=centers)
    assert kept.columns == df.columns
    assert got(kept, "doc_id", "__id", "__hash") == sorted([(i, 1, 2) for i in set(group.values())], key=repr)


def test_bitmaps_never_rule_out_what_is_alike():
    import numpy as np

    from helixframe.llm.jaccard import differ, parity

    rnd = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rnd.integers(-(2**63), 2**63, rnd.integers(0, 700)))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.random()], rnd.integers(-(2**63), 2**63, rnd.integers(0, 300))]))
        assert differ(parity(a), parity(b)) == differ(parity(b), parity(a)) <= len(np.setxor1d(a, b))
    assert differ(parity(a), parity(a)) == 0


def test_near_dedup_makes_few_pairs_of_shared_passages(spark, monkeypatch):
    """Shingles that a sample doesn't see often are repeated in many texts: their meetings are no pairs as long as texts have others of their own."""
    from helixframe.llm import jaccard

    rnd = random.Random(6)
    stock = [[f"p{k}w{i}" for i in range(12)] for k in range(40)]
    rows = []
    for i in range(300):  # a third of each text is passages that some 20 others have
        words = [f"t{rnd.randrange(10**7)}" for _ in range(100)]
        for k in rnd.sample(range(40), 4):
            at = rnd.randrange(len(words))
            words[at:at] = stock[k]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1].rsplit(" ", 3)[0] + f" x{i} y z") for i in range(20)]  # near copies of the first twenty
    counts, alike = [], jaccard._alike

    def counted(pairs, *others):
        counts.append(pairs.count())
        return alike(pairs, *others)

    monkeypatch.setattr(jaccard, "_alike", counted)
    kept = jaccard.jaccard_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), sample=5)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert 20 <= sum(counts) <= 100


def near_groups(rows):
    """The smallest id of each group that five-word shingles of similarity 0.8 or more make; rows: distinct texts with words."""
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}) for i, t in sorted(rows)]
    group = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if group[i] != group[j] and 5 * len(x & y) >= 4 * len(x | y):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = {a: new if g == old else g for a, g in group.items()}
    return sorted(set(group.values()))


def made_pairs(spark, monkeypatch, rows, **options):
    """What jaccard_dedup keeps of rows, and how many pairs its rounds compare."""
    from helixframe.llm import jaccard

    counts, alike = [], jaccard._alike

    def counted(pairs, *others):
        counts.append(pairs.count())
        return alike(pairs, *others)

    monkeypatch.setattr(jaccard, "_alike", counted)
    kept = jaccard.jaccard_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **options)
    return sorted(r.doc_id for r in kept.collect()), sum(counts)


def test_near_dedup_makes_few_pairs_of_texts_of_shared_passages(spark, monkeypatch):
    """Three quarters of each text is passages that a fifth of all texts has, and the sample sees none of it: what few shingles a text
    has of its own are its prefix, so pairs are those of copies."""
    rnd = random.Random(8)
    stock = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(40)]
    rows = []
    for i in range(300):
        parts = rnd.sample(stock, 8) + [f"t{i}w{k}" for k in range(30)]
        rnd.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i][1].rsplit(" ", 2)[0] + f" x{i} y z") for i in range(20)]  # near copies of the first twenty
    kept, pairs = made_pairs(spark, monkeypatch, rows, sample=5)
    assert kept == list(range(300))
    assert 20 <= pairs <= 100


@pytest.mark.parametrize("rare, sample", [(1, 10_000), (2, 5), (3, 60), (16, 5)])
def test_near_dedup_of_frequent_and_rare_shingles(spark, monkeypatch, rare, sample):
    """Whichever shingles come first, second and last, the groups are those of all pairs."""
    from helixframe.llm import jaccard

    rnd = random.Random(rare)
    stock = [" ".join(f"p{k}w{i}" for i in range(rnd.choice((3, 6, 14)))) for k in range(12)]
    rows = [(900 + k, stock[k]) for k in range(12)] + [(950, "one"), (951, "one two"), (952, "one two three four five six")]
    for i in range(40):
        parts = rnd.sample(stock, rnd.randrange(1, 9)) + [f"t{i}w{k}" for k in range(rnd.choice((0, 2, 12)))]
        for copy in range(rnd.choice((1, 2, 3, 6))):
            rows.append((20 * i + copy, " ".join([*parts[:copy], *([f"c{i}x{copy}"] if copy else []), *parts[copy:]])))
            rnd.shuffle(parts) if rnd.random() < 0.2 else None
    rows = list({t: (i, t) for i, t in reversed(rows)}.values())
    rows = sorted(rows)
    want = near_groups(rows)
    assert len(want) < len(rows) - 10
    monkeypatch.setattr(jaccard, "RARE", rare)
    again = [(i + 5000, t) for i, t in rows[::7]]  # copies of whole texts
    kept = jaccard.jaccard_dedup(spark.createDataFrame(rows + again, "doc_id bigint, text string").repartition(3), sample=sample, centers=2)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_few_components_are_the_components(spark):
    rnd = random.Random(5)
    for many in (0, 40):
        edges = [(rnd.randrange(-200, 200), rnd.randrange(-200, 200)) for _ in range(many)] + [(1000 + i, 1001 + i) for i in range(many)]
        df = spark.createDataFrame([(a, b) for a, b in edges if a != b], "a bigint, b bigint")
        assert got(components.few_components(df), "node", "root") == got(components.connected_components(df), "node", "root")


def test_near_dedup_of_odd_rows(spark):
    from helixframe.llm import jaccard

    odd = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (6, None), (7, "")], "doc_id bigint, text string")
    want = sorted([(5, "a b c d"), (None, "q r s t u"), (6, None)], key=repr)
    assert got(jaccard.near_dedup(odd), "doc_id", "text") == want
    assert got(jaccard.jaccard_dedup(odd), "doc_id", "text") == sorted([*want, (7, "")], key=repr)
    assert jaccard.near_dedup(odd.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (7, 6)]
    got_ = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got_ == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# language model


@pytest.mark.parametrize("frequent", [300_000, 50, 1])
def test_lm_base(docs, frequent):
    rows = [(*r[:5], pytest.approx(r[5], rel=1e-9)) for r in sorted(brute.base_lm(DOCS), key=lambda r: r[0])]
    done = lm_score.lm_scores(docs, frequent=frequent).orderBy("doc_id").collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in done] == rows
    scores = brute.unigram_lm(DOCS, load_pieces(), lm_score.OFFSET, lm_score.END, lm_score.ROUNDS)
    assert [(r.doc_id, r.score) for r in done] == [(i, pytest.approx(x, rel=1e-6)) for i, x in sorted(scores)]


def test_training_makes_held_out_documents_likelier(docs):
    mean = lambda rounds: lm_score.lm_scores(docs, rounds=rounds).filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(2) > mean(0)


def test_lattice_adds_all_segmentations():
    lattice = lm_score.Lattice()
    p = load_pieces()
    weight = {t: 1 / (lm_score.OFFSET - s) for t, s in zip(p.texts, p.scores) if s > -1e8}
    byte = min(weight.values())
    scale = (1 - lm_score.END) / (sum(weight.values()) + 256 * byte)

    def brute_force(text):
        total = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - 16), end):
                if (w := weight.get(text[begin:end])) is not None:
                    total[end] += total[begin] * w * scale
            if text[end - 1] not in weight:
                total[end] += total[end - 1] * (byte * scale) ** len(text[end - 1].encode())
        return math.log(total[-1])

    words = ["the", "été", "x", "international", "日本語", "😀z", "#$%"]
    assert lattice.words([w.encode() for w in words]).tolist() == pytest.approx([brute_force("▁" + w) for w in words])
    assert math.isfinite(lattice.words([b"ab\xc3\xa9" * 5000])[0]) and lattice.words([]).tolist() == []
    # what is expected is the derivative of a word's log probability by the logs of the weights
    sums = lattice.expected([w.encode() for w in words], np.arange(1.0, 8.0))
    for piece in [*np.flatnonzero(sums)[::7].tolist(), lattice.byte]:
        moved = copy.copy(lattice)
        moved.log = lattice.log + np.where(np.arange(len(lattice.log)) == piece, 1e-6, 0)
        change = (moved.words([w.encode() for w in words]) - lattice.words([w.encode() for w in words])) @ np.arange(1.0, 8.0)
        assert change / 1e-6 == pytest.approx(sums[piece], rel=1e-4, abs=1e-4)
    assert np.exp(lattice.log).sum() + 255 * math.exp(lattice.log[lattice.byte]) == pytest.approx(1)
    fitted = lattice.fitted({3: 5.0, lattice.byte: 2.0})
    assert np.exp(fitted.log).sum() + 255 * math.exp(fitted.log[fitted.byte]) == pytest.approx(1)


def test_lm_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (3, "a b"), (3, "a b"), (4, "")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.n_tokens): r for r in lm_score.lm_scores(df).collect()}
    assert lm_score.lm_scores(df).count() == 4 and rows[None, 1].held_out and -4 < rows[None, 1].score < 0
    assert rows[3, 3].score < rows[None, 1].score < 0


# sentencepiece


def test_encoding_is_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    matcher = sentencepiece_codec.Matcher(load_pieces())
    rnd = random.Random(2)
    texts = [t for _, t in DOCS] + [" ", "  a   b\n\n\tc\x00é😀 x", "▁x ▁", "ab" * 400 + " " * 90 + "é" * 100]
    texts += ["".join(rnd.choice("aetht on \n.éin😀日A") for _ in range(rnd.randrange(100))) for _ in range(200)]
    for text, coded in zip(texts, matcher.encode(texts)):
        ids = [int.from_bytes(coded[i : i + 4], "little") for i in range(0, len(coded), 4)]
        assert ids == sp.encode(text)
        assert matcher.decode(ids) == sp.decode(ids) == text.replace("▁", " ")


def test_unigram_models_take_the_best_sum():
    import numpy as np

    from helixframe.llm.pieces import UNIGRAM, Pieces

    texts = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    scores = np.array([-2.0, -1.5, -1.7, -2.5, -2.2, -2.4, -4.6])
    pieces = Pieces(UNIGRAM, texts, np.arange(1, 8, dtype=np.int32), scores, [], 0, 9, 10, [b""] * 10)
    matcher = sentencepiece_codec.Matcher(pieces)

    def best(text):
        if not text:
            return 0.0, []
        options = []
        for n in range(1, min(3, len(text)) + 1):
            if text[:n] in texts:
                s, ids = best(text[n:])
                options.append((s + scores[texts.index(text[:n])], [texts.index(text[:n]) + 1, *ids]))
        if text[0] not in texts:
            s, ids = best(text[1:])
            options.append((s + scores.min() - 10, [0, *ids]))
        return max(options)

    words = ["▁aba", "▁bab", "▁abacab", "▁" + "ab" * 6]
    for w, coded in zip(words, matcher.encode_words(words)):
        ids = [int.from_bytes(coded[i : i + 4], "little") for i in range(0, len(coded), 4)]
        total = sum(scores[i - 1] if i else scores.min() - 10 for i in ids)
        assert total == pytest.approx(best(w)[0])


def test_round_trip_of_a_table(spark, docs):
    done = sentencepiece_codec.round_trip(docs)
    assert done.count() == len(DOCS) and done.filter("not exact").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x")], "doc_id bigint, text string")
    coded = sentencepiece_codec.encode_texts(odd)
    assert [len(r.piece_ids) for r in coded.orderBy("doc_id").collect()] == [0, 0, 1]
    back = sentencepiece_codec.decode_ids(spark.createDataFrame([(None,), ([],), ([3 + 0xFF],)], "piece_ids array<int>"))
    assert sorted((r.decoded for r in back.collect()), key=repr) == sorted([None, "", "�"], key=repr)


# warc

PAGES = [(i, f"http://h/{i}?q=a b%\n" if i % 2 else None, "p" * (50 + 60 * (i % 3)) + "é" * (i % 2)) for i in range(20)] + [(50, "u", None), (51, "u", ""), (52, "u", "x" * 99), (53, "u", "x" * 99), (54, "u", "x" * 100), (55, "u", "x" * 100)]


def test_encoding_that_is_checked(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Some  text\n\u2581 \u65e5\u672c"), (2, ""), (3, None)], "doc_id bigint, text string")
    done = sentencepiece_codec.encode_texts(df, check=True)
    assert done.columns == ["doc_id", "text", "piece_ids"] and [len(r.piece_ids) > 0 for r in done.orderBy("doc_id").collect()] == [True, False, False]
    bad = sentencepiece_codec.Matcher(load_pieces())
    bad.decode_lists(np.zeros(0, np.int64), np.zeros(1, np.int64))
    data, begin, sizes = bad.surface
    bad.surface = data, begin, sizes // 2
    monkeypatch.setattr(sentencepiece_codec, "_matcher", lambda df, model_file: spark.sparkContext.broadcast(bad))
    with pytest.raises(Exception, match="do not give back the text 'Some"):
        sentencepiece_codec.encode_texts(df, check=True).collect()


def test_merging_is_the_plain_way():
    """Against a merger that looks at all neighbours for the best rank, leftmost first, one at a time."""
    p = load_pieces()
    rank = {t: -s for t, s in zip(p.texts, p.scores)}
    number = dict(zip(p.texts, p.ids.tolist()))

    def plain(word):
        symbols = list(word)
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = ["".join(symbols[best[1] : best[1] + 2])]
        return [i for s in symbols for i in ([number[s]] if s in number else [p.bytes_[x] for x in s.encode()])]

    rnd = random.Random(12)
    words = ["\u2581" + "".join(rnd.choice("aeinrstlh\u00e9\u65e5\U0001f600zq'-") for _ in range(rnd.randrange(1, 90))) for _ in range(300)]
    for word, coded in zip(words, sentencepiece_codec.Matcher(p).encode_words(words)):
        assert np.frombuffer(coded, "<i4").tolist() == plain(word)


@pytest.mark.parametrize("archive, broadcast", [(10**7, 1000), (900, 0)])
def test_warc_round_trip(spark, tmp_path, archive, broadcast):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), archive_bytes=archive, broadcast_digests=broadcast)
    back = warc.read_warc(spark, str(tmp_path / "w"), payloads=True)
    same(back, "page_id url payload_bytes payload_digest record_type refers_to", brute.warc(PAGES))
    html = {p: h for p, _, h in PAGES}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in back.filter("record_type = 'response'").collect())
    files = glob.glob(str(tmp_path / "w/part-*"))
    assert (len(files) > 3) == (archive < 1000)
    data = open(files[0], "rb").read()
    import zstandard

    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes.fromhex("5d2a4d18")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data, read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n")


def test_warc_rejects_what_is_damaged():
    html = b"<p>" + b"x" * 200
    rec = warc.record(1, "http://h/", html, len(html), hashlib.sha256(html).hexdigest(), None, False)
    assert warc.parse_record(rec)["payload"] == html
    frames = b"".join(warc.write_frames(iter([rec, rec])))
    assert list(warc.read_frames(frames)) == [rec, rec]
    for bad in (rec.replace(b"xxx", b"xxy", 1), rec[:-1], rec.replace(b"WARC/1.1", b"WARC/9"), rec.replace(b"Content-Length: 2", b"Content-Length: 3"), rec.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (frames[:-3], frames + b"\n", b"junk junk junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(bad))


def test_warc_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "y" * 200), (4, "u", "y" * 200), (4, "v", "y" * 200), (9, "u", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    assert got(warc.read_warc(spark, str(tmp_path / "w")), "page_id", "record_type", "refers_to") == sorted([(4, "response", None), (4, "response", None), (9, "revisit", 4), (None, "revisit", 4)], key=repr)


def test_warc_ids_that_are_text(spark, tmp_path):
    rows = [("b <1>%", "u", "y" * 200), ("a null", None, "y" * 200), ("null", "u", "z"), (None, "u", "q")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert got(warc.warc_round_trip(df), "page_id", "record_type", "refers_to") == sorted([("b <1>%", "revisit", "a null"), ("a null", "response", None), ("null", "response", None), (None, "response", None)], key=repr)


# chat

TURNS = [
    (1, 0, "system", "be <<SYS>> [INST] \\ kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "<s>ok\\</s>é😀"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "twice"),
    (2, 0, "tool [/ROLE]", "x"), (2, 1, None, "y"), (2, 2, "assistant", "<</SYS>>\\\\n [/INST]"), (None, 0, "user", "lost"), (3, 7, "assistant", "a" * 120_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    segments = chat.chat_segments(df).cache()
    same(chat.read_back(segments), "conv_id n_turns turns_sha256 loss_chars loss_sha256", brute.chat(TURNS))
    for r in chat.chat_examples(segments).filter("conv_id is not null").collect():
        codec = chat.load_codec(spark)
        under = [i for i, m in zip(r.input_ids, r.loss_mask) if m]
        learnt = "".join(t or "" for c, _, role, t in TURNS if c == r.conv_id and role == "assistant")
        assert len(r.input_ids) == len(r.loss_mask) and chat.unescape(codec.decode(under).decode()) == learnt
        assert r.input_ids[0] == codec.mark("<s>")
    closing = chat.chat_segments(df, learn_close=True).agg(F.sum(F.col("loss_end") - F.col("loss_start"))).first()[0]
    assert closing == segments.agg(F.sum(F.col("loss_end") - F.col("loss_start"))).first()[0] + sum(r == "assistant" for _, _, r, _ in TURNS)


def test_long_texts_are_one_segment(spark):
    """The ids of a text don't depend on its length, and ids of conversations may be strings."""
    text = "".join(f"word{k} der  Löwe\n" for k in range(9000))  # 180,000 characters
    codec = chat.load_codec(spark)
    ids = codec.encode(text)
    cut = text.index("word5000")
    assert ids == codec.encode(text[: cut - 1]) + codec.encode(text[cut - 1 :]) and len(text) > 150_000
    df = spark.createDataFrame([("c", 1, "assistant", text), ("c", 0, "user", None), ("b", 0, "assistant", "x")], "conv_id string, turn bigint, role string, text string")
    segments = chat.chat_segments(df)
    assert [r.ids for r in segments.filter("conv_id = 'c' and position = 1").collect()] == [[*ids, codec.mark("</s>")]]
    same(chat.read_back(segments), "conv_id n_turns turns_sha256 loss_chars loss_sha256", brute.chat([tuple(r) for r in df.collect()]))


def test_a_conversation_with_most_of_all_turns(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)] + [(k, 0, "user", "x") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    same(chat.format_and_read(df), "conv_id n_turns turns_sha256 loss_chars loss_sha256", brute.chat(rows))


def test_escaping_is_reversible_and_hides_marks():
    rnd = random.Random(4)
    bits = [*chat.CONTROLS, "\\", "<", "s", ">", "[", "/", "INST", "]", "<<", "SYS", "é", " "]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROLS)


def test_chat_of_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 0, "user", "a")]
    done = chat.read_back(chat.chat_segments(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert done.n_turns == 4 and done.loss_chars == 1


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><article>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><div class="cookie-notice"><p>Cookies!</p></div>
<div class="%s"><h1>Title %d</h1><p>First &amp; <b>bold</b>&nbsp;text<br>second %d line</p><!-- <p>no</p> --><div class="ad">Buy</div><p>Third <i>one</i>
 goes on %d</p><ul><li>x</li><li>y</li></ul><form><input><p>Mail?</p></form><section class="comments"><p>First!</p></section></div>
<aside class="sidebar"><p>Other things that are here on every page and quite long too, longer than the rest</p></aside><footer>&copy; us</footer></body>"""
BODY = "Title {0}\nFirst & bold text\nsecond {0} line\nThird one goes on {0}\nx\ny"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_html_extraction(spark, broadcast):
    rows = [(i, "https://Host.example/%d" % i, PAGE % ("text", i, i, i)) for i in range(5)] + [(i, "http://u@two.example:80/", PAGE.replace('<div class="%s">', '<article class="%s">') % ("x", i, i, i)) for i in range(5, 7)]
    rows += [(10, None, None), (11, "http://h/", ""), (12, "http://h/", "plain <b>text"), (13, "https://host.example/x", "<html><body><p>Unlike the others")]
    done = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), broadcast_chars=broadcast).collect()}
    for i in range(7):
        assert done[i].text == BODY.format(i), i
    assert [done[i].text for i in (10, 11, 12, 13)] == ["", "", "plain text", "Unlike the others"]
    assert all(r.n_chars == len(r.text) for r in done.values())


def test_wrappers_have_optional_and_repeated_groups_and_slots():
    from helixframe.llm.wrapper import Node, combine

    one = wrap(parse("<body><div><p>a</p><p>b</p></div><footer>f</footer></body>"))
    two = wrap(parse("<body><div><h1>t</h1><p>c</p></div><footer>f</footer></body>"))
    both = combine(one, two)
    assert both.expression() == "<#page>(<body>(<div>(#p+ #h1?) <footer>(##text)))" or both.expression() == "<#page>(<body>(<div>(#h1? #p+) <footer>(##text)))"
    div, footer = both.children[0].children
    assert next(c for c in div.children if c.sign == "p").variable and not footer.children[0].variable and both.pages == 2
    assert Node.of(both.plain()).expression() == both.expression()
    assert main_box(both).path == ("body", "div")


def test_anchors_are_a_longest_common_subsequence():
    from helixframe.llm.wrapper import anchors

    rnd = random.Random(8)
    for _ in range(200):
        a, b = (rnd.sample(range(12), rnd.randrange(12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = anchors(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@pytest.mark.parametrize("parts", [1, 5])
def test_the_wrapper_tells_what_words_do_not(spark, parts):
    """No telling name: notices that stand first and last on every page go, what changes stays; so does a box whose class only sounds apart."""
    rnd = random.Random(6)
    words = lambda k: " ".join(f"w{rnd.randrange(500)}" for _ in range(k))
    rows, want = [], {}
    for i in range(20):
        blocks = [words(30) for _ in range(rnd.randrange(1, 6))]
        inner = "".join(f"<p>{x}</p>" for x in blocks)
        rows.append((i, "http://plain.example/", f"<body><div><p>Top of every page</p></div><div><p>All rights are reserved here and so on</p>{inner}<p>Written with care, every day</p></div><div>End</div></body>"))
        price = words(8)
        rows.append((100 + i, "http://price.example/", f"<body><div class='content'><p>{blocks[0]}</p><div class='share-price'>{price}</div><div class='share'>Share this page with others</div></div></body>"))
        want |= {i: "\n".join(blocks), 100 + i: f"{blocks[0]}\n{price}"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
    assert {r.page_id: r.text for r in html_extract.extract_pages(df).collect()} == want


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(i, "http://copies.example/", "<body><div><p>One text, many times</p><p>and more</p></div></body>") for i in range(30)]
    done = html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4))
    assert {r.text for r in done.collect()} == {"One text, many times\nand more"}


def test_boxes_nested_by_the_thousand(spark):
    deep = "<div>" * 10_000 + "<article><p>deep down</p></article>" + "</div>" * 10_000
    rows = [(1, "http://h/", deep), (2, "http://h/", deep.replace("deep", "as deep")), (3, "http://h/", "<body>" + "<div class=x><p>a</p>" * 3000)]
    done = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert done[1] == "deep down" and done[2] == "as deep down" and done[3].startswith("a")


def test_pages_of_a_host_with_names_of_their_own(spark):
    slug = lambda *k: "-".join("x" + "".join(chr(97 + int(d)) for d in str(x)) for x in k)
    about = "<div class='about'><p>%s</p></div>" % ("What this site is about, on every page. " * 3)
    rows, want = [], {}
    for i in range(400):
        parts = [f"Part {k} of page {i}" for k in range(6)]
        inner = "".join(f"<section class='{slug(i, k)}'><p>{t}</p></section>" for k, t in enumerate(parts))
        # pages whose article is marked as such, and pages where only the texts of other pages tell it apart
        body, want[i] = (f"<article class='{slug(i)}'>{inner}</article>", "\n".join(parts)) if i % 2 else (f"<div class='{slug(i)}'><p>Words of {i} alone</p></div>", f"Words of {i} alone")
        rows.append((i, "http://large.example/", f"<body><div class='slogan'><p>Slogan</p></div>{about}{body}</body>"))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in html_extract.extract_pages(df).collect()} == want


def test_cut_off_and_empty_pages():
    assert html_extract.extract("<article><p>one<p>two</p><div cla") == "one\ntwo"
    assert html_extract.extract("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    host = html_extract.Host(parse("<body><div><p>y</p></div><article><p>z</p></article></body>"))
    assert host.box.path == ("body", "article")
    assert html_extract.extract("<body><div><p>x</p></div><article></article></body>", host) == ""
    assert html_extract.extract("<body><div><p>x</p></div></body>", host) == "x"


@pytest.mark.parametrize(
    "sign, out",
    [("nav", True), ("div|class=ad", True), ("div|class=content with-sidebar", False), ("div|class=article-sidebar", True), ("article|class=comment", True), ("article|class=post sidebar-left", False), ("div|class=shadow header_no-ads", True), ("div|class=download", False), ("body|class=has-header footer", False), ("section|id=comments", True), ("div|role=navigation", True), ("div|class=content-no-ads", False)],
)
def test_boxes_that_stand_apart(sign, out):
    from helixframe.llm.wrapper import apart

    assert apart(sign) is out


# all


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for df in (
        quality.quality_report(no_docs), quality.quality_filter(no_docs), line_dedup.line_dedup_report(no_docs), substring_dedup.substring_dedup_report(no_docs), simhash.simhash_components(no_docs), simhash.simhash_dedup(no_docs),
        lm_score.lm_scores(no_docs), sentencepiece_codec.round_trip(no_docs), decontaminate.decontamination_report(no_docs, items), html_extract.extract_pages(pages), warc.warc_round_trip(pages), chat.format_and_read(turns),
    ):
        assert df.count() == 0


def test_columns_of_the_operators_names_come_back(spark, docs):
    """Callers may have columns of any name, those that operators use for themselves too."""
    from helixframe.llm import jaccard

    names = ["__id", "__hash", "__hits", "__n_hit", "__lines", "__lost", "__source", "__m", "__host", "__docs", "__kept", "__key", "__t", "__spans", "__text"]
    df = docs.select("doc_id", "text", F.lit("s").alias("source"), *[(F.col("doc_id") + k).alias(n) for k, n in enumerate(names)])
    items = spark.createDataFrame([(1, DOCS[-1][1])], "item_id bigint, text string")
    for done in (quality.quality_filter(df), line_dedup.line_dedup(df), decontaminate.decontaminate(df, items, mode="both"), simhash.simhash_dedup(df), jaccard.near_dedup(df), substring_dedup.substring_dedup(df), sentencepiece_codec.encode_texts(df).drop("piece_ids")):
        assert done.columns == df.columns
        rows = done.collect()
        assert rows and all(r[n] == r.doc_id + k for r in rows for k, n in enumerate(names))


def test_a_benchmark_without_items(spark, docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontamination_report(docs, items).filter("contaminated or n_hit > 0").count() == 0
