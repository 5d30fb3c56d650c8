"""Mixing, spelling variants and hard negatives against plain versions, on nulls, repeats, ties and hostile names too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives as hn
from helixframe.llm import mixing, spelling

# mixing

MIX = "doc_id bigint, text string, source string, hash string, row int"


def mix_rows(seed=3):
    rnd = random.Random(seed)
    text = lambda n: " \t".join(f"w{rnd.randrange(99)}" for _ in range(n))
    rows = [(k, text(rnd.randrange(0, 40)), "hot") for k in range(300)]
    rows += [(1000 + k, text(rnd.randrange(0, 9)), rnd.choice(["a", "Z", "é", ""])) for k in range(80)]
    rows += [(2000 + k, text(5), None) for k in range(9)]
    rows += [(3000, "same words here", "copies")] * 50 + [(3001, "x", "copies")]
    rows += [(None, "no id at all", "a"), (None, None, "a"), (7, "", "empty"), (7, None, "empty"), (1, "a repeated id", "hot")]
    return [(*r, "h", 1) for r in rows]


def plain_mix(rows, cap=3):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    digest = lambda r: int(hashlib.md5("\x1f".join(str(x) for x in (r[0], r[2], r[1]) if x is not None).encode()).hexdigest()[:15], 16)
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += words(r[1])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, left = set(), sum(size.values())
    while True:
        heavy = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * left / heavy > cap * size[s]}
        if not over:
            break
        capped |= over
        left -= sum(cap * size[s] for s in over)
    target = {s: float(cap * size[s]) if s in capped else weight[s] * left / heavy for s in names}
    out = []
    for s in names:
        mine = sorted((r for r in rows if r[2] == s), key=digest)
        full = min(int(target[s] // size[s]), cap) if size[s] else 0
        rest, below = target[s] - full * size[s], 0
        for r in mine:
            n = words(r[1])
            copies = full + (rest - below >= n / 2 if n else rest > below)
            below += n
            out.append((r[0], n, size[s], target[s], n * copies))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits, few", [(12, 100), (7, 0)])
def test_mixing(spark, bits, few):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, MIX).repartition(5)
    done = mixing.mix_report(docs, bits=bits, broadcast_sources=few).collect()
    assert sorted([tuple(r[:5]) for r in done], key=repr) == [(*r[:3], pytest.approx(r[3], rel=1e-12), r[4]) for r in plain_mix(rows)]
    largest, taken = defaultdict(int), defaultdict(int)
    for r in done:
        assert r.taken <= 3 * r.size
    by_target = defaultdict(list)
    for r in done:
        by_target[r.target, r.source_size].append(r)
    for (target, _), group in by_target.items():
        largest, taken = max(r.size for r in group), sum(r.taken for r in group)
        assert abs(taken - target) <= largest / 2 or len({r.doc_id for r in group}) < 2 or largest == 0


def test_mix_gives_rows_as_often_as_they_are_taken(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, MIX)
    mixed = mixing.mix_sources(docs.repartition(3))
    assert mixed.columns == docs.columns
    again = mixing.mix_sources(docs.repartition(7))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mixed) == key(again)
    words = sum(len(re.findall(r"\S+", r.text or "")) for r in mixed.collect())
    assert words == sum(r[4] for r in plain_mix(rows))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], MIX)
    assert mixing.mix_report(none).count() == mixing.mix_sources(none).count() == 0
    empty = spark.createDataFrame([(1, None, None, "", 0), (2, " ", None, "", 0)], MIX)
    assert [tuple(r) for r in mixing.mix_report(empty).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    with pytest.raises(ValueError):
        mixing.mix_report(none, weights=()).count()


# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_forms(counts):
    near = {w: sorted((x for x in counts if one_edit(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: n[0] if n and counts[n[0]] >= 2 * counts[w] else None for w, n in near.items()}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def word_list(seed, n=400):
    rnd = random.Random(seed)
    alphabet, words = "abÀé", set()
    while len(words) < n:
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(5, 9)))
        words |= {w, w[: (k := rnd.randrange(len(w)))] + rnd.choice(alphabet) + w[k:], "aaaaa" + w[:2]}
    return {w: 3 + int(rnd.paretovariate(0.6)) % 10_000 for w in sorted(words)}


@pytest.mark.parametrize("q, shard", [(3, 2000), (3, 5), (5, 40)])
def test_forms(spark, q, shard):
    counts = word_list(q * shard)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    done = spelling.spelling_forms(words, q=q, shard=shard).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, done.collect()), key=repr) == plain_forms(counts)


def test_a_pair_is_found_once(spark):
    counts = word_list(8)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = [frozenset((r.a, r.b)) for r in spelling.near_pairs(words, shard=7).collect()]
    assert len(found) == len(set(found)) and set(found) == {frozenset((a, b)) for a in counts for b in counts if a < b and one_edit(a, b)}


def test_words_are_counted_by_contract(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["Alpha", "ALPHA", "beta", "Éclair", "éclair", "x" * 70, "naïve2two", "don't", "l1l"]) for _ in range(rnd.randrange(200))) for _ in range(60)]
    rows = [(k, t, "id", 1) for k, t in enumerate(texts)] + [(None, "alpha alpha gamma gamma gamma", "", 2), (3, None, "", 3), (3, "", "", 3), (5, texts[5], "", 0), (9, "y" * 200_000, "", 0)]
    want = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, n int").repartition(4)
    got = {r.word: r.n for r in spelling.word_counts(docs, drop_every=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.word_counts(docs).filter("word = 'alpha'").first().n == len(re.findall(r"(?i)\balpha\b", " ".join(r[1] or "" for r in rows)))


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(none, drop_every=97).count() == 0
    alone = spark.createDataFrame([(1, "lonely lonely lonely")], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.spelling_variants(alone).collect()] == [("lonely", None, "lonely", 3, 0, None)]


# hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, row int, q string"


def vector_rows(n=500, dim=6, seed=1, spread=1.0):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(5, dim)) * spread
    rows = [(k, (centers[k % 5] + rnd.normal(size=dim) * 0.3).tolist(), int(rnd.integers(0, 4)), 0, "q") for k in range(n)]
    same = rows[3][1]
    rows += [(n + k, same, k % 3, 0, "q") for k in range(80)]  # a vector that many rows have
    odd = [(None, same, 1), (700, None, 1), (701, same, None), (702, [1.0, float("nan")], 1), (703, [1.0, None], 1), (704, [float("inf")], 1), (705, [0.5, 0.25], 1), (706, [], 2), (100, same, 2), (100, same, 1)]
    return rows + [(*o, 0, "q") for o in odd]


def plain_negatives(rows, anchor, scale=256):
    dim = max(len(r[1]) for r in rows if r[1])
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    q = [[int(np.floor(scale * x)) for x in r[1]] + [0] * (dim - len(r[1])) for r in good]
    out = []
    for i, a in enumerate(good):
        if not anchor(a[0]):
            continue
        score = [sum(x * y for x, y in zip(q[i], v)) for v in q]
        order = sorted(range(len(good)), key=lambda j: (-score[j], good[j][0]))
        for p in [j for j in order if j != i and good[j][2] == a[2]][:5]:
            hard = [j for j in order if good[j][2] != a[2] and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out += [(a[0], good[p][0], k + 1, good[j][0], score[p], score[j]) for k, j in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("scale, options", [(256, {}), (256, {"block": 32, "batch_bytes": 1}), (1 << 28, {"block": 100})])
def test_hard_negatives(spark, scale, options):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    done = hn.hard_negatives(df, F.col("id") % 3 == 1, scale=scale, **options)
    assert sorted(map(tuple, done.collect())) == plain_negatives(rows, lambda i: i % 3 == 1, scale)


def test_trees_pass_over_what_is_far(monkeypatch):
    """Well parted clusters: far pairs of leaves are never scored, and the best are the same."""
    rnd = np.random.default_rng(4)
    x = (rnd.normal(size=(4096, 8)) + 60 * np.eye(8)[np.arange(4096) // 8 % 2]).round().astype(np.int64)
    ids, label = np.arange(4096), rnd.integers(0, 3, 4096)
    block = hn._block(ids, ids, label, x)
    a = hn._block(ids[:256], ids[:256], label[:256], x[:256], hn.grow(x[:256], 16))
    tree = hn.BallTree(np.arange(256), a["tree"].depth, a["tree"].centers, a["tree"].radii)
    anchors = hn.Anchors(a["row"], a["label"], a["q"], tree, np.full((256, 1), hn._NONE), np.full((256, 1), np.iinfo(np.int64).max), True, 5)
    scored = []
    plain = hn.products
    monkeypatch.setattr(hn, "products", lambda p, q, *m: (scored.append(len(p) * len(q)), plain(p, q, *m))[1])
    best = hn.Best(anchors.floor.reshape(-1), 5)
    hn.score_block(anchors, best, block)
    first, done = sum(scored), best.cut()
    scored.clear()
    hn.score_block(anchors, hn.Best(best.floor, 5), block)  # with what is known after the first pass
    assert first == 256 * 4096 and sum(scored) < 0.6 * first
    for slot in range(256):
        fits = (a["label"][slot] == label) & (ids != a["row"][slot])
        want = sorted(zip(-(x @ a["q"][slot])[fits], ids[fits]))[:5]
        assert [(-s, i) for _, s, i in done[:, done[0] == slot].T] == want


def test_a_large_batch_is_not_cut_at_every_leaf(monkeypatch):
    """A batch that keeps more than HELD rows sorts them again only when half as many have come in."""
    monkeypatch.setattr(hn, "HELD", 64)
    sorts, plain = [], hn.Best.cut
    monkeypatch.setattr(hn.Best, "cut", lambda self: (sorts.append(1), plain(self))[1])
    rnd = np.random.default_rng(5)
    slot, score, ids = np.repeat(np.arange(100), 40), rnd.integers(0, 500, 4000), np.arange(4000)
    best = hn.Best(np.full(100, hn._NONE), 5)
    order = rnd.permutation(4000)
    for part in np.split(order, 400):  # 500 rows are kept
        best.add(slot[part], score[part], ids[part])
    assert len(sorts) < 40
    done = best.cut()
    for k in range(100):
        want = sorted(zip(-score[slot == k], ids[slot == k]))[:5]
        assert [(-s, i) for _, s, i in done[:, done[0] == k].T] == want


@pytest.mark.parametrize("size", [3, 1 << 13, 1 << 27])
@pytest.mark.parametrize("crowd, part", [(0, 20), (4, 1024), (10**6, 1)])
def test_floors_are_raised_and_nothing_is_lost(monkeypatch, size, crowd, part):
    """Several slots, ties and copies, in each of the types in which products are exact."""
    monkeypatch.setattr(hn, "CROWD", crowd)
    monkeypatch.setattr(hn, "PART", part)
    rnd = np.random.default_rng(6)
    x = rnd.integers(-size, size + 1, (600, 5))
    x[400:] = x[rnd.integers(0, 3, 200)]
    ids, label = rnd.permutation(600), rnd.integers(0, 3, 600)
    assert hn.exact_kind(size, size, 5)[0] == {3: np.float32, 1 << 13: np.float64, 1 << 27: np.int64}[size]
    a = hn._block(ids[:90], ids[:90], label[:90], x[:90])
    tree = hn.BallTree(np.arange(90), a["tree"].depth, a["tree"].centers, a["tree"].radii)
    ceiling = np.sort(a["q"] @ x.T, axis=1)[:, [560, 450, 599]]
    floor = np.stack([ceiling[:, 0] // 4, ceiling[:, 1] + 1, np.full(90, hn._NONE)], axis=1)  # the second slot is closed
    anchors = hn.Anchors(a["row"], a["label"], a["q"], tree, floor, ceiling, False, 7)
    best = hn.Best(floor.reshape(-1), 7)
    for part in np.split(np.arange(600), 3):
        hn.score_block(anchors, best, hn._block(ids[part], ids[part], label[part], x[part]))
    done = best.cut()
    for slot in range(270):
        n, k = divmod(slot, 3)
        score = x @ a["q"][n]
        fits = (label != a["label"][n]) & (score >= floor[n, k]) & (score <= ceiling[n, k])
        assert [(-s, i) for _, s, i in done[:, done[0] == slot].T] == sorted(zip(-score[fits], ids[fits]))[:7]


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(none, F.col("id") % 2 == 0).count() == 0
    bad = spark.createDataFrame([(1, [float("nan")], 1, 0, ""), (2, None, 2, 0, "")], VECTORS)
    assert hn.hard_negatives(bad, F.col("id") > 0).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1, 0, ""), (2, [], 1, 0, ""), (3, [0.5], 2, 0, "")], VECTORS)
    assert hn.hard_negatives(one, F.lit(False)).count() == 0
    assert sorted(map(tuple, hn.hard_negatives(one, F.col("id") == 1).collect())) == []
