"""Fragments that very many k-mers share: pairs are those of brute force, and no key brings too many together."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.alphabet import Alphabet
from helixframe.operators import neighbors

RND = random.Random(29)


def around(k: int, changes: int, letters: str = "ACGT", extra: int = 60) -> list[str]:
    """A run of one letter with every so many changes, some random ones and some with unknown symbols."""
    out = {"A" * k}
    for _ in range(changes):
        out |= {s[:i] + c + s[i + 1 :] for s in out for i in range(0, k, 2) for c in letters[:3]}
    out |= {"".join(RND.choice(letters) for _ in range(k)) for _ in range(extra)}
    out |= {s[:i] + "N" + s[i + 1 :] for s, i in zip(sorted(out), [RND.randrange(k) for _ in range(40)])}
    return sorted(out)


def distance(a: str, b: str) -> int:
    return sum(x != y or x == "N" for x, y in zip(a, b))


def table(spark, found):
    return spark.createDataFrame([(s,) for s in found], "kmer string").cache()


@pytest.mark.parametrize("k, tau, shared, bound", [(14, 2, 1, 400), (13, 2, 2, 100), (16, 3, 1, 900), (7, 3, 1, 4), (5, 3, 2, 1), (35, 2, 1, 300)])
def test_pairs_do_not_depend_on_the_bound(spark, monkeypatch, k, tau, shared, bound):
    monkeypatch.setattr(neighbors, "KEY_PAIRS", bound)
    found = around(k, 2 if k < 20 else 1)
    if len(found) > 400:
        found = sorted(RND.sample(found, 400))
    kmers = table(spark, found)
    got = [(r.a, r.b, r.dist) for r in neighbors.hamming_join(kmers, kmers, k, tau, below=True, shared=shared).collect()]
    assert len(set(got)) == len(got)
    assert sorted(got) == sorted((a, b, distance(a, b)) for i, a in enumerate(found) for b in found[i + 1 :] if distance(a, b) <= tau)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_two_tables(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbors, "KEY_PAIRS", 200)
    monkeypatch.setattr(neighbors, "SENT_KEYS", sent)
    found = around(12, 2)
    one, two = found[: 2 * len(found) // 3], found[len(found) // 3 :]
    got = neighbors.hamming_join(table(spark, one), table(spark, two).withColumnRenamed("kmer", "other"), 12, 2, "kmer", "other")
    assert sorted((r.a, r.b, r.dist) for r in got.collect()) == sorted((a, b, distance(a, b)) for a in one for b in two if distance(a, b) <= 2)


def test_no_key_stands_over_the_bound(spark, monkeypatch):
    """What each join brings together, by key."""
    monkeypatch.setattr(neighbors, "KEY_PAIRS", 2500)
    kmers = table(spark, around(24, 2))
    sizes = []
    real = neighbors._hot

    def looked(one, two, keys):
        hot, size = real(one, two, keys)
        cold = one.join(hot, keys, "left_anti") if size else one
        sizes.append((one.groupBy(*keys).count().agg(F.max("count")).first()[0], cold.groupBy(*keys).count().agg(F.max("count")).first()[0]))
        return hot, size

    monkeypatch.setattr(neighbors, "_hot", looked)
    neighbors.hamming_join(kmers, kmers, 24, 2, below=True).count()
    assert len(sizes) > 2 and sizes[0][0] ** 2 > 4 * 2500  # the run's fragments are hot, and what is left of them is cut more than once
    assert all(cold is None or cold * cold <= 2500 for _, cold in sizes)
    assert sizes[-1][0] * sizes[-1][0] <= 2500


def test_empty_tables_and_an_alphabet_without_an_unknown_symbol(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "KEY_PAIRS", 20)
    none = table(spark, [])
    assert neighbors.hamming_join(none, none, 10, 2, below=True).count() == 0
    binary = Alphabet(("0", "1"), ("01", "10"), 1)
    found = sorted({format(i, "010b") for i in range(0, 1024, 9)})
    kmers = table(spark, found)
    got = neighbors.hamming_join(kmers, kmers, 10, 2, alphabet=binary, below=True)
    unknown = binary.unknown
    far = lambda a, b: sum(x != y or x == unknown for x, y in zip(a, b))
    assert sorted((r.a, r.b, r.dist) for r in got.collect()) == sorted((a, b, far(a, b)) for i, a in enumerate(found) for b in found[i + 1 :] if far(a, b) <= 2)
