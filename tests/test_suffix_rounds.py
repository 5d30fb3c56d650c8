"""Suffix arrays of texts with long repeats, with open positions sent to the ranks that they ask for, and joined."""

import random

import pytest

from helixframe.operators import suffix

RND = random.Random(41)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_long_repeats(spark, monkeypatch, sent):
    monkeypatch.setattr(suffix, "SENT", sent)
    part = "".join(RND.choice("ACGT") for _ in range(700))
    seqs = [part + "A" * 300, part, "".join(RND.choice("ACGT") for _ in range(50)) + part]
    rows = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_id bigint, name string, seq string")
    _, sa = suffix.sa_of_text(rows, two_strands=False)
    text = "".join(s + "$" for s in seqs)
    assert [r.pos for r in sa.orderBy("rank").collect()] == sorted(range(len(text)), key=lambda i: text[i:])
