"""Texts and pages made to cost much: they take time in proportion to their length, and give what small ones like them give."""

import random
import time

import numpy as np
import pytest

from helixframe.llm import chat, html_extract, sentencepiece_codec, wrapper
from helixframe.llm.pieces import DEFAULT_MODEL, load_pieces


@pytest.fixture(scope="module")
def codec():
    with open(chat.DEFAULT_VOCABULARY, "rb") as f:
        return chat.Codec(f.read())


def test_runs_of_white_space_have_their_ids(codec):
    plain = chat._encoding(codec.vocabulary)[0].encode_ordinary
    rnd = random.Random(1)
    for k in range(200):
        run = [" ", "\n", "\t ", " \n", "　", " \x85", "\x1c "][k % 7]
        text = "ab" * rnd.randrange(3) + "".join(rnd.choice(run) for _ in range(rnd.choice([999, 1000, 1001, 1500])))
        text += rnd.choice(["", "x", "!", "1", "'s", "\x1cq", " y"]) + rnd.choice(["", " " * 1200, "z" + "\n" * 1000 + "q"])
        assert codec.encode(text) == plain(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t"])
def test_two_million_of_white_space(spark, codec, run):
    text = "a" + run * 2_000_000 + "b"
    assert codec.decode(codec.encode(text)).decode() == text
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id bigint, turn int, role string, text string")
    (row,) = chat.format_and_read(turns).collect()
    assert row.n_turns == 2 and row.loss_chars == len(text)


@pytest.mark.parametrize("piece", ["<a '", '<a "', "<!--", "<script>", '<script "', "<![CDATA[>", "<", "<a", "</script ", "&", "<a x='\"", "'\""])
def test_cut_off_tags(piece):
    began = time.perf_counter()
    wrapper.parse("<p>text</p><a '" + piece * (5_000_000 // len(piece)))
    assert time.perf_counter() - began < 60


def test_tags_that_are_not_closed():
    def texts(page):
        out, left = [], [wrapper.parse(page)]
        while left:
            node = left.pop()
            out += node.texts
            left += node.children[::-1]
        return out

    assert texts("<p>one</p><a ' <b>two") == ["one", "<a ' two"]  # no tag, and what follows is read as ever
    assert texts("<p>a <i title='>'>b</i> <i title=\"'\">c</i></p>") == ["a b c"]
    assert texts("<p>x <![CDATA[1 < 2]]> y <![CDATA[ z > w") == ["x 1 < 2 y w"]
    assert texts("<p>a<script '>'>b</script >c<style>d") == ["ac"]
    assert texts("<p>&#" + "9" * 5000 + ";x &#" + "0" * 300 + "65; &#x41;") == ["�x A A"]


def test_a_page_of_a_megabyte_of_quotes(spark):
    page = "<html><body><article><p>What stays.</p></article>" + "<a '" * 250_000
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", "<html><body><article><p>Other.</p></article></body></html>")], "page_id bigint, url string, html string")
    assert {r.page_id for r in html_extract.extract_pages(pages).collect()} == {1, 2}


def test_words_without_end(monkeypatch):
    """A window at a time, whatever the word: as the library's ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    matcher = sentencepiece_codec.Matcher(load_pieces())
    monkeypatch.setattr(sentencepiece_codec, "INDEXED_CHARS", 300)
    rnd = random.Random(3)
    alphabets = ["a", "ab", "abc", "the", "tion", "éaz", "abcdefghijklmnopqrstuvwxyz", "日本語の", "=-", "0123456789", "\t\n", "ѐ̈x"]
    for k in range(120):
        letters, n = alphabets[k % len(alphabets)], rnd.choice([299, 300, 301, 700, 3000])
        text = "".join(rnd.choice(letters) for _ in range(n)) if k % 3 else (letters * n)[:n]
        assert np.frombuffer(matcher.encode([text, "b", text + " x"])[0], "<i4").tolist() == sp.encode(text)


def test_a_million_characters_without_space(monkeypatch):
    sizes = []
    plain = sentencepiece_codec.Matcher.edges
    monkeypatch.setattr(sentencepiece_codec.Matcher, "edges", lambda self, code: (sizes.append(len(code)), plain(self, code))[1])
    matcher = sentencepiece_codec.Matcher(load_pieces())
    text = "x" * 1_000_000
    ids = np.frombuffer(matcher.encode([text])[0], "<i4")
    assert matcher.decode(ids.tolist()) == text and max(sizes) <= sentencepiece_codec.INDEXED_CHARS
