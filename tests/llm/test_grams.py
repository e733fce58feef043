from __future__ import annotations

import re

import numpy as np
import pytest
from wareflow.llm import langid, subword


def by_hand(text, n):
    """The n-grams of each word with a space on either side, one for each place."""
    padded = " " + re.sub(r"[ \t-\r]", " ", text) + " "
    return [padded[k : k + n] for k in range(len(padded) - n + 1) if " " not in padded[k + 1 : k + n - 1]]


def hashed(gram, shape):
    h = np.zeros(1, np.uint32)
    for c in gram:
        h = (h + np.uint32(ord(c))) * np.uint32(0x01000193) ^ (h >> np.uint32(15))
    return int((h * np.uint32(0x9E3779B1) >> np.uint32(32 - (shape.buckets.bit_length() - 1)))[0])


@pytest.mark.parametrize("text", ["plain words here", "\u00e9\u00e8 \u65e5\u672c\u8a9e \U0001f600x", "a", "", "  two\t\nspaces  ", "x" * 40])
def test_grams_are_of_characters_within_words(text):
    shape = subword.Shape(lower=False)
    got = subword._grams(text, shape)
    for n, found in zip(shape.grams, got, strict=True):
        assert sorted(found.tolist()) == sorted(hashed(g, shape) for g in by_hand(text, n))


def test_lowering_and_blocks(monkeypatch):
    shape = subword.Shape(lower=True)
    assert [x.tolist() for x in subword._grams("AbC d", shape)] == [x.tolist() for x in subword._grams("aBc D", shape)]
    monkeypatch.setattr(subword, "BLOCK", 7)
    for text in ("one two three four", "x" * 30, "\u65e5" * 20, "a b"):
        assert "".join(subword.blocks(text)) == text and all(len(b) <= 7 for b in subword.blocks(text))


def test_rejection_is_learned_and_taken(spark):
    """Where labels are drawn by lot for a part of the texts, that part is rejected and the clear part is not."""
    rng = np.random.default_rng(2)
    words = {"aa": ["rovan", "silte", "morun", "kaveh"], "bb": ["zixo", "qupty", "wyxar", "jexil"], "??": ["lomo", "nine", "tutu", "pepe"]}
    rows = []
    for k in range(900):
        kind = ("aa", "bb", "??")[k % 3]
        text = " ".join(rng.choice(words[kind], 12))
        rows.append((k, text, kind if kind != "??" else str(rng.choice(["aa", "bb"]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 600"))
    late = langid.identify(docs.where("doc_id >= 600"), model).toPandas()
    unclear = late["doc_id"] % 3 == 2
    assert late[unclear]["rejected"].mean() > 0.9 and late[~unclear]["rejected"].mean() < 0.05
    assert (late[~unclear]["lang_pred"] == late[~unclear]["lang"]).mean() > 0.98
