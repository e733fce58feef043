"""Tree encoding against the tiktoken library, and the monoid's laws."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from wareflow.llm import monoid

RAW = monoid.read_ranks(monoid.default_path())
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = monoid.RankBpe(RAW)
PIECES = ["the", "tion", "'s", "'re", " ", "  ", "\n", "\t", "0", "12", "ä", "日本", "한", "привет", "العربية", "😀", "́", "…", "<|endoftext|>", "=", "-", "a", "b", " \n", " ", " ", "\x1c"]


@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = BPE.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.spell(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_001, "=" * 33_333, "日" * 9_999, " " * 7_000 + "x", "".join(random.Random(1).choices("abcdefghij", k=100_000)), "word " * 30_000])
def test_long_words_and_texts(text):
    assert BPE.encode(text).tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(4))
def test_wherever_a_word_is_cut_the_parts_join_to_the_whole(seed):
    rng, tokens, tree = random.Random(seed), [t for t in RANKS if len(t) > 1], BPE.machine
    for _ in range(300):
        word = b"".join(rng.choices(tokens, k=rng.randint(1, 8)))
        whole = tree.merged(word)
        assert whole == tree._merged_long(word) == tree.tree(word)
        a, b = sorted(rng.randint(0, len(word)) for _ in range(2))
        parts = [tree.merged(word[:a]), tree.merged(word[a:b]), tree.merged(word[b:])]
        assert tree.joined(tree.joined(parts[0], parts[1]), parts[2]) == whole == tree.joined(parts[0], tree.joined(parts[1], parts[2]))


def test_a_seam_may_change_everything_behind_it():
    tree = monoid.TreeEncoder({bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257})
    assert tree.joined(tree.merged(b"a" * 33), tree.merged(b"a" * 32)) == tree.merged(b"a" * 65)


def test_tables_of_ranks_that_no_training_makes():
    """Ranks in any order, words reached in several ways: the proof needs none of that."""
    rng = random.Random(7)
    for _ in range(60):
        words = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)}
        order = [*words]
        rng.shuffle(order)
        tree = monoid.TreeEncoder({bytes([b]): 10_000 + b for b in range(256)} | {w: i for i, w in enumerate(order)})
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 60)))
            assert tree.tree(word) == tree.merged(word) == tree._merged_long(word)


def test_every_byte_needs_a_token():
    with pytest.raises(ValueError, match="no token for bytes"):
        monoid.TreeEncoder({b"a": 0})


def test_frames_keep_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, decoded string")
    path = monoid.default_path()
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in monoid.decode(monoid.encode(rows, path), path).collect())
    ids = LIBRARY.encode_ordinary("a b")
    assert got == [(1, [], b""), (2, [], b""), (3, ids, b"a b"), (3, ids, b"a b")]
    assert monoid.encode(rows.limit(0), path).count() == 0


def test_query_equals_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = monoid.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
