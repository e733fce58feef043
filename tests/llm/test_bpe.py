from __future__ import annotations

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wareflow.llm import bpe

PATH = bpe.default_path()
OURS = bpe.ByteBpe(bpe.read_spec(PATH))
THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "日", "😀", "\x1c", "\x85", "²", "½", "٣", "<|endoftext|>", "<|", "1", "!!", "aaaa", "ÃÂ", "-" * 9, "́", "​", "　", "the ", "ing", "\r", "\x00"]


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_same_ids_and_round_trip(text):
    ids = OURS.encode(text).tolist()
    assert ids == theirs(text)
    assert OURS.decode(ids) == text == THEIRS.decode(ids, skip_special_tokens=False)


def test_long_words_and_runs():
    for text in ("a" * 20_000, "ab" * 9_000, "é" * 5_000, " " * 5_000, "x " * 5_000, "日本" * 3_000):
        assert OURS.encode(text).tolist() == theirs(text)


def test_the_automaton_has_one_path_a_string():
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"aab", 4: b"ba"}
    machine = bpe.MergeAutomaton(labels, [(0, 0, 2), (2, 1, 3), (1, 0, 4)])
    for n in range(1, 9):
        for k in range(2**n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            ids = [b"ab".index(c) for c in word]
            for u, v, w in ((0, 0, 2), (2, 1, 3), (1, 0, 4)):
                i = 0
                while i + 1 < len(ids):
                    if (ids[i], ids[i + 1]) == (u, v):
                        ids[i : i + 2] = [w]
                    i += 1
            assert machine.encode(word) == ids


def test_one_look_up_a_byte_and_no_step_back():
    machine = bpe.ByteBpe(bpe.read_spec(PATH)).machine
    asked = []

    class Counted(dict):
        def get(self, key):
            asked.append(key & 255)
            return super().get(key)

    machine.table = Counted()
    for word in (b" tokenization", b"unhappinesses", b"zzzzzzzzzz", "\u65e5\u672c\u8a9e".encode(), b"xyxyqqqqthethe", b" tokenization"):
        asked.clear()
        assert machine.encode(word) == theirs(word.decode())
        assert bytes(asked) == word


def test_a_full_table_starts_anew():
    machine = bpe.ByteBpe(bpe.read_spec(PATH), kept=20).machine
    for word in ("alpha beta gamma delta epsilon unhappinesses " * 3).split():
        assert machine.encode(word.encode()) == theirs(word)
        assert len(machine.table) <= 20 + len(word)


def test_forgetting_changes_nothing():
    small = bpe.ByteBpe(bpe.read_spec(PATH), kept=4)
    text = "one two three four five six seven, one two! three? four's"
    assert small.encode(text).tolist() == small.encode(text).tolist() == theirs(text)


def test_columns(spark, sf_dir):
    rows = spark.createDataFrame([(1, "hi there", 5), (2, "", 6), (3, None, 7), (1, "hi there", 5)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(rows, PATH), PATH).select("doc_id", "ids", *bpe.digests(rows.withColumn("decoded", F.lit("")))).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [theirs("hi there")] * 2 + [[], []]
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got][2:] == [(0, empty, empty)] * 2
    assert bpe.encode(rows.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.query(spark, sf_dir).collect():
        ids = theirs(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
