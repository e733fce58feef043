"""Byte-level BPE encoding and decoding through a deterministic tokenization automaton.

The automaton reads token labels.  It starts as one state that loops on the 256 byte labels and grows by one
gadget a merge, in rank order: the merge ``u v -> w`` takes the ``v`` arc away from the state reached by ``u``
(a copy, so that other labels that share the state keep theirs) and adds a ``w`` arc wherever a ``u`` arc is,
leading where ``v`` led.  After the last merge, the label sequences it accepts are exactly the BPE
tokenizations, and each byte string has one.

For encoding it is turned into a table over bytes: a table state is the set of (automaton state, bytes read of a
label's spelling) that a prefix can be in, and a transition goes from state and byte to a state and the one label
by which the prefix can end.  Encoding looks up one transition a byte, never going back, and then reads the
labels off from the last one.  The table's states are made as texts first reach them, since all of them are far
more than texts need; a full table starts anew.  Decoding emits the bytes of the labels.

Automaton states hold only what a copy took away, with the step at which it did; a ``w`` arc exists where the
``u`` arc existed at that step.

Defined cases: null and empty texts have no tokens and decode to the empty text; texts of any length are read
whole; strings of added tokens in a text become those tokens.  Columns of the input are kept; an output column
replaces an input column of the same name.
"""

from __future__ import annotations

import hashlib
import json
import string
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.shared import small_batches

#: How the byte-level pre-tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ASCII that is neither a letter, a digit nor white space.
_MARKS = string.punctuation

#: Chunks whose ids a worker remembers: about 250 bytes each.
KEPT = 900_000
#: Bits of a place in the tree of spellings.
_WIDTH = 32
_PLACE = (1 << _WIDTH) - 1
#: Transitions that a worker's table holds before it starts anew: about 250 bytes each, states included.
MOST_ARCS = 900_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes are themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """The deterministic automaton of a merge list, its labels being token ids."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], most: int | None = None):
        self.labels, self.most = labels, most or MOST_ARCS
        #: By state: the state it was copied from, the step of the copy, and the labels it lost with the step of each.
        self.origin, self.copied_at, self.lost = [-1], [0], [{}]
        #: The state that a label leads to; for a merged label its left part and its step.
        self.leads_to: dict[int, int] = {t: 0 for t, b in labels.items() if len(b) == 1}
        self.left: dict[int, tuple[int, int]] = {}
        # The start leads to the first state as well, which so never loses an arc.
        sharing = {0: len(self.leads_to) + 1}
        for step, (u, v, w) in enumerate(merges):
            target = self.leads_to[v]
            state = self.leads_to[u]
            if sharing[state] > 1:
                sharing[state] -= 1
                self.origin.append(state)
                self.copied_at.append(step)
                self.lost.append({})
                state = self.leads_to[u] = len(self.lost) - 1
                sharing[state] = 1
            self.lost[state][v] = step
            if w in self.leads_to:
                raise ValueError(f"two merges make label {w}")
            # Where v led before this step; with u = v that is the state before the copy lost its arc.
            self.leads_to[w] = target if target != state else self._without_last(state, step)
            sharing[self.leads_to[w]] = sharing.get(self.leads_to[w], 0) + 1
            self.left[w] = (u, step)
        self.known: dict[int, bool] = {}
        self.histories: dict[int, list] = {}
        self.left_parts: dict[int, list] = {}
        self.table: dict[int, int] = {}
        self.shift = (max(labels) + 1).bit_length()
        self._spell()
        self._start()

    def _without_last(self, state: int, step: int) -> int:
        """A state like ``state`` as it was before ``step``."""
        self.origin.append(state)
        self.copied_at.append(step)
        self.lost.append({})
        return len(self.lost) - 1

    def _spell(self) -> None:
        """A tree of the labels' spellings: the node by (node, byte), and the label of each node, if there is one."""
        self.child: dict[int, int] = {}
        self.label_at: list[int] = [-1]
        self.size_of = {t: len(self.labels[t]) for t in self.leads_to}
        for t in self.leads_to:
            node = 0
            for b in self.labels[t]:
                node = self.child.setdefault(node << 8 | b, len(self.label_at))
                if node == len(self.label_at):
                    self.label_at.append(-1)
            self.label_at[node] = t

    def _start(self) -> None:
        """An empty table: its first state stands before any byte.

        A state's members are numbers, automaton state and place in the tree of spellings in one; so is a transition's
        result, the next state and, in the low bits, one more than the label.
        """
        self.number, self.members = {(0,): 0}, [(0,)]
        self.table.clear()

    def has_arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc of ``label``."""
        key = state << 32 | label
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= self.most:
                self.known.clear()
            known = self.known[key] = self._work_out(state, label)
        return known

    def _work_out(self, state: int, label: int) -> bool:
        # The arc was added where the arc of its left part was, and so on down to a byte, which the first state has.
        for lost, before in self._history(state):
            for needed, until in self._parts(label):
                step = lost.get(needed)
                if step is not None and step <= until and step < before:
                    return False
        return True

    def _history(self, state: int) -> list[tuple[dict, int]]:
        """What the state and those it was copied from have lost, and the step until which that counts."""
        found = self.histories.get(state)
        if found is None:
            found, at, before = [], state, 1 << 60
            while at >= 0:
                if self.lost[at]:
                    found.append((self.lost[at], before))
                before = min(before, self.copied_at[at])
                at = self.origin[at]
            self.histories[state] = found
        return found

    def _parts(self, label: int) -> list[tuple[int, int]]:
        """The label and its left parts, and the step until which each had to be there."""
        found = self.left_parts.get(label)
        if found is None:
            found, needed, until = [], label, 1 << 60
            while True:
                found.append((needed, until))
                if needed not in self.left:
                    break
                needed, until = self.left[needed]
            self.left_parts[label] = found
        return found

    def _transition(self, at: int, byte: int) -> int:
        """From table state ``at`` on ``byte``: the next table state, and the label by which a path can end there.

        A full table starts anew, in the middle of a word too, with the state that ``at`` was.
        """
        here = self.members[at]
        if len(self.table) >= self.most:
            self._start()
            at = self.number.setdefault(here, len(self.members))
            if at == len(self.members):
                self.members.append(here)
        going, ended, child = [], -1, self.child.get
        for member in here:
            node = child((member & _PLACE) << 8 | byte)
            if node is not None:
                state = member >> _WIDTH
                going.append(state << _WIDTH | node)
                label = self.label_at[node]
                if label >= 0 and (not state or self.has_arc(state, label)):
                    ended = label
        going.append(self.leads_to[ended] << _WIDTH)
        members = tuple(sorted(going))
        number = self.number.setdefault(members, len(self.members))
        if number == len(self.members):
            self.members.append(members)
        found = self.table[at << 8 | byte] = number << self.shift | ended + 1
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepted path over ``word``: one transition a byte, then the labels from the last one back."""
        look_up, shift, at, ends = self.table.get, self.shift, 0, []
        for byte in word:
            found = look_up(at << 8 | byte)
            if found is None:
                found = self._transition(at, byte)
            ends.append(found)
            at = found >> shift
        path, left, size_of, low = [], len(ends), self.size_of, (1 << shift) - 1
        while left:
            label = (ends[left - 1] & low) - 1
            path.append(label)
            left -= size_of[label]
        path.reverse()
        return path


class _WhiteSpaceBesideSpace(Exception):
    """The text is to be split as a whole."""


class ByteBpe:
    """A byte-level BPE tokenizer file, compiled; ``kept`` bounds the chunks whose ids are remembered, and the table."""

    def __init__(self, spec: str, kept: int = KEPT):
        spec = json.loads(spec)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        as_bytes = [tuple(bytes(letters[c] for c in part) for part in pair) for pair in pairs]
        self.labels = {i: b for b, i in vocab.items()}
        self.machine = MergeAutomaton(self.labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in as_bytes], min(kept, MOST_ARCS))
        added = sorted(spec.get("added_tokens") or [], key=lambda t: -len(t["content"]))
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        emitted = self.labels | {i: s.encode() for s, i in self.added.items()}
        spelled = [emitted.get(i, b"") for i in range(max(emitted) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.size_of = np.array([len(b) for b in spelled], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.words = regex.compile(SPLIT)
        self.chunks = _Remembered(self.after_space, kept)
        self.cores = _Remembered(lambda core: packed(self.machine.encode(b" " + core.encode())), kept // 2)
        self.marks = _Remembered(self.plain, 4096)

    def plain(self, text: str) -> bytes:
        encode = self.machine.encode
        return packed([i for w in self.words.findall(text) for i in encode(w.encode())])

    def after_space(self, chunk: str) -> bytes:
        """The ids of a space and ``chunk``, which has no white space at its ends."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _WhiteSpaceBesideSpace
        core = chunk.rstrip(_MARKS)
        if not core.isalpha():
            return self.plain(" " + chunk)
        # Letters, then marks: two words for the splitter.
        if len(core) == len(chunk):
            return self.cores[core]
        return self.cores[core] + self.marks[chunk[len(core) :]]

    def pieces(self, text: str) -> list[bytes]:
        """The packed ids of pieces that make up ``text``, which holds no added token.

        Where a space stands between other characters than white space the splitter always cuts before it.
        White space at the end of a text is one word.
        """
        body = text.rstrip()
        first, *rest = body.split(" ")
        try:
            if first and first[-1].isspace():
                raise _WhiteSpaceBesideSpace
            found = [self.plain(first), *map(self.chunks.__getitem__, rest)]
        except _WhiteSpaceBesideSpace:
            return [self.plain(text)]
        if len(body) < len(text):
            found.append(self.plain(text[len(body) :]))
        return found

    def encode(self, text: str | None) -> np.ndarray:
        found = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                found.append(packed([self.added[part]]))
            elif part:
                found += self.pieces(part)
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """What the labels of ``ids`` spell: their bytes are emitted from one table, a stretch of ids at a time."""
        out = []
        for at in range(0, len(ids), 1 << 16):
            part = np.asarray(ids[at : at + (1 << 16)], np.int64)
            size = self.size_of[part]
            ends = np.cumsum(size)
            out.append(self.spelled[np.repeat(self.start_of[part] - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Remembered(dict):
    """What ``work_out`` gives for strings, kept.

    When full it becomes the elder generation, out of which what is still asked for comes back.
    """

    def __init__(self, work_out: Callable[[str], bytes], kept: int):
        super().__init__()
        self.work_out, self.kept, self.elder = work_out, kept // 2, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.kept:
            self.elder = dict(self)
            self.clear()
        found = self.elder.get(text)
        if found is None:
            found = self.work_out(text)
        if len(text) <= 64:
            self[text] = found
        return found


_compiled: dict[str, ByteBpe] = {}


def compiled(spec: str, kept: int) -> ByteBpe:
    """The compiled tokenizer, once a worker."""
    key = f"{kept} {hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = ByteBpe(spec, kept)
    return _compiled[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver; a vocabulary's size bounds it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", kept: int = KEPT) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the token ids of the whole ``text``."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("array<int>")
    def to_ids(texts: pa.Array) -> pa.Array:
        bpe = compiled(spec.value, kept)
        found = [bpe.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
        values = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    return docs.withColumn(ids, to_ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", kept: int = KEPT) -> DataFrame:
    """``docs`` with the column ``text``: what the labels of ``ids`` spell; null ids spell the empty text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("string")
    def to_text(lists: pa.Array) -> pa.Array:
        bpe = compiled(spec.value, kept)
        values, out, at = lists.flatten().to_numpy(zero_copy_only=False), [], 0
        for n in lists.value_lengths().to_pylist():
            out.append(bpe.decode(values[at : at + (n or 0)]))
            at += n or 0
        return pa.array(out, pa.string())

    return docs.withColumn(text, to_text(F.col(ids)))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: encodes and decodes every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = default_path()
    # The ids go to both the digest and the decoder; a projection on the encoder's output alone keeps it at one run.
    both = decode(encode(docs, path), path).select("doc_id", "ids", "decoded")
    return both.select("doc_id", *digests(both))
