from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wareflow.llm import fingerprint, native, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(PATTERNS)
HARD = [
    "mail a.b@c.de, x@y and q@r.co_m@n.org.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111x",
    "+1 (415) 555-2671, +49 30 123456, +1, +12 3, + 1 555",
    "é😀 a@b.cd 日本 10.0.0.1 😀",
    "call 4111 1111 1111 1111 +1 415 555 2671 9",
    "a@b.c@d.e.f",
    "1" * 3000 + " " + "a" * 3000 + "@",
    "." * 500 + "+" * 500,
    "",
    None,
]


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), KINDS.index(k), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group()))


def found_in(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(rows)
    spans = pii.decide(found, pii.learn(found)).orderBy("doc_id").collect()
    return [[(s["start"], s["kind"], s["end"]) for s in r.spans if s["base"]] for r in spans]


def test_base_spans_of_hard_texts(spark):
    assert found_in(spark, HARD) == [base(t) for t in HARD]


def test_base_spans_of_random_texts(spark):
    texts = []

    @given(st.text(alphabet="ab@.+-_ 1234567890()é😀\n%", max_size=60))
    @settings(max_examples=400, deadline=None, database=None)
    def gather(t):
        texts.append(t)

    gather()
    assert found_in(spark, texts) == [base(t) for t in texts]


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_looser_spans_and_redaction(spark):
    rows = spark.createDataFrame([(1, "mail: joe (at) example (dot) com or a@b.com"), (2, "plain text"), (3, None), (4, "tel. (415) 555-2671 now")] * 5, "doc_id long, text string")
    found = pii.candidates(rows)
    redacted = {r.doc_id: r.text for r in pii.redact(pii.decide(found, pii.learn(found))).collect()}
    assert redacted[1].endswith("or [EMAIL]") and "joe" not in redacted[1]
    assert redacted[2] == "plain text" and redacted[3] is None
    assert redacted[4] == "tel. [PHONE] now"
    assert pii.learn(found.limit(0)) is None


def test_secrets_by_their_context(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'x token = "{token[k:] + token[:k]}" y' for k in range(30)] + ["incomprehensibilitiesandmore of it"] * 30 + [f"see checksum {token[k:] + token[:k]} z" for k in range(5)]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.learn(found)
    redacted = [r.text for r in pii.redact(pii.decide(found, model)).orderBy("doc_id").collect()]
    assert redacted[:30] == ['x token = "[SECRET]" y'] * 30 and redacted[30:60] == texts[30:60]
    assert model["reliability"]["secret"] != model["reliability"].get("email")


def by_hand(kinds, votes, rounds, drawn):
    """Expectation maximisation candidate by candidate."""
    n, labelers = len(kinds), len(votes[0])
    p = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * labelers))) for v in votes]
    for _ in range(rounds):
        def rate(j, side, of=None):
            hit = total = 0.0
            for k, v, q in zip(kinds, votes, p, strict=True):
                if v[j] and (of is None or k == of):
                    weight = q if side else 1 - q
                    total += weight
                    hit += weight * ((v[j] > 0) == bool(side))
            return hit, total

        pooled = [[(4 + h) / (5 + t) for h, t in (rate(j, side) for side in (0, 1))] for j in range(labelers)]
        right = {k: [[(drawn * pooled[j][side] + rate(j, side, k)[0]) / (drawn + rate(j, side, k)[1]) for side in (0, 1)] for j in range(labelers)] for k in set(kinds)}
        prior = {k: (1 + sum(q for kk, q in zip(kinds, p, strict=True) if kk == k)) / (2 + kinds.count(k)) for k in set(kinds)}
        new = []
        for i in range(n):
            yes, no = prior[kinds[i]], 1 - prior[kinds[i]]
            for j, v in enumerate(votes[i]):
                r = right[kinds[i]][j]
                if v:
                    yes, no = yes * (r[1] if v > 0 else 1 - r[1]), no * (1 - r[0] if v > 0 else r[0])
            new.append(yes / (yes + no))
        p = new
    return p


def test_expectation_maximisation_equals_a_version_by_hand():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 3, 120).tolist()
    truth = rng.random(120) < 0.4
    votes = [[int(v) for v in np.where(rng.random(5) < 0.2, 0, np.where(rng.random(5) < (0.9, 0.8, 0.7, 0.6, 0.5), 1, -1) * (1 if t else -1))] for t in truth]
    rows = sorted({(k, *v) for k, v in zip(kinds, votes, strict=True)})
    counts = [sum((k, *v) == r for k, v in zip(kinds, votes, strict=True)) for r in rows]
    table = np.array(rows)
    likely, right = pii.expectation_maximisation(table[:, 0], table[:, 1:], np.array(counts, float), rounds=15, drawn=10)
    wanted = dict(zip(((k, *v) for k, v in zip(kinds, votes, strict=True)), by_hand(kinds, votes, 15, 10), strict=True))
    assert np.allclose(likely, [wanted[r] for r in rows], atol=1e-9)
    assert np.mean((likely > 0.5) == [truth[[(k, *v) for k, v in zip(kinds, votes, strict=True)].index(r)] for r in rows]) > 0.7
    assert right[:, 0].mean() > right[:, 4].mean()


def test_features_tell_apart_candidates_with_the_same_votes():
    # Half of the candidates abstain everywhere; those share a feature with the likely ones, others do not.
    kinds = np.full(4, 4)
    votes = np.array([[1, 1, 1, 1, 1], [-1, -1, -1, -1, -1], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]])
    features = np.array([[1, 1, 3, 1], [1, 1, 9, 1], [1, 1, 3, 1], [1, 1, 9, 1]])
    weights = pii.span_classifier(kinds, votes, features, np.array([50.0, 50, 5, 5]), np.array([0.95, 0.05, 0.5, 0.5]))
    z = pii._columns(kinds, votes, features) @ weights
    assert z[2] > z[3] and z[0] > 0 > z[1]


def test_very_many_spans_in_a_long_text(spark):
    one = "mail a@b.com, tel. 415-555-2671 and 4111 1111 1111 1111; token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 \u65e5 "
    text = one * 5000
    found = pii.candidates(spark.createDataFrame([(1, text), (2, "x" * 300_000), (3, "")], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.redact(pii.decide(found, None)).collect()}
    assert got[1].text == (one.replace("a@b.com", "[EMAIL]").replace("4111 1111 1111 1111", "[CARD]")) * 5000
    assert len(got[1].spans) == 10_000 and got[2].text == "x" * 300_000 and got[3].text == ""


def test_running_sums(spark):
    row = spark.range(1).select(*[native.running_sums(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias(f"n{n}") for n in (1, 256, 257, 1500)], native.running_sums(F.array().cast("array<long>")).alias("none")).first()
    assert row.none == [] and all(row[f"n{n}"] == [k * (k + 1) // 2 for k in range(1, n + 1)] for n in (1, 256, 257, 1500))


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_fingerprints(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows, errors = fingerprint.query(spark, sf_dir).collect(), []
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        text, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        edited = text[: len(text) - half] + texts[after[r.doc_id]][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = shingle_set(text), shingle_set(edited)
        errors.append(r.near_edited - len(a & b) / max(1, len(a | b)))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_following_rows_whatever_the_ids(spark):
    for ids in ([5], [3, 1, 2], list(range(0, 500, 7)), [4, None, 9, -3], [7] * 40):
        rows = spark.createDataFrame([(i, f"t{i}", 1) for i in ids], "doc_id long, text string, next_text int").drop("next_text")
        got = fingerprint.with_next(rows, ["text"]).collect()
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        after = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
        assert len(got) == len(ids) and all(r.next_text == f"t{after[r.doc_id]}" for r in got)
    assert fingerprint.with_next(rows.limit(0), ["text"]).count() == 0


def test_odd_fingerprints(spark):
    texts = [None, "", "  \n", "one", "one two", "two one", "word " * 30_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprint.fingerprint(F.col("text")).alias("f"))
    f = [r.f for r in rows.collect()]
    assert f[0] == f[1] == f[2] == "" and len(f[3]) == 256 and f[4] != f[5] and len(f[6]) == 256
    like = spark.createDataFrame([(f[0], f[1]), (f[0], f[3]), (f[4], f[4]), (f[4], f[5])], "a string, b string").select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x"))
    got = [r.x for r in like.collect()]
    assert got[:3] == [1.0, 0.0, 1.0] and got[3] < 0.1
