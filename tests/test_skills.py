"""Skills: answers held against their schema, bounded retries, and rows that are not asked about."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from wareflow.operators.skills import Invalid, Skill, validated

KIND = "struct<label: string, score: double, n: int, tags: array<string>, at: struct<x: bigint>, ok: boolean>"
GOOD = {"label": "a", "score": 1, "n": 2, "tags": ["x", None], "at": {"x": 3}, "ok": True}


def changed(**more):
    return {k: v for k, v in (GOOD | more).items() if v is not ...}


@pytest.mark.parametrize(
    "value, why",
    [
        (GOOD, None),
        (changed(label=None, tags=None, at=None), None),
        (changed(tags=[]), None),
        (changed(score=0.5), None),
        (changed(n=...), "missing: answer.n"),
        (changed(at={}), "missing: answer.at.x"),
        (changed(label=5), "type: answer.label is no string"),
        (changed(n=1.5), "type: answer.n is no int"),
        (changed(n=True), "type: answer.n is no int"),
        (changed(ok=1), "type: answer.ok is no boolean"),
        (changed(score="1"), "type: answer.score is no double"),
        (changed(n=1 << 31), "range: answer.n"),
        (changed(at={"x": 1 << 63}), "range: answer.at.x"),
        (changed(score=float("nan")), "range: answer.score"),
        (changed(tags="x"), "type: answer.tags is no list"),
        (changed(tags=["x", 1]), "type: answer.tags[1] is no string"),
        (changed(at=[1]), "type: answer.at is no object"),
        ([GOOD], "type: answer is no object"),
    ],
)
def test_answers_are_held_against_the_type(spark, value, why):
    kind = T.DataType.fromDDL(KIND)
    if why is None:
        found = validated(value, kind)
        assert found == value and (found["score"] is None or isinstance(found["score"], float))
    else:
        with pytest.raises(Invalid) as e:
            validated(value, kind)
        assert str(e.value) == why


def test_fields_that_the_type_does_not_name(spark):
    kind, more = T.DataType.fromDDL(KIND), changed(extra=1, at={"x": 3, "y": 4})
    assert validated(more, kind) == GOOD
    with pytest.raises(Invalid, match="extra: answer.extra"):
        validated(more, kind, "error")
    with pytest.raises(Invalid, match=r"extra: answer.at.y"):
        validated(changed(at={"x": 3, "y": 4}), kind, "error")


def apply(spark, backend, n=6, **options):
    skill = Skill("s", "struct<v: int>", backend, answers="json", **options)
    return {r.id: r.made for r in skill.apply(spark.range(0, n, 1, 1), ["id"], "made").collect()}


def test_what_is_not_valid_is_kept(spark):
    texts = ['{"v": 1}', '{"v": 1', None, "", '{"w": 1}', "[" * 100_000]
    got = apply(spark, lambda xs: [texts[x["id"]] for x in xs])
    assert got[0].result.v == 1 and got[0].error is None and got[0].answer is None and got[0].tries == 1
    assert [got[k].error for k in range(1, 6)] == ["Invalid: malformed"] * 3 + ["Invalid: missing: answer.v", "Invalid: malformed"]
    assert [got[k].answer for k in range(1, 5)] == texts[1:5] and all(got[k].result is None for k in range(1, 6))


def test_only_rows_without_an_answer_are_asked_again(spark):
    calls = spark.sparkContext.accumulator(0)
    tries = {}

    def backend(xs):
        calls.add(len(xs))
        out = []
        for x in xs:
            tries[x["id"]] = tries.get(x["id"], 0) + 1
            out.append(json.dumps({"v": 1}) if x["id"] < tries[x["id"]] else "?")
        return out

    got = apply(spark, backend, retries=2)
    assert {k: (m.error, m.tries) for k, m in got.items()} == {0: (None, 1), 1: (None, 2), 2: (None, 3)} | {k: ("Invalid: malformed", 3) for k in (3, 4, 5)}
    assert calls.value == 6 + 5 + 4


def test_calls_that_fail_are_tried_again(spark):
    tries = []

    def backend(xs):
        tries.append(1)
        if len(tries) == 1:
            raise TimeoutError("busy")
        return ['{"v": 7}'] * len(xs)

    assert {m.result.v for m in apply(spark, backend, retries=1).values()} == {7}
    got = apply(spark, lambda xs: ["{}"], retries=1)
    assert {m.error for m in got.values()} == {"ValueError: 1 results for 6 inputs"}


def test_rows_that_are_not_asked_about(spark):
    seen = spark.sparkContext.accumulator(0)

    def backend(xs):
        seen.add(len(xs))
        return [x["id"] for x in xs]

    rows = spark.range(9)
    got = {r.id: r.m for r in Skill("s", "bigint", backend).apply(rows, ["id"], "m", F.when(F.col("id") > 1, F.col("id") % 3 == 0)).collect()}
    assert seen.value == 2 and [got[k].result for k in range(9)] == [None, None, None, 3, None, None, 6, None, None]
    assert got[1].tries == 0 and got[1].error is None and got[3].tries == 1
    assert Skill("s", "bigint", backend).apply(rows.limit(0), ["id"], "m").count() == 0
