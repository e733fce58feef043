from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F
from wareflow.operators import rescue, verdicts
from wareflow.operators.skills import EDIT_FIRST, INPAINT, LOCATE, REJECT_SCAN, VERIFY, Skill
from wareflow.plans import steps
from wareflow.plans.runner import Pause

ANSWERS = [
    (1, 'ok {"reject_indices":[0,2],"reject_scores":[0.9,0.4]} {junk}'),
    (2, '{"a":{"b":1}} {"reject_indices":[1],"reject_scores":[1.0]}'),
    (3, '{"reject_indices":[1],"reject_scores":['),
    (4, '{"reject_indices":[9],"reject_scores":[0.5]}'),
    (5, '{"reject_indices":[1,2],"reject_scores":[0.5]}'),
    (6, '{"reject_indices":[],"reject_scores":[]}'),
    (7, None),
    (8, '{"reject_indices":"x","reject_scores":[1]}'),
]


def test_answers_are_parsed_strictly(spark):
    rows = spark.createDataFrame([(*a, 4) for a in ANSWERS], "id int, raw string, n int")
    got = sorted((r.id, r.position, r.score) for r in verdicts.flattened(rows, "id", "raw", "n").collect())
    assert got == [(1, 0, 0.9), (1, 2, 0.4), (2, 1, 1.0)]


def test_classes_and_exceptions(spark):
    cases = [([c], [], 0.9, True) for c in verdicts.REJECT_CLASSES] + [([verdicts.REJECT_CLASSES[0]], [e], 0.9, False) for e in verdicts.EXCEPTIONS]
    cases += [(["other"], [], 0.9, False), (["text_only"], [], 0.1, False), (None, None, None, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, classes array<string>, exempt array<string>, score double, wanted boolean")
    assert rows.where(verdicts.rejected(F.col("classes"), F.col("exempt"), F.col("score")) != F.col("wanted")).count() == 0


def test_batches_of_four(spark):
    images = spark.range(10).select((F.col("id") % 2).alias("item"), "id")
    got = verdicts.batches(images, "item", "id", F.floor(F.col("id") / 3)).where("item = 0").orderBy("id").collect()
    assert [(r.batch, r.position) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]


def test_scan_to_rejected_images(spark):
    batch = spark.createDataFrame([(1, ["a", "reject-b", "c", "reject-d"])], "id int, paths array<string>")
    answers = REJECT_SCAN.apply(batch, ["paths"], "answer").select("id", F.col("answer.result").alias("raw"), F.size("paths").alias("n"))
    assert sorted(r.position for r in verdicts.flattened(answers, "id", "raw", "n").collect()) == [1, 3]


def test_centre_boxes_are_skipped(spark):
    boxes = [(0.1, 0.1, 0.2, 0.2), (0.4, 0.4, 0.6, 0.6), (0.8, 0.8, 0.9, 0.9), (0.0, 0.4, 0.1, 0.6)]
    rows = spark.createDataFrame([(boxes,)], "b array<struct<x0: double, y0: double, x1: double, y1: double>>")
    kept = rows.select(rescue.outer_boxes(F.col("b")).alias("k")).first().k
    assert [tuple(k) for k in kept] == [boxes[3]]


def test_each_residue_class_rolls_back(spark):
    rows = [(c, False, [c]) for c in rescue.RESIDUE_CLASSES] + [("box", True, []), ("clean", False, []), ("none", None, None)]
    df = spark.createDataFrame([(n, b, w, f"{n}.jpg", f"{n}.new") for n, b, w in rows], "name string, in_boxes boolean, whole array<string>, original string, candidate string")
    got = {r.name: (r.kept, r.status) for r in rescue.commit_or_roll_back(df, "original", "candidate", rescue.residue(F.col("in_boxes"), F.col("whole")), "kept").collect()}
    assert {n for n, (_, s) in got.items() if s == "rescued"} == {"clean", "none"}
    assert got["sticker"] == ("sticker.jpg", "rejected") and got["clean"] == ("clean.new", "rescued")


def test_gated_images_never_reach_the_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(xs):
        seen.add(len(xs))
        return [x["path"] for x in xs]

    rows = spark.createDataFrame([("a.mark", "photo"), ("b", "screenshot"), ("c", "collage"), ("d", "poster"), ("e", None)], "path string, kind string")
    Skill("count", "string", count).apply(rows.where(rescue.gate(F.col("kind"))), ["path"], "made").collect()
    assert seen.value == 2


def rescued(spark, paths, **skills):
    rows = spark.createDataFrame([(p, "screenshot" if "shot" in p else "photo") for p in paths], "at string, kind string")
    return {r.at: r for r in steps.rescued(rows, "at", "kind", **skills).collect()}


def test_rescue_verifies_what_was_made(spark):
    paths = ["mark-1", "sticky-mark-2", "mark-url-3", "plain", "mark-shot"]
    got = rescued(spark, paths)
    assert {p: (r.kept, r.status) for p, r in got.items()} == {"mark-1": ("1.clean", "rescued"), "sticky-mark-2": ("sticky-mark-2", "rejected"), "mark-url-3": ("mark-url-3", "rejected"), "plain": ("plain", "rejected"), "mark-shot": ("mark-shot", "given up")}
    assert got["mark-1"].n_boxes == 1 and got["plain"].n_boxes == 0 and got["mark-shot"].n_boxes == 0
    # Residue that only the edited image has is found, too.
    dirty = Skill("inpaint", "string", lambda xs: [x["path"].replace("mark-", "sticky-") for x in xs])
    assert rescued(spark, ["mark-1"], inpaint=dirty)["mark-1"].status == "rejected"


def test_the_inpainter_gets_the_boxes_that_are_left(spark):
    boxes = [(0.0, 0.0, 0.1, 0.1), (0.4, 0.4, 0.6, 0.6), (0.9, 0.9, 1.0, 1.0)]
    locate = Skill("locate", LOCATE.kind, lambda xs: [[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in boxes] for _ in xs])
    inpaint = Skill("inpaint", "string", lambda xs: [f"{x['path']} {[(b['x0'], b['y1']) for b in x['boxes']]}" for x in xs])
    verify = Skill("verify", VERIFY.kind, lambda xs: [{"in_boxes": len(x["boxes"]) != 2, "whole": []} for x in xs])
    got = rescued(spark, ["a"], locate=locate, inpaint=inpaint, verify=verify)["a"]
    assert (got.kept, got.status, got.n_boxes) == ("a [(0.0, 0.1), (0.9, 1.0)]", "rescued", 2)


def test_errors_of_the_rescue_are_kept(spark):
    def fail(xs):
        raise OSError("gone")

    for name, skill in (("locate", LOCATE), ("inpaint", INPAINT), ("verify", VERIFY)):
        got = rescued(spark, ["mark-1", "plain"], **{name: Skill(name, skill.kind, fail, batch=1)})
        assert (got["mark-1"].status, got["mark-1"].kept, got["mark-1"].error) == ("rejected", "mark-1", f"{name}: OSError: gone")
        assert got["plain"].error == ("locate: OSError: gone" if name == "locate" else None)


def test_gated_images_reach_no_model_of_the_rescue(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(xs):
        seen.add(len(xs))
        return LOCATE.backend(xs)

    rescued(spark, ["mark-1", "shot-2", "shot-3", "4"], locate=Skill("locate", LOCATE.kind, count))
    assert seen.value == 2


def test_first_image(spark):
    rows = spark.createDataFrame([("a", [(0, "p0", "s"), (1, "p1", "s")]), ("closeup", [(0, "q0", "s")])], "path string, images array<struct<idx: int, path: string, sha256: string>>")
    edited = EDIT_FIRST.apply(rows, ["path"], "e").withColumn("images", rescue.replace_first(F.col("images"), F.col("e.result")))
    assert {r.path: [i.path for i in r.images] for r in edited.collect()} == {"a": ["a.edited", "p1"], "closeup": ["q0"]}
    wanted = spark.createDataFrame([(None, None), (True, False), (False, True)], "p boolean, c boolean").select(rescue.first_image_wanted(F.col("p"), F.col("c")).alias("w"))
    assert [r.w for r in wanted.collect()] == [True, False, False]


def test_masks_and_pools(spark):
    rows = spark.createDataFrame([([3, 1], [5, 9]), ([], [])], "x array<int>, y array<int>").select(rescue.mask_box(F.col("x"), F.col("y")).alias("b")).collect()
    assert tuple(rows[0].b) == (1, 5, 3, 9) and rows[1].b is None
    cases = [(24.0, 0, 28), (12.0, None, 16), (8.0, 0, 10), (4.0, 0, 1), (24.0, 2, 7), (12.0, 60, 1), (None, 1, 1)]
    rows = spark.createDataFrame(cases, "gb double, failures int, wanted int")
    assert rows.where(rescue.pool_size(F.col("gb"), F.col("failures")) != F.col("wanted")).count() == 0


def test_a_pause_is_no_error(spark):
    def stop(xs):
        raise Pause("stop")

    rows = spark.createDataFrame([("a",)], "path string")
    with pytest.raises(Exception, match="Pause"):
        Skill("stop", "string", stop).apply(rows, ["path"], "x").collect()
    with pytest.raises(Exception, match="Pause"):
        rescued(spark, ["mark-1"], inpaint=Skill("stop", "string", stop))


def test_verdicts_among_other_braces(spark):
    own = '"reject_indices": [1], "reject_scores": [0.5]'
    cases = {
        '{"a": {"b": "}"}, %s, "c": {"reject": {}}} x' % own: True,
        '{"deep": {"verdict": {%s}}}' % own: True,
        r'{"q": "say \"}{\" or \\", %s}' % own: True,
        'an unclosed { and then {%s}' % own: True,
        '5" wide, {%s}, 7" high' % own: True,
        '{"name": "reject_indices"} {%s}' % own: True,
        '{"n": "reject_indices", "v": [1]}': False,
        '{%s' % own: False,
        "{}": False,
        '{"reject_indices": [1]}': False,
        '"reject_indices": [1]': False,
        "": False,
    }
    rows = spark.createDataFrame([(k, raw, wanted) for k, (raw, wanted) in enumerate(cases.items())], "k int, raw string, wanted boolean")
    got = {r.k: r.v for r in rows.select("k", verdicts.parse(F.col("raw")).alias("v")).collect()}
    assert [got[k] is not None for k in sorted(got)] == list(cases.values())
    assert all(v is None or (v.reject_indices, v.reject_scores) == ([1], [0.5]) for v in got.values())
    two = spark.range(1).select(verdicts.verdict_json(F.lit('x {"reject_indices": [{"a": 1}]} {"reject_indices": 2}')).alias("j")).first().j
    assert two == '{"reject_indices": [{"a": 1}]}'


def test_the_scan_takes_time_in_proportion(spark):
    def took(n):
        raw = '{"a": {"b": ["%s"]}}, ' % ("x } " * 40) * n + '{"reject_indices": [1], "reject_scores": [1]}'
        row = spark.createDataFrame([(raw,)], "raw string")
        began = time.time()
        assert row.select(verdicts.parse(F.col("raw")).alias("v")).first().v.reject_indices == [1]
        return time.time() - began

    took(5)
    assert took(800) < 20 * max(took(100), 0.2)


def test_batches_lose_no_image(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, None, None), (3, "a", None), (4, "a", 1), (5, None, 1)], "id int, item string, at int")
    got = {r.id: (r.batch, r.position) for r in verdicts.batches(rows, "item", ["at", "id"], F.col("at")).collect()}
    assert got == {2: (0, 0), 5: (0, 1), 1: (0, 2), 3: (0, 0), 4: (0, 1)}
