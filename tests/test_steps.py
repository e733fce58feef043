from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from wareflow.operators import skills
from wareflow.operators.skills import Skill
from wareflow.plans import runner, steps
from wareflow.sources.tables import ITEM

TIERS = (("0", "100", "2"), ("100", "1000", "1.5"))


def items(spark):
    images = lambda *paths: [(k, p, "s") for k, p in enumerate(paths)]
    rows = [
        (1, "Red Bag", "a red bag, 1,200円", Decimal(50), "bags", images("p0", "reject-mark-1", "reject-url", "screenshot-reject")),
        (2, "red  bag", "same title", Decimal(60), "bags", images("q0")),
        (3, "Knife", "a weapon of note", Decimal(70), "other things", images("r0")),
        (4, "Fake", "a fake thing", Decimal(80), "bags", images("s0")),
        (5, "Coat", None, Decimal(150), None, images("closeup-5", "t1")),
        (6, "Hat", "plain hat", None, "wool hats", []),
    ]
    return spark.createDataFrame(rows, ITEM)


def whole(spark):
    same = Skill("same", "string", lambda xs: [x["_text"] for x in xs])
    mapping = spark.createDataFrame([("bags", "B1")], "src string, dst string")
    return steps.listing(mapping, "0.5", TIERS, [("red", "blue")], ["fake"], {"desc": "none given", "price": 0}, "Ships soon.", translate=same)


def test_all_steps_in_a_run_that_resumes(spark, tmp_path):
    run = runner.Run(spark, str(tmp_path), whole(spark))
    assert tuple(name for name, _ in whole(spark)) == runner.ORDER[1:]
    got = {r.item_id: r for r in run.go(items(spark)).collect()}
    assert sorted(got) == [1, 5, 6]
    one = got[1]
    assert (one.category, one.price, one.desc) == ("B1", Decimal("50.0000"), "a blue bag, 1200\nShips soon.")
    assert [i.path for i in one.images] == ["p0.edited", "reject-1.clean"] and one.warnings == []
    assert (got[5].category, got[5].desc, [i.path for i in got[5].images]) == ("unmapped", "none given\nShips soon.", ["closeup-5", "t1"])
    assert (got[6].category, got[6].price, got[6].images) == ("hats", Decimal(0), [])
    assert [r.item_id for r in run.quarantine(6).collect()] == [3]
    assert runner.Run(spark, str(tmp_path), whole(spark)).next_stage() == 12


def test_sub_stages_see_what_came_before(spark):
    got = steps.describe(items(spark), "desc", "title").where("item_id = 1").first()
    assert got.f_a.brief == "a red bag, 1,200円" and got.f_c.title == "Red Bag " + " ".join(got.f_b.main) and got.f_d == [*got.f_b.main, *got.f_b.secondary]


def test_a_batch_without_a_verdict_leaves_others_alone(spark):
    rows = spark.range(10).select(F.lit("x").alias("item"), "id", F.when(F.col("id") == 5, "broken").when(F.col("id") == 9, "reject-me").otherwise("fine").alias("path"))

    def scan(xs):
        if "broken" in xs[0]["paths"]:
            return ["I can not say"]
        hits = [str(i) for i, p in enumerate(xs[0]["paths"]) if "reject" in p]
        return ['{"reject_indices": [%s], "reject_scores": [%s]}' % (",".join(hits), ",".join("0.9" for _ in hits))]

    got = {r.id: r for r in steps.reject_scan(rows, "item", "id", F.lit(0), "path", Skill("scan", "string", scan, batch=1)).collect()}
    assert {i for i, r in got.items() if r.error} == {4, 5, 6, 7} and {i for i, r in got.items() if r.rejected} == {9}


def fails_on(what, kind, backend=None):
    def run(xs):
        if any(what in str(x) for x in xs):
            raise TimeoutError("no answer")
        return backend(xs)

    return Skill("broken", kind, run, batch=1)


def test_a_failed_batch_stops_its_item_and_no_other(spark, tmp_path):
    scan = fails_on("q0", "string", skills.REJECT_SCAN.backend)
    same = Skill("same", "string", lambda xs: [x["_text"] for x in xs])
    rows = items(spark).where("item_id in (1, 2, 5, 6)").withColumn("title", F.concat("title", F.col("item_id").cast("string")))
    mapping = spark.createDataFrame([("bags", "B1")], "src string, dst string")
    broken = {"classify": fails_on("wool", "string", skills.CLASSIFY.backend), "inpaint": fails_on("mark", "string"), "edit": fails_on("t1", "string", skills.EDIT_FIRST.backend)}
    run = runner.Run(spark, str(tmp_path), steps.listing(mapping, "0.5", TIERS, [], ["fake"], {"desc": "none given", "price": 0}, "Ships soon.", translate=same, scan=scan, **broken))
    got = {r.item_id: r for r in run.go(rows).collect()}
    assert sorted(got) == [1, 5, 6]
    stopped = run.quarantine(10).collect()
    assert [(r.item_id, r.error, [i.path for i in r.images]) for r in stopped] == [(2, "F.E: TimeoutError: no answer", ["q0"])]
    # What does not stop an item is listed, not swallowed.
    assert got[6].warnings == ["A: TimeoutError: no answer"] and got[6].category == "unmapped"
    assert got[1].warnings == ["K0: inpaint: TimeoutError: no answer"] and [i.path for i in got[1].images] == ["p0.edited"]
    assert got[5].warnings == []
    counted = {(r.stage, r.fate, r.kind): r.rows for r in run.errors().collect()}
    assert counted == {("K0", "stopped", "F.E: TimeoutError"): 1, ("K", "warned", "A: TimeoutError"): 1, ("K", "warned", "K0: inpaint"): 1}


def test_sub_stages_see_the_images_and_stop_at_the_first_error(spark):
    rows = spark.createDataFrame([(1, "plain text here", ["a"]), (2, "plain text here", ["a", "weapon.jpg"]), (3, "a weapon", None), (4, "bad text", ["a"]), (5, None, [])], "id int, body string, pictures array<string>")
    seen = []

    def terms(xs):
        seen.extend(sorted(x) for x in xs)
        if any(x["clean"].startswith("bad") for x in xs):
            raise ValueError("no terms")
        return skills.TERMS.backend(xs)

    broken = Skill("terms", skills.TERMS.kind, terms, batch=1, answers="json")
    got = {r.id: r for r in steps.describe(rows, "body", "body", "pictures", main=broken).collect()}
    assert {k: (r.f_a.prohibited, r.f_c and r.f_c.prohibited) for k, r in got.items()} == {1: (False, False), 2: (False, True), 3: (True, False), 4: (False, None), 5: (False, False)}
    assert got[4].error == "F.B: ValueError: no terms" and got[4].f_c is None and got[4].f_d is None
    assert got[1].error is None and got[1].f_d == ["here", "plain", "text"] and got[5].f_d == []
