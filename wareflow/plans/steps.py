"""The composed steps: F (texts and reject scan), K0 (rescue), K (first image), and the whole list for a ``Run``.

Each sub-stage sees what the ones before it made: their results stand in struct columns beside the item (f_a, f_b,
...), which are taken off at the end.  Skills are parameters; the defaults are the rule stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions import text as T
from wareflow.operators import items, rescue, skills, verdicts

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def describe(rows: DataFrame, text: str, title: str, images: str | None = None, brief: skills.Skill = skills.BRIEF, main: skills.Skill = skills.TERMS, titled: skills.Skill = skills.TITLE, tagged: skills.Skill = skills.TAGS) -> DataFrame:
    """F.A to F.D: ``rows`` with f_a (clean, brief, prohibited), f_b (main, secondary), f_c (title, prohibited), f_d (tags) and error.

    Each sub-stage's skill gets what the one before made, and all but the tags the paths of the item's ``images`` (array
    of strings): F.A's verdict is on the text, F.C's on what the images show.  A row that a skill fails on has that
    error, named by its sub-stage, and is not asked about any further; prohibited ones are for the caller to filter.
    """
    paths = F.coalesce(F.col(images), F.array().cast("array<string>")) if images else F.array().cast("array<string>")

    def asked(df: DataFrame, skill: skills.Skill, inputs: dict[str, Column], name: str) -> DataFrame:
        given = df.withColumn("__in", F.struct(*[c.alias(n) for n, c in inputs.items()]))
        made = skill.apply(given, [f"__in.{n}" for n in inputs], "__made", F.col("error").isNull())
        failed = F.concat(F.lit(f"{name}: "), F.col("__made.error"))
        return made.withColumn(name.lower().replace(".", "_"), F.col("__made.result")).withColumn("error", F.coalesce("error", failed)).drop("__in", "__made")

    fresh = rows.withColumn("error", F.lit(None).cast("string"))
    first = asked(fresh, brief, {"text": F.col(text), "images": paths}, "F.A")
    second = asked(first, main, {"clean": F.col("f_a.clean"), "brief": F.col("f_a.brief"), "images": paths}, "F.B")
    third = asked(second, titled, {"title": F.col(title), "main": F.col("f_b.main"), "images": paths}, "F.C")
    return asked(third, tagged, {"main": F.col("f_b.main"), "secondary": F.col("f_b.secondary"), "title": F.col("f_c.title")}, "F.D")


def reject_scan(images: DataFrame, item: str, order: str | list[str], bucket, path: str, scan: skills.Skill = skills.REJECT_SCAN, least: float = 0.5) -> DataFrame:
    """F.E: ``images`` with batch, position, score and rejected; a batch without a readable verdict has ``error`` set on its rows alone.

    Batches of four go to the skill; its answers are parsed, flattened and joined back by batch and position.
    """
    dealt = verdicts.batches(images, item, order, bucket)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(path).alias("path")))), lambda x: x["path"])
    asked = dealt.groupBy(item, "batch").agg(paths.alias("paths"))
    answers = scan.apply(asked.withColumn("n_images", F.size("paths")), ["paths"], "answer")
    answers = answers.select(F.struct(item, "batch").alias("of"), F.col("answer.result").alias("raw"), F.col("answer.error").alias("failed"), "n_images")
    unread = F.when(F.col("failed").isNotNull(), F.col("failed")).when(verdicts.parse(F.col("raw")).isNull(), "no readable verdict")
    errors = answers.select(F.col("of").alias("_of"), unread.alias("error"))
    found = verdicts.flattened(answers, "of", "raw", "n_images").groupBy("of", "position").agg(F.max("score").alias("score"))
    found = found.select(F.col("of").alias("_of"), "position", "score")
    rows = dealt.withColumn("_of", F.struct(item, "batch"))
    both = rows.join(errors, "_of", "left").join(found, ["_of", "position"], "left").drop("_of")
    return both.withColumn("rejected", F.coalesce(F.col("score") >= least, F.lit(False)))


def rejected_only(images: DataFrame) -> DataFrame:
    """K0.1: the images that the scan rejected."""
    return images.where("rejected")


def rescued(images: DataFrame, path: str, kind: str, locate: skills.Skill = skills.LOCATE, inpaint: skills.Skill = skills.INPAINT, verify: skills.Skill = skills.VERIFY) -> DataFrame:
    """K0: rejected ``images`` with n_boxes, kept (the path that stays), status (given up, rejected or rescued) and error.

    Gated images reach no model.  The inpainter gets the image and the boxes to treat, those whose centre is not in the
    middle; the verifier gets the image that the inpainter made, and the boxes.  Where a skill fails, its error says
    which, the later ones are not asked, and the original stays.
    """
    none = F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    tried = images.withColumn("__tried", rescue.gate(F.col(kind))).withColumn("__in", F.struct(F.col(path).alias("path")))
    located = locate.apply(tried, ["__in.path"], "__found", F.col("__tried"))
    boxed = located.withColumn("__boxes", F.coalesce(rescue.outer_boxes(F.col("__found.result")), none))
    made = inpaint.apply(boxed.withColumn("__in", F.struct(F.col(path).alias("path"), F.col("__boxes").alias("boxes"))), ["__in.path", "__in.boxes"], "__made", F.size("__boxes") > 0)
    candidate = F.col("__made.result")
    seen = verify.apply(made.withColumn("__in", F.struct(candidate.alias("candidate"), F.col("__boxes").alias("boxes"))), ["__in.candidate", "__in.boxes"], "__seen", candidate.isNotNull())
    left = rescue.residue(F.col("__seen.result.in_boxes"), F.col("__seen.result.whole")) | F.col("__seen.result").isNull()
    done = rescue.commit_or_roll_back(seen.withColumn("__candidate", candidate), path, "__candidate", left, "kept")
    failed = F.coalesce(*[F.concat(F.lit(f"{name}: "), F.col(f"{at}.error")) for name, at in (("locate", "__found"), ("inpaint", "__made"), ("verify", "__seen"))])
    found = done.withColumns({"n_boxes": F.size("__boxes"), "status": F.when(F.col("__tried"), F.col("status")).otherwise("given up"), "error": failed})
    return found.select(*[c for c in images.columns if c not in ("n_boxes", "kept", "status", "error")], "n_boxes", "kept", "status", "error")


def first_images(rows: DataFrame, prohibited: str, close_up: str, images: str = "images", edit: skills.Skill = skills.EDIT_FIRST) -> DataFrame:
    """K: ``rows`` whose first image is replaced by the edited one, where it is allowed and no close-up; and first_image_error."""
    first = F.get(F.filter(images, lambda i: i["idx"] == 0), F.lit(0))["path"]
    path = F.when(rescue.first_image_wanted(F.col(prohibited), F.col(close_up)), first)
    asked = rows.withColumn("__in", F.struct(path.alias("path")))
    edited = edit.apply(asked, ["__in.path"], "__made", F.col("__in.path").isNotNull())
    edited = edited.withColumn(images, rescue.replace_first(F.col(images), F.col("__made.result"))).withColumn("first_image_error", F.col("__made.error"))
    return edited.drop("__in", "__made")


def warned(rows: DataFrame, step: str, error: str) -> DataFrame:
    """``rows`` with the column ``error`` moved to ``warnings``, an array: an error that does not stop its item."""
    before = F.col("warnings") if "warnings" in rows.columns else F.array().cast("array<string>")
    text = F.concat(F.lit(f"{step}: "), F.col(error))
    return rows.withColumn("warnings", F.when(F.col(error).isNull(), before).otherwise(F.concat(before, F.array(text)))).drop(error)


def without_rejects(rows: DataFrame, scan: skills.Skill = skills.REJECT_SCAN, locate: skills.Skill = skills.LOCATE, inpaint: skills.Skill = skills.INPAINT, verify: skills.Skill = skills.VERIFY) -> DataFrame:
    """F.E and K0 over the images of items (item_id, images): rejected ones that are not rescued leave their item.

    An item with a batch whose scan failed has ``error`` set and keeps its images: it is for the quarantine, as
    nothing is known of that batch; other items go on.  Errors of the rescue are ``warnings``.
    """
    each = rows.select("item_id", F.posexplode("images").alias("at", "i"))
    flat = each.select("item_id", F.col("at").cast("long").alias("at"), F.col("i.path").alias("path"), "i")
    status = verdicts.qualified(reject_scan(flat, "item_id", "at", F.floor(F.col("at") / 4096), "path", scan))
    kind = F.when(F.contains("path", F.lit("screenshot")), "screenshot")
    tried = rescued(status.where("status = 'rejected'").select("item_id", "at", "i", "path", kind.alias("kind")), "path", "kind", locate, inpaint, verify)
    tried = tried.select("item_id", "at", F.when(F.col("status") == "rescued", F.col("i").withField("path", F.col("kept"))).alias("i"), "error")
    passed = status.where("status != 'rejected'").select("item_id", "at", F.when(F.col("status") == "ok", F.col("i")).alias("i"), F.lit(None).cast("string").alias("error"), F.when(F.col("status") == "unqualified", F.col("error")).alias("failed"))
    both = passed.unionByName(tried.withColumn("failed", F.lit(None).cast("string")))
    lists = both.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("at", "i")))), lambda x: x["i"]).alias("__left"),
        F.array_sort(F.collect_list("error")).alias("__warned"),
        F.min("failed").alias("__failed"),
    )
    lists = lists.withColumnRenamed("item_id", "__item")
    found = rows.join(lists, F.col("item_id").eqNullSafe(F.col("__item")), "left")
    failed = F.concat(F.lit("F.E: "), F.col("__failed"))
    warnings = F.coalesce(F.transform("__warned", lambda w: F.concat(F.lit("K0: "), w)), F.array().cast("array<string>"))
    before = [F.col(c) for c in rows.columns if c == "warnings"]
    found = found.withColumn("warnings", F.concat(*before, warnings) if before else warnings)
    images = F.when(failed.isNotNull(), F.col("images")).otherwise(F.coalesce("__left", F.slice("images", 1, 0)))
    return found.withColumn("images", images).withColumn("error", failed).drop("__item", "__left", "__warned", "__failed")


def listing(mapping: DataFrame, rate: str, tiers: Sequence[tuple[str, str, str]], words: Sequence[tuple[str, str]], keywords: Sequence[str], defaults: Mapping[str, object], line: str, classify: skills.Skill = skills.CLASSIFY, translate: skills.Skill = skills.TRANSLATE, scan: skills.Skill = skills.REJECT_SCAN, inpaint: skills.Skill = skills.INPAINT, edit: skills.Skill = skills.EDIT_FIRST) -> list[Step]:
    """The steps of an item table (item_id, title, desc, price, category, images) in their order, for ``runner.Run``.

    Errors that stop an item (a translation, a sub-stage of F, a batch of the scan) are its ``error``; errors that do
    not (the category model, the rescue, the first image) are listed in its ``warnings``.
    """

    def filtered(rows: DataFrame) -> DataFrame:
        return items.keyword_filter(rows, "desc", keywords).where("keep").drop("hit", "keep")

    def described(rows: DataFrame) -> DataFrame:
        found = describe(rows.withColumn("__paths", F.col("images")["path"]), "desc", "title", "__paths").drop("__paths")
        return found.withColumn("error", F.coalesce("error", F.when(F.col("f_a.prohibited") | F.col("f_c.prohibited"), "prohibited")))

    def first_image(rows: DataFrame) -> DataFrame:
        flags = rows.withColumn("__bad", F.col("f_c.prohibited")).withColumn("__close", F.exists("images", lambda i: (i["idx"] == 0) & F.contains(i["path"], F.lit("closeup"))))
        done = first_images(flags, "__bad", "__close", edit=edit).drop("__bad", "__close", "f_a", "f_b", "f_c", "f_d")
        return warned(done, "K", "first_image_error")

    return [
        ("A", lambda rows: warned(items.map_category(rows, mapping, "category", model=classify), "A", "category_error")),
        ("B", lambda rows: rows.withColumn("price", items.convert_price(F.col("price"), rate, tiers).cast("decimal(18,4)"))),
        ("C", lambda rows: items.translate(rows, "desc", translate, "made").withColumn("desc", F.coalesce("made", "desc")).withColumn("error", F.col("made_error")).drop("made", "made_error")),
        ("D", lambda rows: rows.withColumn("desc", T.replace_words(F.col("desc"), words))),
        ("E", lambda rows: rows.withColumn("desc", T.clean_numbers(F.col("desc")))),
        ("G", filtered),
        ("F", described),
        ("H", lambda rows: items.fill_defaults(rows, defaults)),
        ("I", lambda rows: items.dedup_titles(rows, "item_id", "title")),
        ("J", lambda rows: rows.withColumn("desc", items.append_template(F.col("desc"), F.lit(line)))),
        ("K0", lambda rows: without_rejects(rows, scan, inpaint=inpaint)),
        ("K", first_image),
    ]
