"""Queries of the composed and image steps over stand-in rows of the standard tables, and their SQL.

Documents stand in for images, parts for items, pages for files.  Classes, boxes, paths and masks are made from ids.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.functions import text as T
from wareflow.operators import items, rescue, skills, terms, verdicts
from wareflow.plans import control, steps, updates
from wareflow.sources.pages import page_fields

KINDS = ("screenshot", "collage", "poster", "photo")
RATE = "0.2150"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _picked(number: Column, values: tuple[str, ...]) -> Column:
    """One of the values by a number, counted from 0; null past the last."""
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.range(1500).selectExpr("cast(id * 2 as decimal(18,4)) lo", "cast(id * 2 + 2 as decimal(18,4)) hi", "cast(1 + id % 9 * 0.05 as decimal(9,4)) mult")
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,4)").alias("price"))
    return items.convert_price_by_table(part, tiers, "price", RATE, "price_twd").select("p_partkey", F.col("price_twd").cast("double").alias("price_twd"))


def category_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("ECONOMY ANODIZED STEEL", "metal goods")], "src string, dst string")
    return items.map_category(_table(spark, sf_dir, "part"), table, "p_type", model=skills.CLASSIFY).select("p_partkey", "category")


def translate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.translate(_table(spark, sf_dir, "part"), "p_name", skills.TRANSLATE, "title").select("p_partkey", "title", F.col("title_error").alias("error"))


def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("¥ "), F.format_number("p_retailprice", 2), F.lit(" or "), F.col("p_size").cast("string"), F.lit("円"))
    cleaned = T.clean_numbers(text)
    return _table(spark, sf_dir, "part").select("p_partkey", cleaned.alias("cleaned"), T.first_number(cleaned).cast("double").alias("number"))


def distinct_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", T.distinct_words(F.concat_ws(" ", "p_name", "p_type", "p_name")).alias("title"))


def item_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps B, D, E, G, H, I and J one after the other."""
    part = _table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("title"), F.concat(F.col("p_type"), F.lit(" 1,500円")).alias("desc"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") > 9, F.col("p_brand")).alias("brand"))
    rows = rows.withColumn("price", items.convert_price(F.col("price"), RATE, (("0", "1000", "1.50"), ("1000", "100000", "1.25"))))
    rows = rows.withColumn("desc", T.clean_numbers(T.replace_words(F.col("desc"), (("STEEL", "iron"), ("ECONOMY iron", "cheap iron")))))
    rows = items.keyword_filter(rows, "desc", ("brass", "tin")).where("keep").drop("hit", "keep")
    rows = items.dedup_titles(items.fill_defaults(rows, {"brand": "no brand"}), "p_partkey", "title")
    return rows.select("p_partkey", "title", F.col("price").cast("double").alias("price"), items.append_template(F.col("desc"), F.concat(F.lit("Brand: "), "brand")).alias("description"))


def describe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.A to F.D with the context and the images passed on; some items have a weapon in the text, others in a picture."""
    part = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("brand"),
        F.concat(F.col("p_type"), F.lit("  "), F.col("p_name"), F.when(F.col("p_size") == 7, "\n weapon").otherwise("")).alias("body"),
        F.when(F.col("p_size") > 3, F.array(F.lit("front"), F.when(F.col("p_size") == 9, "weapon-2").otherwise("back"))).alias("pictures"),
    )
    found = steps.describe(part, "body", "brand", "pictures")
    return found.select("p_partkey", F.col("f_a.clean").alias("clean"), F.col("f_a.prohibited").alias("prohibited"), F.col("f_c.title").alias("title"), F.col("f_c.prohibited").alias("title_prohibited"), F.array_join("f_d", ",").alias("tags"), "error")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: their item, kind and path."""
    n = F.col("doc_id")
    marks = F.concat(F.when(n % 3 == 0, "reject-").otherwise(""), F.when(n % 2 == 0, "mark-").otherwise(""), F.when(n % 5 == 0, "sticky-").otherwise(""), F.when(n % 7 == 0, "url-").otherwise(""))
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.floor(n / 50).cast("long").alias("item"), _picked(n % 6, KINDS).alias("kind"), F.concat(marks, n.cast("string")).alias("path"))


def reject_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.E: batches of four, the scan's answers, parsed and joined back."""
    found = steps.reject_scan(_images(spark, sf_dir), "item", "doc_id", F.floor(F.col("doc_id") / 4096), "path")
    return found.select("doc_id", "item", "batch", "position", "rejected", "error")


def rejected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.1."""
    found = steps.reject_scan(_images(spark, sf_dir), "item", "doc_id", F.floor(F.col("doc_id") / 4096), "path")
    return steps.rejected_only(found).select("doc_id", "path")


def reject_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.E.4 and F.E.5: classes, exceptions and scores."""
    n = F.col("doc_id")
    classes = F.array_compact(F.array(_picked(n % 9, verdicts.REJECT_CLASSES), F.lit("something else")))
    exempt = F.array_compact(F.array(_picked(n % 11, verdicts.EXCEPTIONS)))
    rows = _table(spark, sf_dir, "documents").select("doc_id", classes.alias("classes"), exempt.alias("exempt"), (n % 4 / 4).alias("score"))
    return rows.select("doc_id", verdicts.rejected(F.col("classes"), F.col("exempt"), F.col("score")).alias("rejected"))


def image_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.2."""
    return _images(spark, sf_dir).select("doc_id", "kind", rescue.gate(F.col("kind")).alias("tried"))


def rescue_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.4: boxes whose centre is not in the middle."""
    n = F.col("doc_id")
    at = lambda k, of: (n * k % of / of).cast("double")
    boxes = F.array(*[F.struct(at(k, 16).alias("x0"), at(k + 2, 16).alias("y0"), (at(k, 16) + 0.125).alias("x1"), (at(k + 2, 16) + 0.0625).alias("y1")) for k in (1, 3, 5)])
    left = rescue.outer_boxes(boxes)
    total = F.aggregate(left, F.lit(0.0), lambda acc, b: acc + b["x0"] + b["y0"])
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(left).cast("long").alias("n_left"), total.alias("corners"))


def rescue_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.6, K0.7 and K0.8: residue in the boxes or of a class anywhere, and what is kept."""
    n = F.col("doc_id")
    whole = F.array_compact(F.array(_picked(n % 13, rescue.RESIDUE_CLASSES)))
    candidate = F.when(n % 10 != 0, F.concat(n.cast("string"), F.lit(".new")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (n % 4 == 1).alias("in_boxes"), whole.alias("whole"), n.cast("string").alias("original"), candidate.alias("candidate"))
    left = rescue.residue(F.col("in_boxes"), F.col("whole"))
    return rescue.commit_or_roll_back(rows, "original", "candidate", left, "kept").select("doc_id", left.alias("residue"), "kept", "status")


def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.9: the box around a mask's points, -1 for an empty mask."""
    n = F.col("doc_id")
    points = lambda k: F.when(n % 8 > 0, F.transform(F.sequence(F.lit(1), (n % 8).cast("int")), lambda i: (n * i * k % 101).cast("int"))).otherwise(F.array().cast("array<int>"))
    box = rescue.mask_box(points(3), points(7))
    return _table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(box[c], F.lit(-1)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.10: workers by memory and failures, over suppliers as machines."""
    memory, failed = F.col("s_suppkey") % 32, F.when(F.col("s_suppkey") % 5 > 0, (F.col("s_suppkey") % 3).cast("int"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", rescue.pool_size(memory, failed).alias("workers"))


def rescued_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0: gate, locate, inpaint, verify what was made, and roll back, over all images; some fail in a model."""

    def painted(xs: list) -> list:
        if xs[0]["path"].endswith("13"):
            raise OSError("no memory")
        return skills.INPAINT.backend(xs)

    inpaint = skills.Skill("inpaint", "string", painted, batch=1)
    found = steps.rescued(_images(spark, sf_dir).withColumnRenamed("path", "at"), "at", "kind", inpaint=inpaint)
    return found.select("doc_id", F.col("n_boxes").cast("long").alias("n_boxes"), "kept", "status", "error")


def failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.y: where the scan of a batch fails or gives no verdict, the whole batch is unqualified, and no other one."""

    def scan(xs: list) -> list:
        if any(p.endswith("17") for p in xs[0]["paths"]):
            raise TimeoutError("no answer")
        return ["I would rather not" if any(p.endswith("29") for p in xs[0]["paths"]) else skills.REJECT_SCAN.backend(xs)[0]]

    found = steps.reject_scan(_images(spark, sf_dir), "item", "doc_id", F.floor(F.col("doc_id") / 4096), "path", skills.Skill("scan", "string", scan, batch=1))
    return verdicts.qualified(found).select("doc_id", "batch", "status", "error")


def loose_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.E.1: images of no item, and some without an order, are batched too."""
    n = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.when(n % 4 > 0, F.floor(n / 100).cast("long")).alias("item"), F.when(n % 7 > 0, -n).alias("shown"))
    return verdicts.batches(rows, "item", ["shown", "doc_id"], F.floor(F.col("shown") / 512)).select("doc_id", F.coalesce("item", F.lit(-1)).alias("item"), "batch", "position")


def nested_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.E.2: verdicts among nested objects, braces and escaped quotes in strings, prose with braces, and second verdicts."""
    n = F.col("doc_id")
    own = F.concat(F.lit('"reject_indices": ['), n.cast("string"), F.lit('], "reject_scores": [0.5]'))
    shapes = [
        F.concat(F.lit('The 5" frame: {"note": {"why": "a } brace", "deep": {"x": [1, {"y": 2}]}}, '), own, F.lit("} and {more}")),
        F.concat(F.lit('{"verdict": {"quote": "she said \\"}{\\" twice", '), own, F.lit('}, "model": "m"}')),
        F.concat(F.lit('{"about": "reject_indices"} {'), own, F.lit('} {"reject_indices": [7], "reject_scores": [1]}')),
        F.concat(F.lit('{"reject_indices": [1], "reject_scores": [{"of": 2}], '), F.lit("never closed")),
        F.concat(F.lit('a set {x, y} of braces, then {'), own, F.lit(', "back": "\\\\"}')),
    ]
    raw = F.element_at(F.array(*shapes), (n % 5 + 1).cast("int"))
    found = _table(spark, sf_dir, "documents").select("doc_id", verdicts.parse(raw).alias("v"))
    return found.select("doc_id", F.coalesce(F.get("v.reject_indices", F.lit(0)), F.lit(-1)).alias("picked"), F.coalesce(F.get("v.reject_scores", F.lit(0)), F.lit(-1.0)).alias("score"))


def untitled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I: items without a title are no duplicates of each other."""
    title = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 5 == 1, F.lit("  ")).otherwise(F.col("p_name"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", title.cast("string").alias("title"))
    return items.dedup_titles(rows, "p_partkey", "title")


def answers_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M0: JSON answers held against the skill's result type; what is not valid is asked again once and then kept."""
    asked: dict[int, int] = {}

    def backend(xs: list) -> list:
        out = []
        for x in xs:
            k = int(x["doc_id"])
            asked[k] = asked.get(k, 0) + 1
            whole = '{"label": "l%d", "score": %d}' % (k, k % 100)
            shapes = (whole, whole[:-1], '{"label": "l"}', '{"label": 5, "score": 1}', '{"label": "m%d", "score": 1, "more": {}}' % k, "[]")
            # Every sixth document answers well when asked again.
            out.append(whole if k % 36 >= 30 and asked[k] > 1 else shapes[k % 6])
        return out

    skill = skills.Skill("label", "struct<label: string, score: int>", backend, answers="json", retries=1)
    found = skill.apply(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "made")
    return found.select("doc_id", F.col("made.result.label").alias("label"), F.coalesce("made.result.score", F.lit(-1)).alias("score"), F.col("made.error").alias("error"), F.col("made.answer").alias("answer"), F.col("made.tries").alias("tries"))


def null_stage_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC1 and AC9: signals of no stage make a stage of their own."""
    stage = F.col("user_id") % 4
    rows = _table(spark, sf_dir, "events").where("event_type != 'view'").select("event_id", "ts", F.when(stage > 0, stage).alias("stage"), F.expr("event_type = 'error' and value > 60").alias("failed"))
    return control.cap_path(control.fail_rates(rows, "stage", "ts", "event_id", "failed"), "stage").select(F.coalesce("stage", F.lit(-1)).alias("stage"), "decision", "fail_rate", "cap")


def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K.1 to K.3: the first of an item's images is edited, where it is allowed and no close-up."""
    n = F.col("p_partkey")
    path = lambda k: F.concat(F.lit(f"{k}-"), n.cast("string"))
    images = F.array(*[F.struct(F.lit(k).alias("idx"), path(k).alias("path"), F.lit("s").alias("sha256")) for k in (1, 0, 2)])
    rows = _table(spark, sf_dir, "part").select("p_partkey", images.alias("images"), (n % 5 == 0).alias("bad"), F.when(n % 7 > 0, n % 7 == 1).alias("near"))
    found = steps.first_images(rows, "bad", "near")
    return found.select("p_partkey", F.array_join(F.transform("images", lambda i: i["path"]), ",").alias("paths"))


def start_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC3: suggestion times a tenant's share of requests per active account, as a whole number in the bounds."""
    events = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("stage")).agg(F.count("*").alias("own"), F.count_distinct("user_id").alias("accounts"))
    share = F.col("own") / F.lit(100)
    return events.select("stage", control.start_cap(F.lit(60.0), share, F.col("accounts"), 1, 64).alias("cap"))


def stage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC1 and AC2: blips and pauses leave the window altogether."""
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "network_blip").when(F.col("event_type") == "signup", "cascade_pause").otherwise("ok")
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("stage"), outcome.alias("outcome"))
    return control.fail_rates(control.signals(rows, "outcome"), "stage", "ts", "event_id", "failed").select("event_id", "stage", "n", "fail_rate")


def last_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC11: the cap that each stage's next batch may use."""
    events = _table(spark, sf_dir, "events").where("event_type != 'view'")
    rows = events.select("event_id", "ts", (F.col("user_id") % 12).alias("stage"), F.expr("event_type = 'error' and value > 60").alias("failed"))
    rates = control.fail_rates(rows, "stage", "ts", "event_id", "failed")
    return control.last_caps(control.cap_path(rates, "stage"), "stage")


def step_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC14: errors of a step by their class."""
    rows = _table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.concat(_picked(F.col("event_id") % 3, ("ValueError", "KeyError", "OSError")), F.lit(": item "), F.col("event_id").cast("string"))))
    return skills.error_counts(rows, "error")


def _files(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Pages as an app's files; the second version lacks some, has others and changes a few."""
    rows = _table(spark, sf_dir, "pages").where(F.col("page_id") % 10 != 8 + version)
    text = F.when((F.col("page_id") % 7 == 3) & F.lit(version == 1), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return rows.select(F.concat(F.lit("app"), (F.col("page_id") % 3).cast("string")).alias("app"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"))


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP1."""
    return updates.manifest_diff(_files(spark, sf_dir, 0), _files(spark, sf_dir, 1))


def hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP3: files that are missing or have another digest than the manifest says."""
    return updates.mismatches(_files(spark, sf_dir, 1), _files(spark, sf_dir, 0)).select("app", "path")


def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: pages and links by site."""
    return page_fields(_table(spark, sf_dir, "pages")).groupBy("site").agg(F.count("*").alias("pages"), F.sum("n_links").alias("links"))


def secondary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F.B as lists: main and secondary terms of each page title."""
    found = F.slice(terms.counted(F.col("title"), 3), 1, 5)["term"]
    rows = page_fields(_table(spark, sf_dir, "pages")).select("page_id", found.alias("t"))
    return rows.select("page_id", F.array_join(F.slice("t", 1, 2), ",").alias("main"), F.array_join(F.slice("t", 3, 3), ",").alias("secondary"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        price_table, category_model, translate_titles, first_numbers, distinct_title_words, item_steps, describe_items, reject_scan, rejected_images, reject_classes,
        image_gate, rescue_boxes, rescue_residue, mask_boxes, pool_sizes, rescued_images, failed_batches, loose_images, nested_verdicts, untitled_items,
        answers_by_schema, null_stage_caps, first_images, start_caps, stage_signals, last_caps, step_errors, manifest_changes,
        hash_check, page_sites, secondary_terms,
    )
}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_IMAGES_SQL = f"""images AS (SELECT doc_id, doc_id // 50 AS item, ({_list(KINDS)})[doc_id % 6 + 1] AS kind,
      CASE WHEN doc_id % 3 = 0 THEN 'reject-' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'mark-' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'sticky-' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'url-' ELSE '' END || doc_id AS path FROM documents)"""
_RESIDUE = f"(doc_id % 4 = 1 OR doc_id % 13 < {len(rescue.RESIDUE_CLASSES)})"
_DESCRIBED = """body AS (SELECT p_partkey, p_brand, p_size, p_type || '  ' || p_name || CASE WHEN p_size = 7 THEN chr(10) || ' weapon' ELSE '' END AS text FROM part),
      cleaned AS (SELECT p_partkey, p_brand, p_size, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM body),
      words AS (SELECT p_partkey, term, count(*) AS times FROM (SELECT p_partkey, unnest(string_split_regex(lower(clean), '[\\s.,]+')) AS term FROM cleaned) WHERE length(term) >= 4 GROUP BY 1, 2),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY times DESC, term) AS r FROM words),
      lists AS (SELECT p_partkey, string_agg(term, ' ' ORDER BY r) FILTER (r <= 2) AS main, string_agg(term, ',' ORDER BY r) FILTER (r <= 5) AS tags FROM ranked GROUP BY 1)"""


def _version_sql(version: int) -> str:
    text = "CASE WHEN page_id % 7 = 3 THEN html || '!' ELSE html END" if version else "html"
    return f"v{version} AS (SELECT 'app' || page_id % 3 AS app, 'p/' || page_id AS path, sha256({text}) AS sha256 FROM pages WHERE page_id % 10 <> {8 + version})"


ORACLE_SQL: dict[str, str] = {
    "price_table": f"""SELECT p_partkey, CAST(CAST(price * CAST({RATE} AS DECIMAL(9,4)) * mult AS DECIMAL(18,2)) AS DOUBLE) AS price_twd
      FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS price FROM part)
      LEFT JOIN (SELECT CAST(i * 2 AS DECIMAL(18,4)) AS lo, CAST(i * 2 + 2 AS DECIMAL(18,4)) AS hi, CAST(1 + i % 9 * 0.05 AS DECIMAL(9,4)) AS mult FROM range(1500) t(i)) ON price >= lo AND price < hi""",
    "category_model": "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY ANODIZED STEEL' THEN 'metal goods' ELSE lower(list_last(string_split(p_type, ' '))) END AS category FROM part",
    "translate_titles": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: reverse(w)), ' ') AS title, CAST(NULL AS VARCHAR) AS error FROM part",
    "first_numbers": "SELECT p_partkey, printf('%.2f', p_retailprice) || ' or ' || p_size AS cleaned, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS number FROM part",
    "distinct_title_words": """WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_name, ' ')) AS word, generate_subscripts(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '), 1) AS i FROM part),
      f AS (SELECT p_partkey, word, min(i) AS i FROM w WHERE word <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(word, ' ' ORDER BY i) AS title FROM f GROUP BY 1""",
    "item_steps": f"""WITH rows AS (SELECT p_partkey, p_name AS title, replace(replace(p_type, 'STEEL', 'iron'), 'ECONOMY iron', 'cheap iron') || ' 1500' AS body,
        CAST(CAST(p_retailprice AS DECIMAL(18,4)) * CAST({RATE} AS DECIMAL(9,4)) * CASE WHEN p_retailprice >= 1000 THEN CAST(1.25 AS DECIMAL(9,4)) ELSE CAST(1.5 AS DECIMAL(9,4)) END AS DECIMAL(18,2)) AS price,
        CASE WHEN p_size > 9 THEN p_brand ELSE 'no brand' END AS brand FROM part),
      kept AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY p_partkey) AS r FROM rows WHERE NOT contains(lower(body), 'brass') AND NOT contains(lower(body), 'tin'))
      SELECT p_partkey, title, CAST(price AS DOUBLE) AS price, body || chr(10) || 'Brand: ' || brand AS description FROM kept WHERE r = 1""",
    "describe_items": f"""WITH {_DESCRIBED} SELECT c.p_partkey, clean, contains(lower(text), 'weapon') AS prohibited, substring(p_brand || ' ' || main, 1, 60) AS title, p_size = 9 AS title_prohibited, tags, CAST(NULL AS VARCHAR) AS error
      FROM cleaned c JOIN lists USING (p_partkey)""",
    "reject_scan": f"""WITH {_IMAGES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY doc_id) - 1 AS i FROM images)
      SELECT doc_id, item, i // 4 AS batch, CAST(i % 4 AS INTEGER) AS position, doc_id % 3 = 0 AS rejected, CAST(NULL AS VARCHAR) AS error FROM placed""",
    "rejected_images": f"WITH {_IMAGES_SQL} SELECT doc_id, path FROM images WHERE starts_with(path, 'reject-')",
    "reject_classes": f"SELECT doc_id, doc_id % 9 < {len(verdicts.REJECT_CLASSES)} AND doc_id % 11 >= {len(verdicts.EXCEPTIONS)} AND doc_id % 4 >= 2 AS rejected FROM documents",
    "image_gate": f"WITH {_IMAGES_SQL} SELECT doc_id, kind, kind IS NULL OR kind = 'photo' AS tried FROM images",
    "rescue_boxes": """WITH boxes AS (SELECT doc_id, (doc_id * k % 16) / 16.0 AS x0, (doc_id * (k + 2) % 16) / 16.0 AS y0 FROM documents, (VALUES (1), (3), (5)) t(k)),
      outer_ones AS (SELECT * FROM boxes WHERE NOT (x0 + 0.0625 BETWEEN 0.15 AND 0.85 AND y0 + 0.03125 BETWEEN 0.15 AND 0.85))
      SELECT d.doc_id, count(o.doc_id) AS n_left, CAST(coalesce(sum(x0 + y0), 0) AS DOUBLE) AS corners FROM documents d LEFT JOIN outer_ones o USING (doc_id) GROUP BY 1""",
    "rescue_residue": f"""SELECT doc_id, {_RESIDUE} AS residue, CASE WHEN {_RESIDUE} OR doc_id % 10 = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '.new' END AS kept,
      CASE WHEN {_RESIDUE} OR doc_id % 10 = 0 THEN 'rejected' ELSE 'rescued' END AS status FROM documents""",
    "mask_boxes": """WITH points AS (SELECT doc_id, doc_id * i * 3 % 101 AS x, doc_id * i * 7 % 101 AS y FROM documents, range(1, 8) t(i) WHERE i <= doc_id % 8)
      SELECT d.doc_id, CAST(coalesce(min(x), -1) AS INTEGER) AS x0, CAST(coalesce(min(y), -1) AS INTEGER) AS y0, CAST(coalesce(max(x), -1) AS INTEGER) AS x1, CAST(coalesce(max(y), -1) AS INTEGER) AS y1 FROM documents d LEFT JOIN points p USING (doc_id) GROUP BY 1""",
    "pool_sizes": """SELECT s_suppkey, CAST(greatest(1, CASE WHEN s_suppkey % 32 >= 24 THEN 28 WHEN s_suppkey % 32 >= 12 THEN 16 WHEN s_suppkey % 32 >= 8 THEN 10 ELSE 1 END // CAST(pow(2, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 ELSE 0 END) AS INTEGER)) AS BIGINT) AS workers FROM supplier""",
    "rescued_images": f"""WITH {_IMAGES_SQL}, tried AS (SELECT *, kind IS NULL OR kind = 'photo' AS open, contains(path, 'mark') AS boxed, ends_with(path, '13') AS broken FROM images),
      done AS (SELECT *, open AND boxed AND NOT broken AND NOT contains(path, 'sticky') AND NOT contains(path, 'url') AS saved FROM tried)
      SELECT doc_id, CAST(CASE WHEN open AND boxed THEN 1 ELSE 0 END AS BIGINT) AS n_boxes, CASE WHEN saved THEN replace(path, 'mark-', '') || '.clean' ELSE path END AS kept,
        CASE WHEN saved THEN 'rescued' WHEN open THEN 'rejected' ELSE 'given up' END AS status, CASE WHEN open AND boxed AND broken THEN 'inpaint: OSError: no memory' END AS error FROM done""",
    "failed_batches": f"""WITH {_IMAGES_SQL}, placed AS (SELECT *, (row_number() OVER (PARTITION BY item ORDER BY doc_id) - 1) // 4 AS batch FROM images),
      bad AS (SELECT *, bool_or(ends_with(path, '17')) OVER b AS late, bool_or(ends_with(path, '29')) OVER b AS mute FROM placed WINDOW b AS (PARTITION BY item, batch))
      SELECT doc_id, batch, CASE WHEN late OR mute THEN 'unqualified' WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'ok' END AS status,
        CASE WHEN late THEN 'TimeoutError: no answer' WHEN mute THEN 'no readable verdict' END AS error FROM bad""",
    "loose_images": """WITH rows AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id // 100 END AS item, CASE WHEN doc_id % 7 > 0 THEN -doc_id END AS shown FROM documents),
      placed AS (SELECT doc_id, item, row_number() OVER (PARTITION BY item ORDER BY shown NULLS FIRST, doc_id) - 1 AS i FROM rows)
      SELECT doc_id, coalesce(item, -1) AS item, i // 4 AS batch, CAST(i % 4 AS INTEGER) AS position FROM placed""",
    "nested_verdicts": "SELECT doc_id, CAST(CASE WHEN doc_id % 5 <> 3 THEN doc_id ELSE -1 END AS INTEGER) AS picked, CAST(CASE WHEN doc_id % 5 <> 3 THEN 0.5 ELSE -1 END AS DOUBLE) AS score FROM documents",
    "untitled_items": r"""WITH rows AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_name END AS title FROM part)
      SELECT p_partkey, title FROM rows WHERE coalesce(trim(title), '') = '' OR p_partkey IN (SELECT min(p_partkey) FROM rows GROUP BY trim(regexp_replace(lower(title), '\s+', ' ', 'g')))""",
    "answers_by_schema": """WITH a AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 36 >= 30 AS better, '{"label": "l' || doc_id || '", "score": ' || doc_id % 100 || '}' AS whole FROM documents),
      r AS (SELECT *, k IN (0, 4) AS good FROM a)
      SELECT doc_id, CASE WHEN k = 4 AND good THEN 'm' || doc_id WHEN good OR better THEN 'l' || doc_id END AS label, CAST(CASE WHEN k = 4 THEN 1 WHEN good OR better THEN doc_id % 100 ELSE -1 END AS INTEGER) AS score,
        CASE WHEN NOT good AND NOT better THEN 'Invalid: ' || CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing: answer.score' WHEN 3 THEN 'type: answer.label is no string' ELSE 'type: answer is no object' END END AS error,
        CASE WHEN NOT good AND NOT better THEN CASE k WHEN 1 THEN whole[:-2] WHEN 2 THEN '{"label": "l"}' WHEN 3 THEN '{"label": 5, "score": 1}' ELSE '[]' END END AS answer,
        CAST(CASE WHEN good THEN 1 ELSE 2 END AS INTEGER) AS tries FROM r""",
    "null_stage_caps": """WITH RECURSIVE signals AS (SELECT nullif(user_id % 4, 0) AS stage, event_id, ts, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS failed FROM events WHERE event_type <> 'view'),
      rates AS (SELECT stage, row_number() OVER s AS seq, count(*) OVER w AS n, sum(failed) OVER w AS bad FROM signals
        WINDOW s AS (PARTITION BY stage ORDER BY ts, event_id), w AS (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
      steps AS (SELECT stage, seq // 5 AS decision, CAST(bad AS DOUBLE) / n AS fail_rate FROM rates WHERE seq % 5 = 0),
      path AS (SELECT stage, CAST(0 AS BIGINT) AS decision, CAST(NULL AS DOUBLE) AS fail_rate, CAST(8 AS BIGINT) AS cap, false AS jumped FROM (SELECT DISTINCT stage FROM steps)
        UNION ALL SELECT s.stage, s.decision, s.fail_rate,
          CAST(CASE WHEN s.fail_rate > 0.30 THEN greatest(1, p.cap // 2) WHEN s.fail_rate >= 0.15 THEN greatest(1, p.cap * 4 // 5)
            WHEN NOT p.jumped THEN greatest(p.cap, (p.cap + 64) // 2) ELSE least(64, greatest(p.cap + 1, p.cap * 5 // 4)) END AS BIGINT), p.jumped OR s.fail_rate < 0.15
        FROM path p JOIN steps s ON s.stage IS NOT DISTINCT FROM p.stage AND s.decision = p.decision + 1)
      SELECT coalesce(stage, -1) AS stage, decision, fail_rate, cap FROM path WHERE decision > 0""",
    "first_images": "SELECT p_partkey, '1-' || p_partkey || ',0-' || p_partkey || CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 1 THEN '.edited' ELSE '' END || ',2-' || p_partkey AS paths FROM part",
    "start_caps": "SELECT user_id % 12 AS stage, CAST(greatest(1, least(64, floor(60.0 * (count(*) / 100.0) / greatest(1, count(DISTINCT user_id))))) AS BIGINT) AS cap FROM events GROUP BY 1",
    "stage_signals": """WITH s AS (SELECT event_id, ts, user_id % 5 AS stage, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM events WHERE event_type NOT IN ('view', 'signup'))
      SELECT event_id, stage, count(*) OVER w AS n, CASE WHEN count(*) OVER w >= 5 THEN CAST(sum(failed) OVER w AS DOUBLE) / count(*) OVER w END AS fail_rate FROM s
      WINDOW w AS (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "step_errors": "SELECT (['ValueError', 'KeyError', 'OSError'])[event_id % 3 + 1] AS kind, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1",
    "manifest_changes": f"""WITH {_version_sql(0)}, {_version_sql(1)} SELECT app, path, CASE WHEN v0.sha256 IS NULL THEN 'add' WHEN v1.sha256 IS NULL THEN 'remove' WHEN v0.sha256 = v1.sha256 THEN 'same' ELSE 'change' END AS change
      FROM v0 FULL JOIN v1 USING (app, path)""",
    "hash_check": f"WITH {_version_sql(0)}, {_version_sql(1)} SELECT app, path FROM v1 WHERE NOT EXISTS (SELECT 1 FROM v0 WHERE v0.app = v1.app AND v0.path = v1.path AND v0.sha256 = v1.sha256)",
    "page_sites": r"SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS site, count(*) AS pages, CAST(sum(len(regexp_extract_all(html, '<a\s[^>]*href='))) AS BIGINT) AS links FROM pages GROUP BY 1",
    "secondary_terms": r"""WITH titles AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
      words AS (SELECT page_id, term, count(*) AS times FROM (SELECT page_id, unnest(string_split_regex(lower(title), '[\s.,]+')) AS term FROM titles) WHERE length(term) >= 3 GROUP BY 1, 2),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY times DESC, term) AS r FROM words)
      SELECT page_id, coalesce(string_agg(term, ',' ORDER BY r) FILTER (r <= 2), '') AS main, coalesce(string_agg(term, ',' ORDER BY r) FILTER (r BETWEEN 3 AND 5), '') AS secondary FROM titles LEFT JOIN ranked USING (page_id) GROUP BY 1""",
}
