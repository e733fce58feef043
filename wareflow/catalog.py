"""Named queries over the standard tables, and the SQL that gives the same rows.

The tables stand in for product listings: ``part`` for items, ``documents`` for descriptions and images, ``events``
for task outcomes and quota operations, ``pages`` for scraped pages.  Rates, words and tiers are made up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow import catalog_files, catalog_steps
from wareflow.functions import text as T
from wareflow.operators import items, rescue, terms, verdicts
from wareflow.plans import control, updates
from wareflow.sources.pages import page_fields

STAGES, LIMIT = 12, 2
TIERS = (("0", "905", "1.60"), ("905", "950", "1.45"), ("950", "1500", "1.30"), ("1500", "100000", "1.20"))
RATE = "0.2150"
CATEGORIES = (("ECONOMY ANODIZED STEEL", "metal goods"), ("STANDARD POLISHED BRASS", "brassware"), ("SMALL PLATED COPPER", "copperware"), ("PROMO BURNISHED NICKEL", "promotions"), ("LARGE BRUSHED TIN", "tinware"))
WORDS = (("the", "THE"), ("THE thing", "that thing"), ("eux", "x"), ("und", "&"))
KEYWORDS = ("idiot", "clown", "license", "moron")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(spark: SparkSession, sf_dir: str, failed: Column) -> DataFrame:
    """Events but for views, with a stage and whether they failed."""
    rows = _table(spark, sf_dir, "events").where("event_type != 'view'")
    return rows.select("event_id", "ts", (F.col("user_id") % STAGES).alias("stage"), failed.alias("failed"))


_FAILED = "event_type = 'error'"
_MILD = "event_type = 'error' and value > 60"


def rolling_fail_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = control.fail_rates(_signals(spark, sf_dir, F.expr(_FAILED)), "stage", "ts", "event_id", "failed")
    return rates.select("event_id", "stage", "n", "fail_rate")


def _caps(failed: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rates = control.fail_rates(_signals(spark, sf_dir, F.expr(failed)), "stage", "ts", "event_id", "failed")
        return control.cap_path(rates, "stage").select("stage", "decision", "fail_rate", "cap")

    return query


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where("event_type != 'view'").withColumn("product", F.col("event_id") % 7)
    return control.attributed(rows, "user_id", "ts", "event_id", "product", F.expr(_FAILED))


def quota_day_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("product", F.col("event_id") % 7)
    used = control.day_usage(rows, "user_id", "ts", "product", F.col("event_type").isin("click", "purchase", "signup"))
    return used.withColumn("quota_day", F.col("quota_day").cast("string"))


def quota_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.ledger(_operations(spark, sf_dir), LIMIT).withColumn("quota_day", F.col("quota_day").cast("string"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.usage(_table(spark, sf_dir, "events"), "ts", "user_id", "event_type").withColumn("quota_day", F.col("quota_day").cast("string"))


def price_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", items.convert_price(F.col("p_retailprice"), RATE, TIERS).cast("double").alias("price_twd"))


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(CATEGORIES, "src string, dst string")
    return items.map_category(_table(spark, sf_dir, "part"), table, "p_type").select("p_partkey", "p_type", "category")


def replace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.replace_words(F.col("text"), WORDS).alias("text"))


def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean_numbers(F.col("text")).alias("text"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.keyword_filter(_table(spark, sf_dir, "documents"), "text", KEYWORDS).select("doc_id", "hit", "keep")


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return items.fill_defaults(rows, {"lang": "xx", "quality": -1, "toxic": 0}).select("doc_id", "lang", "quality", "toxic")


def title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.dedup_titles(_table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "p_name")


def append_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lit("Size: "), F.col("p_size").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", items.append_template(F.col("p_name"), F.concat(F.lit("Brand: "), "p_brand"), size, F.lit("Ships in three days.")).alias("description"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields(_table(spark, sf_dir, "pages")).select("page_id", "title", "site", "n_links")


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(_table(spark, sf_dir, "documents"), "doc_id", "text")


def search_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.slice(terms.counted(F.col("text")), 1, 5)["term"]
    rows = _table(spark, sf_dir, "documents").select("doc_id", found.alias("terms")).where(F.size("terms") > 0)
    return rows.select("doc_id", terms.search_title(F.lit("Shop"), F.slice("terms", 1, 2)).alias("title"), F.array_join(terms.tags(F.col("terms")), ",").alias("tags"))


def image_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _table(spark, sf_dir, "documents").select(F.col("source").alias("item"), "doc_id")
    return verdicts.batches(images, "item", "doc_id", F.floor(F.col("doc_id") / 4096)).select("doc_id", "item", "batch", "position")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers to batches, made up from labels: prose around JSON, some of it malformed."""
    labels = _table(spark, sf_dir, "labels")
    positions = F.concat_ws(",", F.when(F.col("quality") == 0, "0"), F.when(F.col("toxic") == 1, "2"), F.when(F.col("doc_id") % 5 == 0, "7"))
    scores = F.concat_ws(",", F.when(F.col("quality") == 0, "0.75"), F.when(F.col("toxic") == 1, "0.5"), F.when(F.col("doc_id") % 5 == 0, "0.25"))
    json = F.concat(F.lit('{"reject_indices":['), positions, F.lit('],"reject_scores":['), scores, F.lit("]}"))
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit('{"reject_indices":[0,1],"reject_scores":[')).otherwise(F.concat(F.lit("Verdict: "), json, F.lit(" {checked}")))
    return labels.select("doc_id", raw.alias("raw"), F.lit(4).alias("n_images"))


def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.flattened(_answers(spark, sf_dir), "doc_id", "raw", "n_images")


def ok_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).cast("long").alias("batch"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    bad = rows.where("toxic = 1").select("batch").distinct().withColumn("error", F.lit("prohibited"))
    marked = rows.join(bad, "batch", "left")
    ok, failed = verdicts.split(marked, "error")
    return ok.select("doc_id", "batch", F.lit("ok").alias("status")).unionByName(failed.select("doc_id", "batch", F.lit("unqualified").alias("status")))


def verify_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("candidate", F.regexp_replace("html", "<script>[^<]*(<[^<]*)?</script>", ""))
    left = F.contains("candidate", F.lit("&amp;")) | F.contains("candidate", F.lit("<script"))
    return rescue.commit_or_roll_back(pages, "html", "candidate", left, "kept").select("page_id", "status", F.md5("kept").alias("kept_md5"))


#: What stands before and after a file's name: safe at first, then ways out of the folder, then safe again.
PATHS = (("a/", ""), ("../", ""), ("/abs/", ""), ("C:\\", ""), ("a..b/", ""), ("a/", "/../../x"), ("a\\..\\", ""))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP4 and UP5: pages as the files of three apps, with safe and unsafe paths, held against whitelists."""
    n = F.col("page_id")
    at = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PATHS]), (n % len(PATHS) + 1).cast("int"))
    files = _table(spark, sf_dir, "pages").select(F.concat(F.lit("app"), (n % 3).cast("string")).alias("app"), F.concat(at(0), n.cast("string"), at(1)).alias("path"), F.sha2("html", 256).alias("sha256"), n)
    white = files.where("page_id % 4 != 1").select("app", "path")
    taken = updates.allowed(files, white).select("app", "path", "sha256", F.lit("allowed").alias("verdict"))
    return taken.unionByName(updates.refused(files, white).select("app", "path", "sha256", F.col("reason").alias("verdict")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rolling_fail_rate": rolling_fail_rate,
    "adaptive_cap": _caps(_FAILED),
    "adaptive_cap_mild": _caps(_MILD),
    "quota_day_usage": quota_day_usage,
    "quota_ledger": quota_ledger,
    "usage_rollup": usage_rollup,
    "price_tiers": price_tiers,
    "category_map": category_map,
    "replace_words": replace_words,
    "clean_numbers": clean_numbers,
    "keyword_filter": keyword_filter,
    "fill_defaults": fill_defaults,
    "title_dedup": title_dedup,
    "append_template": append_template,
    "page_title": page_title,
    "top_terms": top_terms,
    "search_titles": search_titles,
    "image_batches": image_batches,
    "parse_verdict": parse_verdict,
    "ok_reject_split": ok_reject_split,
    "verify_rollback": verify_rollback,
    "manifest_check": manifest_check,
} | catalog_steps.QUERIES | catalog_files.QUERIES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rates_sql(failed: str) -> str:
    return f"""
      signals AS (SELECT event_id, user_id % {STAGES} AS stage, CASE WHEN {failed} THEN 1 ELSE 0 END AS failed, ts FROM events WHERE event_type <> 'view'),
      rates AS (SELECT event_id, stage, row_number() OVER s AS seq, count(*) OVER w AS n, sum(failed) OVER w AS bad FROM signals
        WINDOW s AS (PARTITION BY stage ORDER BY ts, event_id), w AS (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
      marked AS (SELECT event_id, stage, seq, n, CASE WHEN n >= 5 THEN CAST(bad AS DOUBLE) / n END AS fail_rate FROM rates)"""


def _cap_sql(failed: str) -> str:
    return f"""WITH RECURSIVE {_rates_sql(failed)},
      steps AS (SELECT stage, seq // 5 AS decision, fail_rate FROM marked WHERE seq % 5 = 0 AND fail_rate IS NOT NULL),
      path AS (
        SELECT stage, CAST(0 AS BIGINT) AS decision, CAST(NULL AS DOUBLE) AS fail_rate, CAST(8 AS BIGINT) AS cap, false AS jumped FROM (SELECT DISTINCT stage FROM steps)
        UNION ALL
        SELECT s.stage, s.decision, s.fail_rate,
          CAST(CASE WHEN s.fail_rate > 0.30 THEN greatest(1, p.cap // 2) WHEN s.fail_rate >= 0.15 THEN greatest(1, p.cap * 4 // 5)
            WHEN NOT p.jumped THEN greatest(p.cap, (p.cap + 64) // 2) ELSE least(64, greatest(p.cap + 1, p.cap * 5 // 4)) END AS BIGINT),
          p.jumped OR s.fail_rate < 0.15
        FROM path p JOIN steps s ON s.stage = p.stage AND s.decision = p.decision + 1)
      SELECT stage, decision, fail_rate, cap FROM path WHERE decision > 0"""


def _nested(column: str) -> str:
    for old, new in WORDS:
        column = f"replace({column}, {_text(old)}, {_text(new)})"
    return column


_DAY = "CAST(ts - INTERVAL 2 HOUR AS DATE)"
_TOP_SQL = """words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\\s.,]+')) AS term FROM documents),
      counts AS (SELECT doc_id, term, count(*) AS times FROM words WHERE length(term) >= 4 GROUP BY doc_id, term),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, term) AS rank FROM counts)"""

ORACLE_SQL: dict[str, str] = {
    "rolling_fail_rate": f"WITH {_rates_sql(_FAILED)} SELECT event_id, stage, n, fail_rate FROM marked",
    "adaptive_cap": _cap_sql(_FAILED),
    "adaptive_cap_mild": _cap_sql(_MILD),
    "quota_day_usage": f"SELECT user_id AS tenant, CAST({_DAY} AS VARCHAR) AS quota_day, count(DISTINCT event_id % 7) AS units FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY 1, 2",
    "quota_ledger": f"""WITH RECURSIVE
      ops AS (SELECT user_id AS tenant, ts, event_id, event_id % 7 AS product, event_type = 'error' AS refund FROM events WHERE event_type <> 'view'),
      placed AS (SELECT tenant, event_id, ts, product, refund,
          coalesce(last_value(CASE WHEN NOT refund THEN {_DAY} END IGNORE NULLS) OVER (PARTITION BY tenant, product ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {_DAY}) AS quota_day FROM ops),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant, quota_day ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY tenant, quota_day) AS of FROM placed),
      fold AS (
        SELECT tenant, quota_day, CAST(0 AS BIGINT) AS i, of, CAST([] AS BIGINT[]) AS admitted, CAST(0 AS BIGINT) AS denied, CAST(0 AS BIGINT) AS refunded FROM numbered WHERE i = 1
        UNION ALL
        SELECT f.tenant, f.quota_day, n.i, f.of,
          CASE WHEN n.refund THEN list_filter(f.admitted, lambda x: x <> n.product)
            WHEN NOT list_contains(f.admitted, n.product) AND len(f.admitted) < {LIMIT} THEN list_append(f.admitted, n.product) ELSE f.admitted END,
          f.denied + CASE WHEN NOT n.refund AND NOT list_contains(f.admitted, n.product) AND len(f.admitted) >= {LIMIT} THEN 1 ELSE 0 END,
          f.refunded + CASE WHEN n.refund AND list_contains(f.admitted, n.product) THEN 1 ELSE 0 END
        FROM fold f JOIN numbered n ON n.tenant = f.tenant AND n.quota_day = f.quota_day AND n.i = f.i + 1)
      SELECT tenant, CAST(quota_day AS VARCHAR) AS quota_day, CAST(len(admitted) AS BIGINT) AS used, denied, refunded FROM fold WHERE i = of""",
    "usage_rollup": f"SELECT CAST({_DAY} AS VARCHAR) AS quota_day, event_type AS kind, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "price_tiers": "SELECT p_partkey, CAST(CAST(CAST(p_retailprice AS DECIMAL(18,4)) * CAST("
    + RATE
    + " AS DECIMAL(9,4)) * CASE "
    + " ".join(f"WHEN CAST(p_retailprice AS DECIMAL(18,4)) >= {a} AND CAST(p_retailprice AS DECIMAL(18,4)) < {b} THEN CAST({m} AS DECIMAL(9,4))" for a, b, m in TIERS)
    + " END AS DECIMAL(18,2)) AS DOUBLE) AS price_twd FROM part",
    "category_map": "SELECT p_partkey, p_type, coalesce(dst, 'unmapped') AS category FROM part LEFT JOIN (VALUES " + ", ".join(f"({_text(a)}, {_text(b)})" for a, b in CATEGORIES) + ") m(src, dst) ON p_type = src",
    "replace_words": f"SELECT doc_id, {_nested('text')} AS text FROM documents",
    "clean_numbers": r"""WITH marked AS (SELECT doc_id, regexp_replace(regexp_replace(translate(text, '０１２３４５６７８９，．', '0123456789,.'), '[¥￥$€] *([0-9])', '\1', 'g'), '([0-9]) *[円元]', '\1', 'g') AS t FROM documents),
      parts AS (SELECT doc_id, unnest(string_split(t, ',')) AS part, generate_subscripts(string_split(t, ','), 1) AS i FROM marked),
      joined AS (SELECT doc_id, i, part, lag(part) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM parts)
      SELECT doc_id, string_agg(CASE WHEN i = 1 THEN '' WHEN regexp_matches(before, '[0-9]$') AND regexp_matches(part, '^[0-9]{3}([^0-9]|$)') THEN '' ELSE ',' END || part, '' ORDER BY i) AS text FROM joined GROUP BY doc_id""",
    "keyword_filter": f"SELECT doc_id, lower(regexp_extract(text, '(?i)({'|'.join(KEYWORDS)})', 1)) AS hit, NOT regexp_matches(text, '(?i)({'|'.join(KEYWORDS)})') AS keep FROM documents",
    "fill_defaults": "SELECT d.doc_id, coalesce(nullif(lang, ''), 'xx') AS lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "title_dedup": r"SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) ORDER BY p_partkey) AS r FROM part) WHERE r = 1",
    "append_template": r"SELECT p_partkey, concat_ws(chr(10), p_name, 'Brand: ' || p_brand, 'Size: ' || CAST(p_size AS VARCHAR), 'Ships in three days.') AS description FROM part",
    "page_title": r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS site, CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS BIGINT) AS n_links FROM pages",
    "top_terms": f"WITH {_TOP_SQL} SELECT doc_id, term, times, rank, CASE WHEN rank <= 2 THEN 'main' ELSE 'secondary' END AS role FROM ranked WHERE rank <= 5",
    "search_titles": f"WITH {_TOP_SQL} SELECT doc_id, substring('Shop ' || string_agg(term, ' ' ORDER BY rank) FILTER (rank <= 2), 1, 60) AS title, string_agg(term, ',' ORDER BY rank) AS tags FROM ranked WHERE rank <= 5 GROUP BY doc_id",
    "image_batches": "SELECT doc_id, source AS item, (row_number() OVER s - 1) // 4 AS batch, CAST((row_number() OVER s - 1) % 4 AS INTEGER) AS position FROM documents WINDOW s AS (PARTITION BY source ORDER BY doc_id)",
    "parse_verdict": """SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(score AS DOUBLE) AS score FROM (
      SELECT doc_id, 0 AS position, 0.75 AS score FROM labels WHERE quality = 0 AND doc_id % 11 <> 0 UNION ALL
      SELECT doc_id, 2, 0.5 FROM labels WHERE toxic = 1 AND doc_id % 11 <> 0)""",
    "ok_reject_split": """WITH bad AS (SELECT DISTINCT doc_id // 4 AS batch FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
      SELECT doc_id, doc_id // 4 AS batch, CASE WHEN bad.batch IS NULL THEN 'ok' ELSE 'unqualified' END AS status FROM documents d LEFT JOIN bad ON bad.batch = d.doc_id // 4""",
    "verify_rollback": """WITH made AS (SELECT page_id, html, regexp_replace(html, '<script>[^<]*(<[^<]*)?</script>', '', 'g') AS candidate FROM pages),
      checked AS (SELECT *, contains(candidate, '&amp;') OR contains(candidate, '<script') AS residue FROM made)
      SELECT page_id, CASE WHEN residue THEN 'rejected' ELSE 'rescued' END AS status, md5(CASE WHEN residue THEN html ELSE candidate END) AS kept_md5 FROM checked""",
    "manifest_check": "SELECT 'app' || page_id % 3 AS app, (["
    + ", ".join(_text(p[0]) for p in PATHS)
    + f"])[page_id % {len(PATHS)} + 1] || page_id || (["
    + ", ".join(_text(p[1]) for p in PATHS)
    + f"])[page_id % {len(PATHS)} + 1] AS path, sha256(html) AS sha256, CASE WHEN page_id % {len(PATHS)} NOT IN (0, 4) THEN 'unsafe path' WHEN page_id % 4 = 1 THEN 'not on the whitelist' ELSE 'allowed' END AS verdict FROM pages",
    "live_caps": f"SELECT stage, decision, fail_rate, cap, last_value(cap) OVER (PARTITION BY stage ORDER BY decision ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM ({_cap_sql(_MILD)})",
    "last_caps": f"SELECT stage, arg_max(cap, decision) AS cap FROM ({_cap_sql(_MILD)}) GROUP BY stage",
} | catalog_steps.ORACLE_SQL | catalog_files.ORACLE_SQL
