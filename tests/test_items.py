from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from wareflow.functions import text as T
from wareflow.operators import items, terms
from wareflow.operators.skills import Skill

TIERS = (("0", "100", "2"), ("100", "200", "1.5"))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_price_tiers_and_their_borders(spark):
    rows = spark.createDataFrame([(1, Decimal("0")), (2, Decimal("99.9999")), (3, Decimal("100")), (4, Decimal("200")), (5, Decimal("-1")), (6, None)], "id int, price decimal(18,4)")
    got = {r.id: r.twd for r in rows.select("id", items.convert_price(F.col("price"), "0.5", TIERS).alias("twd")).collect()}
    assert got == {1: Decimal("0.00"), 2: Decimal("100.00"), 3: Decimal("75.00"), 4: None, 5: None, 6: None}
    table = spark.createDataFrame([(Decimal(a), Decimal(b), Decimal(m)) for a, b, m in TIERS], "lo decimal(18,4), hi decimal(18,4), mult decimal(9,4)")
    assert {r.id: r.twd for r in items.convert_price_by_table(rows, table, "price", "0.5", "twd").collect()} == got


def test_many_tiers_and_clashing_names(spark):
    tiers = spark.range(1500).selectExpr("cast(id as decimal(18,4)) lo", "cast(id + 1 as decimal(18,4)) hi", "cast(id % 7 + 1 as decimal(9,4)) mult")
    rows = spark.range(1500).selectExpr("id", "cast(id + 0.5 as decimal(18,4)) price", "'x' lo", "'y' mult", "1 bucket")
    got = items.convert_price_by_table(rows, tiers, "price", "1", "twd")
    assert got.columns == ["id", "price", "lo", "mult", "bucket", "twd"] and got.where("twd is null or lo != 'x'").count() == 0
    assert got.where("twd != round((id + 0.5) * (id % 7 + 1), 2)").count() == 0
    mapped = items.map_category(spark.createDataFrame([("a", 1, 2)], "c string, src int, dst int"), spark.createDataFrame([("a", "A")], "src string, dst string"), "c")
    assert tuple(mapped.first()) == ("a", 1, 2, "A")


def test_a_model_for_categories_without_a_mapping(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "big thing"), (3, None), (4, "bad")], "i int, c string")

    def guess(xs):
        if xs[0]["text"] == "bad":
            raise ValueError("no")
        return [x["text"].split()[-1] for x in xs]

    got = items.map_category(rows, spark.createDataFrame([("a", "A")], "src string, dst string"), "c", model=Skill("guess", "string", guess, batch=1))
    assert {r.i: r.category for r in got.collect()} == {1: "A", 2: "thing", 3: "unmapped", 4: "unmapped"}


def test_replacements_go_in_order(spark):
    assert one(spark, T.replace_words(F.lit("a.b"), [("a", "b"), ("b", "c"), (".", "-")]).alias("x")).x == "c-c"


def test_numbers(spark):
    texts = ["1,200円", "¥ 3.5", "１，２３４，５６７", "no digits", "", None, "1,2345", "1,234,567,890", "12345678901234567.25"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    cleaned = [r[0] for r in rows.select(T.clean_numbers(F.col("t"))).collect()]
    assert cleaned == ["1200", "3.5", "1234567", "no digits", "", None, "1,2345", "1234567890", "12345678901234567.25"]
    numbers = [r[0] for r in rows.select(T.first_number(T.clean_numbers(F.col("t")))).collect()]
    assert numbers == [Decimal(1200), Decimal("3.5"), Decimal(1234567), None, None, None, Decimal(1), Decimal(1234567890), Decimal("12345678901234567.25")]


def test_keywords_are_literal_and_ignore_case(spark):
    rows = spark.createDataFrame([(1, "A C++ book"), (2, "二手商品"), (3, "plain"), (4, None), (5, "caaat")], "i int, t string")
    got = {r.i: r.hit for r in items.keyword_filter(rows, "t", ["c++", "二手", "ca*t"]).collect()}
    assert got == {1: "c++", 2: "二手", 3: "", 4: "", 5: ""}
    assert items.keyword_filter(rows, "t", []).where("keep").count() == 5


def test_categories(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, c string")
    table = spark.createDataFrame([("a", "A"), ("a", "B")], "src string, dst string")
    assert {r.i: r.category for r in items.map_category(rows, table, "c").collect()} == {1: "A", 2: "unmapped", 3: "unmapped"}


def test_titles_dedup_twice_is_once(spark):
    rows = spark.createDataFrame([(3, "A  b"), (1, "a B "), (2, "c"), (4, "C"), (5, None), (6, "")], "i int, t string")
    first = items.dedup_titles(rows, "i", "t")
    assert sorted(r.i for r in first.collect()) == [1, 2, 5, 6]
    assert sorted(items.dedup_titles(first, "i", "t").collect()) == sorted(first.collect())
    assert one(spark, T.distinct_words(F.lit("red bag red  new bag")).alias("x")).x == "red bag new"


def test_defaults_and_templates(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", 3)], "i int, a string, b int")
    assert {(r.i, r.a, r.b) for r in items.fill_defaults(rows, {"a": "x", "b": 9}).collect()} == {(1, "x", 9), (2, "x", 3)}
    assert one(spark, items.append_template(F.lit("d"), F.lit(None).cast("string"), F.lit("t")).alias("x")).x == "d\nt"


def test_terms_break_ties_by_name(spark):
    rows = spark.createDataFrame([(1, "beta alpha beta gamma alpha, Delta."), (2, ""), (3, None)], "i int, t string")
    got = [(r.rank, r.term, r.times, r.role) for r in terms.top_terms(rows, "i", "t", 2, 1).orderBy("rank").collect()]
    assert got == [(1, "alpha", 2, "main"), (2, "beta", 2, "main"), (3, "delta", 1, "secondary")]
    assert one(spark, terms.search_title(F.lit("B"), F.array(F.lit("x" * 80))).alias("x")).x == ("B " + "x" * 80)[:60]
    assert one(spark, terms.tags(F.array(*map(F.lit, "aabcdefg"))).alias("x")).x == list("abcde")


def test_translation_sees_each_text_once_and_keeps_errors(spark):
    def shout(xs):
        if any(x["_text"] == "bad" for x in xs):
            raise ValueError("no")
        return [x["_text"].upper() for x in xs]

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "i int, t string")
    got = {r.i: (r.out, r.out_error) for r in items.translate(rows, "t", Skill("shout", "string", shout, batch=1), "out").collect()}
    assert got == {1: ("A", None), 2: ("A", None), 3: (None, "ValueError: no"), 4: (None, None)}
