"""Merkle manifests of datasets: a tree of digests for each group of rows, and one over the groups' roots.

Level by level, as DataFrames: rows get their number within their tree in the stated order; numbers divided by the
fanout name the parents, whose children are collected in order (at most ``fanout``) and hashed.  Each level is a
written table, which ends the lineage there.  Proofs then come down from the root: at each level the parents' paths
meet their children in a join, and each child's path is its own siblings followed by its parent's.

Numbering does not put a tree into one task: rows are sorted into ranges of (tree, order, digest, tie) by Spark's range
partitioning, numbered within a range, and the ranges' counts are summed up.  The tie is a number that each row got when
it was written, so even a row that is repeated a billion times spreads over ranges.

H is the lowercase hex SHA-256 of its inputs, digests as hex text; tables hold digests as bytes.

Defined cases: a null field counts as ``-`` in a leaf, an empty one as ``0:``; rows without a group form a tree of their
own, the first; rows without an order value come first in their tree, and rows of equal order are ordered by their leaf;
a repeated row is a leaf each time; a tree of one row has its leaf as root; an empty table gives an empty one.  Columns
that are not named are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.functions.sequence import numbered
from wareflow.llm.shared import looked_up, saved, shuffled_join

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest.
_SIZE = 32


def written_field(value: Column) -> Column:
    """How a field goes into a leaf: ``-`` for null, else its bytes' number, a colon and itself as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """H of the fields, as hex."""
    return F.sha2(F.concat(*map(written_field, values)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _parent(children: Column) -> Column:
    """H of an array of digests, as bytes."""
    return F.unhex(F.sha2(F.array_join(F.transform(children, _hex), ""), 256))


def _indexed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows``, written, with ``_idx``: the row's number from 0 within ``tree`` by ``order``, ties in any order."""
    keys = [*order, "_tie"]
    tied = saved(rows.withColumn("_tie", F.monotonically_increasing_id()))
    ranged = saved(tied.repartitionByRange(tree, *keys).withColumn("_range", F.spark_partition_id()))
    found = numbered(ranged, [tree], F.col("_range"), keys, "_seq")
    return found.withColumn("_idx", F.col("_seq") - 1).drop("_seq", "_range", "_tie")


def _levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all trees from the leaves up, and the roots (_tree, _idx = 0, _hash).

    ``nodes`` has _tree, _n (the number of its tree's nodes), _idx, _hash; what else it has stays with the leaves.  A
    level has a row a parent: _tree, _n, _idx (the parent's) and _kids in order.  A tree that is down to one node
    keeps it while others go on.
    """
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("_n")).first()[0]
    while not levels or most > 1:
        kid = F.struct("_idx", *[c for c in nodes.columns if c not in ("_tree", "_n", "_idx")])
        up = F.expr(f"_idx div {fanout}").alias("_up")
        grouped = nodes.groupBy("_tree", "_n", up).agg(F.sort_array(F.collect_list(kid)).alias("_kids"))
        levels.append(saved(grouped.withColumnRenamed("_up", "_idx")))
        hashes = F.col("_kids")["_hash"]
        made = F.when(F.col("_n") == 1, hashes[0]).otherwise(_parent(hashes))
        nodes = levels[-1].select("_tree", F.expr(f"(_n + {fanout - 1}) div {fanout}").alias("_n"), "_idx", made.alias("_hash"))
        most = -(-most // fanout)
    return levels, nodes


def _down(level: DataFrame, paths: DataFrame) -> DataFrame:
    """The children of a level with their paths, from ``paths`` (_tree, _idx, _before, _after, _siblings, more) of the parents."""
    both = shuffled_join(level, paths, ["_tree", "_idx"], "inner")
    more = [c for c in paths.columns if c not in ("_tree", "_idx", "_before", "_after", "_siblings")]
    each = both.select("_tree", "_n", "_kids", "_before", "_after", "_siblings", *more, F.posexplode("_kids").alias("_at", "_kid"))
    others = F.filter(F.col("_kids")["_hash"], lambda h, i: i != F.col("_at"))
    beside = F.aggregate(others, F.lit(b""), lambda acc, h: F.concat(acc, h))
    alone = F.col("_n") == 1

    def longer(path: str, number: Column) -> Column:
        return F.when(alone, F.col(path)).otherwise(F.concat(F.array(number.cast("byte")), F.col(path))).alias(path)

    return each.select(
        "_tree",
        F.col("_kid._idx").alias("_idx"),
        longer("_before", F.col("_at")),
        longer("_after", F.size("_kids") - 1 - F.col("_at")),
        F.when(alone, F.col("_siblings")).otherwise(F.concat(beside, F.col("_siblings"))).alias("_siblings"),
        "_kid",
        *more,
    )


def folded(start: Column, before: Column, after: Column, siblings: Column) -> Column:
    """The root that a leaf (hex) leads to: at each step H of the siblings before it, itself, and those after it."""

    def part(at: Column, number: Column) -> Column:
        return _hex(F.substring(siblings, at, number * _SIZE))

    def step(acc: Column, n: Column) -> Column:
        b, a = n["before"].cast("int"), n["after"].cast("int")
        joined = F.concat(part(acc["at"], b), acc["h"], part(acc["at"] + b * _SIZE, a))
        return F.struct(F.sha2(joined, 256).alias("h"), (acc["at"] + (a + b) * _SIZE).alias("at"))

    steps = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(steps, F.struct(start.alias("h"), F.lit(1).alias("at")), step)["h"]


def manifest(leaves: DataFrame, tree: Column, order: Column, digest: Column, kept: Column, fanout: int = FANOUT) -> DataFrame:
    """(tree, order, kept, leaf, subroot, root, before, after, siblings) of each row; digests as hex but for siblings.

    ``siblings`` are the digests beside the row's path from the leaf up, as bytes one after the other; at step k
    ``before[k]`` of them stand before the path and ``after[k]`` after it.  ``kept`` is a column that travels along.
    """
    if not 2 <= fanout <= 127:
        raise ValueError("the fanout is 2 to 127")
    rows = leaves.select(F.struct(tree.alias("of")).alias("_of"), order.alias("_order"), F.unhex(digest).alias("_hash"), kept.alias("_kept"))
    rows = saved(_indexed(rows, "_of", ["_order", "_hash"]))
    spark = leaves.sparkSession
    sizes = saved(rows.groupBy("_of").agg(F.count("*").alias("_n")))
    trees = sizes.count()
    if not trees:
        kinds = dict(rows.dtypes) | {"_of": rows.schema["_of"].dataType.fields[0].dataType.simpleString()}
        return spark.createDataFrame([], f"tree {kinds['_of']}, order {kinds['_order']}, kept {kinds['_kept']}, leaf string, subroot string, root string, before array<tinyint>, after array<tinyint>, siblings binary")
    numbers = _indexed(sizes.withColumn("_all", F.lit(0)), "_all", ["_of"]).select("_of", "_n", F.col("_idx").alias("_tree"))
    nodes = looked_up(rows, numbers, ["_of"], ["_idx"])
    levels, subroots = _levels(nodes.select("_tree", "_n", "_idx", "_hash", "_of", "_order", "_kept"), fanout)
    upper, top = _levels(subroots.select(F.lit(0).alias("_tree"), F.lit(trees).cast("long").alias("_n"), F.col("_tree").alias("_idx"), "_hash"), fanout)
    none = F.array().cast("array<tinyint>")
    paths = top.select("_tree", "_idx", none.alias("_before"), none.alias("_after"), F.lit(b"").alias("_siblings"))
    for level in reversed(upper):
        paths = _down(level, paths).drop("_kid")
    # A tree's root has the path of its node in the tree of roots.
    paths = paths.select(F.col("_idx").alias("_tree"), F.lit(0).cast("long").alias("_idx"), "_before", "_after", "_siblings")
    paths = shuffled_join(paths, subroots.select("_tree", F.col("_hash").alias("_subroot")), ["_tree"], "inner")
    for k, level in reversed(list(enumerate(levels))):
        found = _down(level, paths)
        paths = found if k == 0 else found.drop("_kid")
    root = bytes(top.first()["_hash"]).hex()
    return paths.select(
        F.col("_kid._of.of").alias("tree"),
        F.col("_kid._order").alias("order"),
        F.col("_kid._kept").alias("kept"),
        _hex(F.col("_kid._hash")).alias("leaf"),
        _hex(F.col("_subroot")).alias("subroot"),
        F.lit(root).alias("root"),
        F.col("_before").alias("before"),
        F.col("_after").alias("after"),
        F.col("_siblings").alias("siblings"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the manifest of ``documents``, and what tampered rows lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = manifest(docs, F.col("lang"), F.col("doc_id"), leaf(*fields), F.when(tampered, F.unhex(leaf(*more))))
    start = F.coalesce(_hex(F.col("kept")), F.col("leaf"))
    end = folded(start, F.col("before"), F.col("after"), F.col("siblings"))
    rows = found.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(_hex(F.col("siblings")), 256).alias("proof_sha256"), end.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    fields = [n_chars if c == "n_chars" else c for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"

ORACLE_SQL = f"""WITH RECURSIVE
  leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql("(n_chars + 1)")} END AS changed FROM documents),
  trees AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang),
  placed AS (SELECT l.*, t.tree, t.n, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang),
  nodes AS (SELECT 0 AS level, tree, n, idx, leaf AS h FROM placed
    UNION ALL SELECT level + 1, tree, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, tree, n, idx // 2),
  subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
  top AS (SELECT 0 AS level, (SELECT count(*) FROM trees) AS n, tree AS idx, h FROM subroots
    UNION ALL SELECT level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 2),
  asked AS (SELECT p.tree, p.idx, k.level, p.idx >> k.level AS spot FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) k USING (tree)),
  steps AS (SELECT a.tree, a.idx, a.level, a.spot, s.h FROM asked a LEFT JOIN nodes s ON s.tree = a.tree AND s.level = a.level AND s.idx = xor(a.spot, 1)
    UNION ALL SELECT p.tree, p.idx, 1000 + k.level, p.tree >> k.level, s.h FROM placed p, (SELECT DISTINCT level FROM top WHERE n > 1) k LEFT JOIN top s ON s.level = k.level AND s.idx = xor(p.tree >> k.level, 1)),
  paths AS (SELECT tree, idx, coalesce(string_agg(h, '' ORDER BY level), '') AS proof, list(CASE WHEN h IS NULL THEN '-' WHEN spot & 1 = 1 THEN 'R' || h ELSE 'L' || h END ORDER BY level) AS s FROM steps GROUP BY tree, idx),
  folds AS (SELECT p.*, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
      list_reduce([coalesce(changed, leaf)] || coalesce(s, []), lambda a, x: sha256(CASE x[1] WHEN 'R' THEN x[2:] || a WHEN 'L' THEN a || x[2:] ELSE a END)) AS folded_root
    FROM placed p JOIN subroots r USING (tree) LEFT JOIN paths USING (tree, idx))
  SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds"""
