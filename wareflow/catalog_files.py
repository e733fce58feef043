"""Queries over files that Spark derives from the standard tables: pictures, archives, workbooks and logs."""

from __future__ import annotations

import base64
import contextlib
import gzip
import os
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

from wareflow.operators import rasters
from wareflow.operators.skills import Pause
from wareflow.plans import control, runner, steps, updates
from wareflow.sources import archives, parts, sinks, tables
from wareflow.streaming import control as streaming

#: The size of a drawn picture and of the mark in its corner.
WIDTH, HEIGHT, MARKED = 24, 16, (5, 4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wareflow-")
    return f"{base.rstrip('/').removeprefix('file://')}/files/{uuid.uuid4().hex}"


def _drawn(n: int) -> bytes:
    """Six kinds of picture: no mark, a mark, a mark and an address, a mark in the middle, a mark beside a faint column, a damaged file."""
    x, y = np.meshgrid(np.arange(WIDTH), np.arange(HEIGHT))
    pixels = ((n * 31 + x * 7 + y * 13) % 200).astype(np.uint8)
    kind, (w, h) = n % 6, MARKED
    if kind in (1, 2, 4):
        pixels[:h, :w] = rasters.MARK
    if kind == 2:
        pixels[HEIGHT - 1, WIDTH - 1] = rasters.ADDRESS
    if kind == 3:
        pixels[6:10, 10:14] = rasters.MARK
    if kind == 4:
        pixels[:h, w] = rasters.FAINT + 1
    data = rasters.write_png(pixels[:, :, None])
    return data[:-20] if kind == 5 else data


@F.pandas_udf(BinaryType())
def _pictures(ids: pd.Series) -> pd.Series:
    return ids.map(_drawn)


@F.pandas_udf(LongType())
def _pixel_sums(files: pd.Series) -> pd.Series:
    def total(data: bytes) -> int:
        try:
            return int(rasters.read_png(data).sum())
        except rasters.NotAPicture:
            return -1

    return files.map(total)


def rescued_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K0.3 to K0.8 on pixels: marks are located, inpainted under their mask, and the bytes that were made are verified."""
    n = F.col("doc_id")
    images = _table(spark, sf_dir, "documents").select("doc_id", F.when(n % 10 == 7, "screenshot").otherwise("photo").alias("kind"), _pictures(n).alias("picture"))
    found = steps.rescued(images, "picture", "kind", **rasters.PIXEL_SKILLS)
    return found.select("doc_id", F.col("n_boxes").cast("long").alias("n_boxes"), "status", _pixel_sums("kept").alias("pixels"), F.coalesce("error", F.lit("")).alias("error"))


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP3 to UP5: pages packed as the archives of three apps; safe members on the whitelist are unpacked and hashed, others say why not."""
    n = F.col("page_id")
    path = F.concat(F.when(n % 7 == 0, "../").when(n % 7 == 1, "/").otherwise(""), F.lit("p/"), n.cast("string"))
    files = _table(spark, sf_dir, "pages").select(F.concat(F.lit("app"), (n % 3).cast("string")).alias("app"), path.alias("path"), F.encode("html", "utf-8").alias("content"), n)
    folder = _folder(spark)
    archives.pack(files, folder)
    found = archives.members(spark, folder, files.where("page_id % 5 != 0"))
    return found.select("app", "path", "size", F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("reason", F.lit("")).alias("reason"))


def published_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP1 to UP6: two updates packed from pages; the second is published over the first, a third with a wrong file is refused."""
    n, folder = F.col("page_id"), _folder(spark)
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("app"), (n % 3).cast("string")).alias("app"), F.concat(F.lit("p/"), n.cast("string")).alias("path"), F.col("html"), n)
    white = pages.where("page_id % 4 != 0")

    def version(k: int) -> DataFrame:
        return pages.withColumn("content", F.encode(F.concat("html", F.lit(f"<!-- {k} -->")), "utf-8"))

    for k in range(3):
        archives.pack(version(k), f"{folder}/{k}")
        # The third manifest has another digest for one file of the list.
        wrong = F.when((n % 4 != 0) & (n < 4) & F.lit(k == 2), "other").otherwise(F.sha2("content", 256))
        manifest = version(k).select("app", "path", wrong.alias("sha256"))
        with contextlib.suppress(updates.Refused):
            updates.update(spark, f"{folder}/{k}", manifest, white, f"{folder}/root")
    return spark.read.parquet(updates.current(spark, f"{folder}/root")).select("app", "path", "size", "sha256")


@F.pandas_udf(ArrayType(StringType()))
def _unpacked(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: gzip.decompress(base64.b64decode(b)).decode().split("\n"))


def pushed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 and FB2: events as messages of gzip in base64, committed at once, and read back."""
    folder = _folder(spark)
    parts.append(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), folder, form="messages", permessage="500")
    lines = parts.committed(spark, folder, "", "messages").select(F.explode(_unpacked("body")).alias("line"))
    return lines.select(F.from_json("line", "event_id long, user_id long, event_type string, value double").alias("e")).select("e.*")


def _filed(rows: DataFrame, write: Callable[[str, Iterator[pd.DataFrame]], None], folder: str, end: str) -> str:
    """Lets each task write its rows to a file of its own; the pattern of those files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{TaskContext.get().partitionId()}{end}"
        staged = f"{name}.{uuid.uuid4().hex}"
        write(staged, frames)
        os.replace(staged, name)
        yield pd.DataFrame({"name": [name]})

    rows.mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
    return f"{folder}/*{end}"


def _database(path: str, frames: Iterator[pd.DataFrame]) -> None:
    with contextlib.closing(sqlite3.connect(path)) as c:
        c.execute("CREATE TABLE goods (item INTEGER, title TEXT, price REAL)")
        for frame in frames:
            c.executemany("INSERT INTO goods VALUES (?, ?, ?)", frame[["item", "title", "price"]].to_numpy(object).tolist())
        c.commit()


def _workbook(path: str, frames: Iterator[pd.DataFrame]) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
        f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c><v>item</v></c></row>')
        for frame in frames:
            for item, title, price in frame[["item", "title", "price"]].itertuples(index=False):
                f.write(f'<row><c r="A1"><v>{item}</v></c><c r="C1"><v>{price!r}</v></c><c r="B1" t="inlineStr"><is><t>{escape(title)}</t></is></c></row>'.encode())
        f.write(b"</sheetData></worksheet>")


def _goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), title.alias("title"), F.col("p_retailprice").alias("price")).repartition(3, "p_partkey")


def collected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: parts as collectors' databases, one a task, read by ranges of their row ids."""
    tables.register(spark)
    path = _filed(_goods(spark, sf_dir), _database, _folder(spark), ".db")
    return spark.read.format("sqlite").options(path=path, table="goods", rowsPerTask="300").load()


def sheet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: parts as workbooks, one a task, read by ranges of their bytes."""
    tables.register(spark)
    path = _filed(_goods(spark, sf_dir), _workbook, _folder(spark), ".xlsx")
    rows = spark.read.format("xlsx").schema("item string, title string, price string").options(path=path, bytesPerTask="20000").load()
    return rows.select(F.col("item").cast("long").alias("item"), "title", F.col("price").cast("double").alias("price"))


def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK3 and step 0: items written as CSV, JSON and Parquet and read again; rejected ones go to the quarantine."""
    items = _goods(spark, sf_dir).withColumn("tags", F.array("title", F.lit("x,y\n"))).withColumn("reason", F.when(F.col("item") % 9 == 0, "logo"))
    folder, schema = _folder(spark), "item long, title string, price double, tags array<string>"
    sinks.quarantine(items, "reason", f"{folder}/quarantine")
    kept = tables.load(spark, f"{folder}/quarantine", schema="item long, reason string").select(F.lit("quarantine").alias("of"), "item", F.col("reason").alias("title"), F.lit(0.0).alias("price"), F.lit("").alias("tags"))
    for kind in ("csv", "json", "parquet"):
        sinks.write_listing(items.where("reason is null").drop("reason"), f"{folder}/{kind}", kind)
        options = {"header": "true", "multiLine": "true", "escape": '"'} if kind == "csv" else {}
        rows = tables.load(spark, f"{folder}/{kind}", kind, schema.replace("array<string>", "string") if kind == "csv" else schema, **options)
        tags = F.from_json("tags", "array<string>") if kind == "csv" else F.col("tags")
        kept = kept.unionByName(rows.select(F.lit(kind).alias("of"), "item", "title", "price", F.array_join(tags, "|").alias("tags")))
    return kept


def resumed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SNK2 and AC13: a run that a pause cuts off within its second stage, and goes on from what is committed."""
    goods, folder = _goods(spark, sf_dir), f"{_folder(spark)}/run"
    paused = goods.agg(F.min("item")).first()[0]

    def stages(stop: bool) -> list:
        @F.pandas_udf(StringType())
        def worked(items: pd.Series, titles: pd.Series) -> pd.Series:
            if stop and (items == paused).any():
                raise Pause("not now")
            return titles.str.upper()

        def work(rows: DataFrame) -> DataFrame:
            made = rows.repartition(8, "item").withColumn("title", worked("item", "title"))
            return made.withColumn("error", F.when(F.col("item") % 50 == 3, "bad item"))

        return [("priced", lambda rows: rows.withColumn("price", F.col("price") * 2)), ("worked", work), ("listed", lambda rows: rows.withColumn("listed", F.lit(True)))]

    try:
        runner.Run(spark, folder, stages(True), {"worked": "item"}).go(goods)
    except Exception as e:  # noqa: BLE001
        if "Pause: not now" not in str(e):
            raise
    run = runner.Run(spark, folder, stages(False), {"worked": "item"})
    done = run.go(goods).select("item", "title", "price", "listed")
    stopped = run.quarantine(1).select("item", "title", "price", F.lit(False).alias("listed"))
    return done.unionByName(stopped)


def live_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC11 and FB1: the caps as a stream of signals moves them, in three micro-batches, and what holds after each."""
    events = _table(spark, sf_dir, "events").where("event_type != 'view'")
    rows = events.select("event_id", "ts", (F.col("user_id") % 12).alias("stage"), F.expr("event_type = 'error' and value > 60").alias("failed"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    folder, provider = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    live, before = control.LiveCaps(spark, folder), spark.conf.get(provider, None)

    def decided(batch: DataFrame, number: int) -> None:
        live(batch, number)
        parts.append(batch.withColumn("batch", F.lit(number).cast("long")), f"{folder}/decisions", job=f"batch-{number}")

    spark.dataSource.register(parts.PartsSink)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            cut = [F.lit(low + (high - low) / 3 * j) for j in (k, k + 1)]
            rows.where((F.col("ts") >= cut[0]) & ((F.col("ts") < cut[1]) | F.lit(k == 2))).write.mode("append").parquet(f"{folder}/signals")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/signals")
            query = streaming.caps(stream).writeStream.foreachBatch(decided).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    found = parts.committed(spark, f"{folder}/decisions", "stage long, decision long, seq long, fail_rate double, cap long")
    now = spark.createDataFrame(list(live.caps.items()), "stage long, now long")
    return found.join(F.broadcast(now), "stage").select("stage", "decision", "fail_rate", "cap", "now")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rescued_pixels, archive_members, published_update, pushed_log, collected_items, sheet_items, listed_items, resumed_steps, live_caps)}

_W, _H = MARKED
ORACLE_SQL: dict[str, str] = {
    "rescued_pixels": f"""WITH docs AS (SELECT doc_id AS n, doc_id % 6 AS kind, doc_id % 10 = 7 AS shot FROM documents),
      grid AS (SELECT x, y FROM range({WIDTH}) a(x), range({HEIGHT}) b(y)),
      drawn AS (SELECT n, kind, shot, x, y, (n * 31 + x * 7 + y * 13) % 200 AS own, kind IN (1, 2, 4) AND x < {_W} AND y < {_H} AS marked FROM docs, grid),
      seen AS (SELECT *, CASE WHEN marked THEN {rasters.MARK} WHEN kind = 2 AND x = {WIDTH - 1} AND y = {HEIGHT - 1} THEN {rasters.ADDRESS}
        WHEN kind = 3 AND x BETWEEN 10 AND 13 AND y BETWEEN 6 AND 9 THEN {rasters.MARK} WHEN kind = 4 AND x = {_W} AND y < {_H} THEN {rasters.FAINT + 1} ELSE own END AS value,
        kind = 1 AND NOT shot AND marked AS mended FROM drawn)
      SELECT n AS doc_id, CAST(CASE WHEN any_value(kind) IN (1, 2, 4) AND NOT any_value(shot) THEN 1 ELSE 0 END AS BIGINT) AS n_boxes,
        CASE WHEN any_value(shot) THEN 'given up' WHEN any_value(kind) = 1 THEN 'rescued' ELSE 'rejected' END AS status,
        CAST(CASE WHEN any_value(kind) = 5 THEN -1 ELSE sum(CASE WHEN mended THEN (n * 31 + {_W} * 7 + y * 13) % 200 ELSE value END) END AS BIGINT) AS pixels,
        CASE WHEN any_value(kind) = 5 AND NOT any_value(shot) THEN 'locate: NotAPicture: cut off' ELSE '' END AS error FROM seen GROUP BY n""",
    "archive_members": """WITH files AS (SELECT page_id, 'app' || page_id % 3 AS app, CASE page_id % 7 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE '' END || 'p/' || page_id AS path, html FROM pages),
      judged AS (SELECT *, CASE WHEN page_id % 7 < 2 THEN 'unsafe path' WHEN page_id % 5 = 0 THEN 'not on the whitelist' ELSE '' END AS reason FROM files)
      SELECT app, path, CAST(strlen(html) AS BIGINT) AS size, CASE WHEN reason = '' THEN sha256(html) ELSE '' END AS sha256, reason FROM judged""",
    "published_update": "SELECT 'app' || page_id % 3 AS app, 'p/' || page_id AS path, CAST(strlen(html || '<!-- 1 -->') AS BIGINT) AS size, sha256(html || '<!-- 1 -->') AS sha256 FROM pages WHERE page_id % 4 <> 0",
    "pushed_log": "SELECT event_id, user_id, event_type, value FROM events",
    "collected_items": "SELECT p_partkey AS item, p_name || ' & <' || p_brand || '>' AS title, p_retailprice AS price FROM part",
    "sheet_items": "SELECT p_partkey AS item, p_name || ' & <' || p_brand || '>' AS title, p_retailprice AS price FROM part",
    "resumed_steps": "SELECT p_partkey AS item, upper(p_name || ' & <' || p_brand || '>') AS title, p_retailprice * 2 AS price, p_partkey % 50 <> 3 AS listed FROM part",
    "listed_items": """WITH goods AS (SELECT p_partkey AS item, p_name || ' & <' || p_brand || '>' AS title, p_retailprice AS price FROM part)
      SELECT 'quarantine' AS of, item, 'logo' AS title, CAST(0 AS DOUBLE) AS price, '' AS tags FROM goods WHERE item % 9 = 0
      UNION ALL SELECT kind, item, title, price, title || '|x,y' || chr(10) FROM goods, (VALUES ('csv'), ('json'), ('parquet')) t(kind) WHERE item % 9 <> 0""",
}
