"""The control plane over event logs: failure rates, adaptive caps, quotas and usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareflow.functions.sequence import numbered, rolling

WINDOW, MIN_SAMPLE, COOLDOWN = 30, 5, 5
#: The bounds of the failure rate, and outcomes that are no signal.
SOFT, HARD = 0.15, 0.30
NO_SIGNAL = ("network_blip", "cascade_pause")
QUOTA = 2000
#: Decisions of a stage that one task steps through.
CAP_BLOCK = 20_000
#: What of a tenant's day makes a block of the ledger.
LEDGER_BLOCK = "minute"


def signals(events: DataFrame, outcome: str) -> DataFrame:
    """The task outcomes that say something about a stage, with ``failed``; the others leave the window altogether."""
    counted = events.where(F.col(outcome).isNotNull() & ~F.col(outcome).isin(*NO_SIGNAL))
    return counted.withColumn("failed", F.col(outcome) == "fail")


def fail_rates(events: DataFrame, stage: str, ts: str, key: str, failed: str, window: int = WINDOW, least: int = MIN_SAMPLE) -> DataFrame:
    """``events`` (signals only) with seq, n and fail_rate over a stage's last ``window`` ones; null under ``least``.

    Events are numbered within hours and the windows dealt out in blocks, so a stage with a third of all events
    is spread over many tasks.
    """
    rows = numbered(events, [stage], F.date_trunc("hour", F.col(ts)), [ts, key])
    failures = F.col(failed).cast("int")
    made = {"n": lambda w: F.count(F.lit(1)).over(w), "_failed": lambda w: F.sum(failures).over(w)}
    found = rolling(rows, [stage], "seq", window, made)
    return found.withColumn("fail_rate", F.when(F.col("n") >= least, F.col("_failed") / F.col("n"))).drop("_failed")


def start_cap(suggestion: Column, share: Column, accounts: Column, low: int, high: int) -> Column:
    """Suggestion times the share of requests per active account, as a whole number within the bounds."""
    raw = F.floor(suggestion * share / F.greatest(accounts, F.lit(1))).cast("long")
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def next_cap(cap: int, jumped: bool, signal: int, low: int, high: int) -> tuple[int, bool]:
    """One decision: signal 2 halves the cap, 1 takes a fifth, 0 jumps half-way up at first and then adds a quarter."""
    if signal == 2:
        return max(low, cap // 2), jumped
    if signal == 1:
        return max(low, cap * 4 // 5), jumped
    if not jumped:
        return max(cap, (cap + high) // 2), True
    return min(high, max(cap + 1, cap * 5 // 4)), True


def cap_path(rates: DataFrame, stage: str, first: int = 8, low: int = 1, high: int = 64, cooldown: int = COOLDOWN, block: int = CAP_BLOCK) -> DataFrame:
    """(stage, decision, seq, fail_rate, cap): the cap after each decision, one every ``cooldown`` signals.

    The cap is a recurrence, but over few states.  Each block of decisions is first worked through for every state
    that it may start from; from these tables, one row a block, the state at each block's start follows; then
    the blocks are worked through again from there, all at once.
    """
    due = rates.where((F.col("seq") % cooldown == 0) & F.col("fail_rate").isNotNull())
    signal = F.when(F.col("fail_rate") > HARD, 2).when(F.col("fail_rate") >= SOFT, 1).otherwise(0)
    # Rates are null only at a stage's start, so decisions number on with the signals.
    offset = -(-MIN_SAMPLE // cooldown) - 1
    decision = (F.col("seq") / cooldown).cast("long") - offset
    # The stage travels as JSON, so that a null one is a key like others.
    of, kind = F.to_json(F.struct(F.col(stage).alias("stage"))), dict(rates.dtypes)[stage]
    steps = due.select(of.alias("of"), "seq", "fail_rate", signal.cast("int").alias("signal"), decision.alias("decision")).withColumn("block", F.floor((F.col("decision") - 1) / block).cast("long"))
    states = [(cap, jumped) for jumped in (False, True) for cap in range(low, high + 1)]

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = list(states)
        for s in pdf.sort_values("decision")["signal"]:
            step = {state: next_cap(*state, s, low, high) for state in set(ends)}
            ends = [step[e] for e in ends]
        return pd.DataFrame({"of": [pdf["of"].iloc[0]], "block": [pdf["block"].iloc[0]], "ends": [[states.index(e) for e in ends]]})

    tables = steps.groupBy("of", "block").applyInPandas(through, "of string, block long, ends array<int>")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        at, found = states.index((first, False)), []
        for row in pdf.sort_values("block").itertuples():
            found.append(at)
            at = row.ends[at]
        return pd.DataFrame({"of": pdf.sort_values("block")["of"], "block": pdf.sort_values("block")["block"], "start": found})

    begun = tables.groupBy("of").applyInPandas(starts, "of string, block long, start int")

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("decision")
        cap, jumped = states[int(rows["start"].iloc[0])]
        caps = []
        for s in rows["signal"]:
            cap, jumped = next_cap(cap, jumped, s, low, high)
            caps.append(cap)
        return rows.assign(cap=caps)[["of", "decision", "seq", "fail_rate", "cap"]]

    done = steps.join(begun, ["of", "block"]).groupBy("of", "block").applyInPandas(path, "of string, decision long, seq long, fail_rate double, cap long")
    return done.select(F.from_json("of", f"stage {kind}")["stage"].alias(stage), "decision", "seq", "fail_rate", "cap")


def quota_day(ts: Column) -> Column:
    """The day of a UTC time whose quota it counts for: days start at 10:00 in Taipei, 02:00 UTC."""
    return (ts - F.expr("interval 2 hours")).cast("date")


def day_usage(events: DataFrame, tenant: str, ts: str, product: str, billable: Column) -> DataFrame:
    """(tenant, quota_day, units): distinct products that used an expensive feature."""
    rows = events.where(billable).select(F.col(tenant).alias("tenant"), quota_day(F.col(ts)).alias("quota_day"), F.col(product).alias("product"))
    return rows.distinct().groupBy("tenant", "quota_day").agg(F.count("*").alias("units"))


def attributed(events: DataFrame, tenant: str, ts: str, key: str, product: str, refund: Column) -> DataFrame:
    """Quota operations with the day that they count for: a refund counts for the day of the product's last consume.

    That is the same day if the product was consumed earlier in it, else the last day before with a consume.  So
    one summary row a tenant, product and day suffices, and the only window runs over those days.
    """
    own = quota_day(F.col("ts"))
    rows = events.select(F.col(tenant).alias("tenant"), F.col(ts).alias("ts"), F.col(key).alias("key"), F.col(product).alias("product"), refund.alias("refund")).withColumn("_day", own)
    days = rows.groupBy("tenant", "product", "_day").agg(F.min(F.when(~F.col("refund"), F.struct("ts", "key"))).alias("_first"))
    before = Window.partitionBy("tenant", "product").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_earlier", F.max(F.when(F.col("_first").isNotNull(), F.col("_day"))).over(before))
    days = days.select(F.col("tenant").alias("_tenant"), F.col("product").alias("_product"), F.col("_day").alias("_of"), "_first", "_earlier")
    keys = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("tenant", "_tenant"), ("product", "_product"), ("_day", "_of"))]
    same = (F.col("_first") <= F.struct("ts", "key")) & F.col("_first").isNotNull()
    day = F.when(same, F.col("_day")).otherwise(F.coalesce("_earlier", "_day"))
    return rows.join(days, keys).select("tenant", "ts", "key", "product", "refund", day.alias("quota_day"))


def ledger(operations: DataFrame, limit: int = QUOTA, block: str = LEDGER_BLOCK) -> DataFrame:
    """(tenant, quota_day, used, denied, refunded) of operations (tenant, quota_day, ts, key, product, refund).

    Within a tenant's day: a product is one unit, however often it consumes; over the limit it is denied; a refund
    gives an admitted product's unit back, once.  Null tenants, days, times and products count as values of their own,
    a null refund as a consume; operations are in the order of ts, key, refund and product.

    A day is cut into blocks of time, so that no task and no row holds a tenant's day.  Where its products are no
    more than the limit nothing is ever denied, and each product goes its own way: a block says of each of its
    products what it did first and last and how often it gave back in between, and these are put together by product.
    Other days need their order: each block is cut down to the operations that may change something (of repeated
    consumes with no refund between them the first, with their number; of repeated refunds the first), and these
    pass in order through one fold, whose state is the admitted products, at most ``limit``.
    """
    of, refund = F.to_json(F.struct("tenant", "quota_day")), F.coalesce("refund", F.lit(False))
    at = F.struct("ts", "key", refund.alias("refund"), "product").alias("at")
    rows = operations.select(of.alias("of"), F.struct(F.date_trunc(block, F.col("ts"))).alias("block"), F.struct("product").alias("product"), refund.alias("refund"), at)
    rows = rows.withColumn("before", F.lag("refund").over(Window.partitionBy("of", "block", "product").orderBy("at")))
    gives_back = F.col("refund") & ~F.coalesce("before", F.lit(True))
    parts = rows.groupBy("of", "block", "product").agg(F.min_by("refund", "at").alias("first"), F.max_by("refund", "at").alias("last"), F.sum(gives_back.cast("long")).alias("back"), F.bool_or(~F.col("refund")).alias("takes"))
    across = F.col("first") & ~F.coalesce(F.lag("last").over(Window.partitionBy("of", "product").orderBy("block")), F.lit(True))
    each = parts.withColumn("back", F.col("back") + across.cast("long")).groupBy("of", "product").agg(F.max_by("last", "block").alias("last"), F.sum("back").alias("back"), F.bool_or("takes").alias("takes"))
    days = each.groupBy("of").agg(F.sum((~F.col("last")).cast("long")).alias("used"), F.lit(0).cast("long").alias("denied"), F.sum("back").alias("refunded"), F.sum(F.col("takes").cast("long")).alias("products"))
    ordered = decisive(rows.join(days.where(F.col("products") > limit).select("of"), "of", "left_semi"))
    schema = "of string, used long, denied long, refunded long"
    text = ordered.withColumn("product", F.to_json("product"))
    chained = text.repartition("of").sortWithinPartitions("of", "at").select("of", "product", "refund", "times").mapInPandas(_folded(limit), schema)
    both = days.where(F.col("products") <= limit).select("of", "used", "denied", "refunded").unionByName(chained)
    kinds = dict(operations.dtypes)
    key = F.from_json("of", f"tenant {kinds['tenant']}, quota_day {kinds['quota_day']}")
    return both.select(key["tenant"].alias("tenant"), key["quota_day"].alias("quota_day"), "used", "denied", "refunded")


def decisive(rows: DataFrame) -> DataFrame:
    """(of, at, product, refund, times): the operations that may change a day's state.

    ``rows`` has of, block, at (what they are ordered by), product, refund and before (whether the product's operation
    before it in its block was a refund).  Consumes of a product with no refund between them in their block end alike:
    all denied or none.
    """
    stretch = F.sum(F.col("refund").cast("int")).over(Window.partitionBy("of", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("stretch", stretch).where(~F.col("refund") | ~F.coalesce("before", F.lit(False)))
    grouped = marked.groupBy("of", "block", "stretch", "refund", "product").agg(F.min("at").alias("at"), F.count("*").alias("times"))
    return grouped.select("of", "at", "product", "refund", "times")


def _folded(limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A pass over days, each whole and in its order: only the current day's admitted products are held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["of", "used", "denied", "refunded"]
        current, admitted, denied, refunded = None, set(), 0, 0
        for frame in frames:
            done = []
            for of, product, refund, times in zip(frame["of"], frame["product"], frame["refund"], frame["times"], strict=True):
                if of != current:
                    if current is not None:
                        done.append((current, len(admitted), denied, refunded))
                    current, admitted, denied, refunded = of, set(), 0, 0
                if refund:
                    if product in admitted:
                        admitted.discard(product)
                        refunded += 1
                elif product not in admitted:
                    if len(admitted) < limit:
                        admitted.add(product)
                    else:
                        denied += times
            yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([(current, len(admitted), denied, refunded)], columns=names)

    return fold


def usage(events: DataFrame, ts: str, user: str, kind: str) -> DataFrame:
    """(quota_day, kind, events, users): usage by day and kind of event."""
    return events.groupBy(quota_day(F.col(ts)).alias("quota_day"), F.col(kind).alias("kind")).agg(F.count("*").alias("events"), F.count_distinct(F.col(user)).alias("users"))


def last_caps(stage_caps: DataFrame, stage: str) -> DataFrame:
    """(stage, cap): the cap that holds after the last decision."""
    return stage_caps.groupBy(stage).agg(F.max_by("cap", "decision").alias("cap"))


def capped(work: Callable[[DataFrame], None], caps: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch goes to ``work`` in as many tasks as the cap then allows, as ``LiveCaps.cap`` says it."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch.repartition(max(1, caps())))

    return run


class LiveCaps:
    """The cap of each stage as it is now: ``foreachBatch`` of a stream of decisions (stage, decision, cap) keeps it up to date.

    The driver holds a row a stage.  Each micro-batch's caps are written under its number before they count, so a batch
    that is given again changes nothing and a new process begins where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str, first: int = 8):
        self.spark, self.folder, self.first = spark, folder.rstrip("/"), first
        self.caps, self.last = self._kept()

    def _kept(self) -> tuple[dict, int]:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/caps")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}, -1
        last = rows.agg(F.max("batch")).first()[0]
        return {r["stage"]: r["cap"] for r in rows.where(F.col("batch") == last).toLocalIterator()}, last

    def __call__(self, decisions: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        new = {r["stage"]: r["cap"] for r in last_caps(decisions, "stage").toLocalIterator()}
        caps = self.caps | new
        if new:
            kind = dict(decisions.dtypes)["stage"]
            rows = self.spark.createDataFrame(list(caps.items()), f"stage {kind}, cap long")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/caps/batch={number}")
            self.last = number
        self.caps = caps

    def cap(self, stage) -> int:
        """The cap that the stage's next batch may use; the first one until there is a decision."""
        return self.caps.get(stage, self.first)


def permits(stage_caps: DataFrame, stage: str) -> Iterator[tuple]:
    """The last cap of each stage, for a driver that sets the concurrency of its next batch; one row a stage."""
    return ((r[stage], r["cap"]) for r in last_caps(stage_caps, stage).toLocalIterator())
