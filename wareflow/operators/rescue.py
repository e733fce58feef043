"""Rescue of rejected images (gate, locate, inpaint, verify, roll back) and the first-image step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pictures that are given up at once, and residue that counts wherever it is found.
GATED = ("screenshot", "collage", "poster")
RESIDUE_CLASSES = ("rival_url", "anti_theft_notice", "spec_text", "app_ui", "sticker", "collage", "video_screenshot", "centre_promo")
#: Memory in GB and the pool that it allows.
POOLS = ((24, 28), (12, 16), (8, 10))
LOW, HIGH = 0.15, 0.85
#: So that centres on a bound count as within, whatever the sums' rounding.
_SLACK = 1e-9


def gate(kind: Column) -> Column:
    """Whether an image is worth an attempt; filter on it before the inpainting model."""
    return ~F.coalesce(kind.isin(*GATED), F.lit(False))


def outer_boxes(boxes: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Boxes whose centre is not in the middle of the picture on both axes."""

    def outside(b: Column) -> Column:
        x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
        return ~(x.between(low - _SLACK, high + _SLACK) & y.between(low - _SLACK, high + _SLACK))

    return F.filter(boxes, outside)


def mask_box(xs: Column, ys: Column) -> Column:
    """The box around a mask's points; null for an empty mask."""
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(xs) > 0, box)


def residue(in_boxes: Column, whole_image: Column) -> Column:
    """Whether something is left: in the treated boxes, or of a residue class anywhere."""
    found = F.arrays_overlap(whole_image, F.array(*map(F.lit, RESIDUE_CLASSES)))
    return F.coalesce(in_boxes, F.lit(False)) | F.coalesce(found, F.lit(False))


def commit_or_roll_back(rows: DataFrame, original: str, candidate: str, left: Column, target: str) -> DataFrame:
    """``target`` is the candidate, or the original where something is left or no candidate was made; and the status."""
    back = left | F.col(candidate).isNull()
    return rows.withColumn(target, F.when(back, F.col(original)).otherwise(F.col(candidate))).withColumn("status", F.when(back, "rejected").otherwise("rescued"))


def pool_size(memory_gb: Column, failures: Column) -> Column:
    """Workers for a card's memory; each failure for want of memory halves them, one at least.  Unknown memory has one."""
    size = F.lit(1)
    for least, workers in reversed(POOLS):
        size = F.when(memory_gb >= least, workers).otherwise(size)
    return F.greatest(F.lit(1), F.call_function("shiftright", size, F.least(F.coalesce(failures, F.lit(0)), F.lit(30)).cast("int"))).cast("long")


def replace_first(images: Column, better: Column) -> Column:
    """The images with the first one's path replaced, where there is a better one."""
    return F.when(better.isNull(), images).otherwise(F.transform(images, lambda i: F.when(i["idx"] == 0, i.withField("path", better)).otherwise(i)))


def first_image_wanted(prohibited: Column, close_up: Column) -> Column:
    """Whether the first image goes to the editing model: allowed, and no close-up of a detail."""
    return ~F.coalesce(prohibited, F.lit(False)) & ~F.coalesce(close_up, F.lit(False))
