"""Pictures as pixels: a PNG codec over zlib, box masks, and the rescue skills that work on bytes.

``pixel_skills`` makes the three skills of ``steps.rescued`` out of functions on pixel arrays, so that the image column of
a rescue is the picture's bytes: LOCATE reads them, INPAINT gets pixels and mask and can change nothing outside the
mask, and VERIFY reads the bytes that INPAINT wrote, not the original's.

The stand-ins know three colours: marks, faint rests of marks, and addresses.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.operators.skills import Skill

Box = tuple[float, float, float, float]
BOXES = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; a palette's pixels are looked up.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels that a picture may have, so that a small file can not fill a worker's memory.
MOST_PIXELS = 1 << 26


class NotAPicture(ValueError):
    """The bytes are no PNG that can be read here."""


def _chunks(data: bytes):
    at = len(_SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise NotAPicture("cut off")
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            raise NotAPicture(f"damaged chunk {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + size


def read_png(data: bytes) -> np.ndarray:
    """The pixels (height, width, channels) of a PNG with 8 bits a channel that is not interlaced."""
    if data[:8] != _SIGNATURE:
        raise NotAPicture("no PNG")
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    else:
        raise NotAPicture("cut off")
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise NotAPicture("not 8 bits a channel, or interlaced")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    if not 0 < width * height <= MOST_PIXELS:
        raise NotAPicture("too many pixels")
    size = height * (1 + width * channels)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), size)
    except zlib.error as e:
        raise NotAPicture(str(e)) from e
    if len(raw) < size:
        raise NotAPicture("cut off")
    pixels = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), width, channels)
    if head[3] != 3:
        return pixels
    if palette is None or pixels.max() >= len(palette):
        raise NotAPicture("no palette")
    return palette[pixels[:, :, 0]]


def _unfiltered(lines: np.ndarray, width: int, channels: int) -> np.ndarray:
    """The pixels of lines that begin with the number of their filter."""
    found = np.zeros((len(lines), width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y, line in enumerate(lines):
        kind, given = line[0], line[1:].reshape(width, channels)
        if kind == 0:
            row = given
        elif kind == 1:
            row = np.cumsum(given, axis=0, dtype=np.uint8)
        elif kind == 2:
            row = given + above
        elif kind in (3, 4):
            row = _predicted(given.astype(int), above.astype(int), kind)
        else:
            raise NotAPicture(f"filter {kind}")
        found[y] = above = row
    return found


def _predicted(given: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """A line whose pixels were given as differences to what their neighbours let expect: their mean, or the nearest to left + above - corner."""
    row = np.zeros_like(given)
    left = corner = np.zeros(given.shape[1], int)
    for x in range(len(given)):
        if kind == 3:
            guess = (left + above[x]) // 2
        else:
            far = [abs(above[x] - corner), abs(left - corner), abs(left + above[x] - 2 * corner)]
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above[x], corner))
        left = row[x] = (given[x] + guess) & 255
        corner = above[x]
    return row.astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG of pixels (height, width, channels), 8 bits a channel."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def box_mask(height: int, width: int, boxes: list[Box]) -> np.ndarray:
    """The pixels in boxes, whose bounds are shares of width and height; a pixel that a box cuts is in it."""
    mask = np.zeros((height, width), bool)
    for x0, y0, x1, y1 in boxes:
        at = [np.floor(v + 1e-6) if low else np.ceil(v - 1e-6) for v, low in ((x0 * width, True), (y0 * height, True), (x1 * width, False), (y1 * height, False))]
        left, top, right, bottom = (int(max(0, v)) for v in at)
        mask[top:bottom, left:right] = True
    return mask


def mask_boxes(mask: np.ndarray) -> list[Box]:
    """The boxes around the marked parts of a mask that empty columns keep apart."""
    columns = np.flatnonzero(mask.any(axis=0))
    found = []
    for part in np.split(columns, np.flatnonzero(np.diff(columns) > 1) + 1) if len(columns) else []:
        rows = np.flatnonzero(mask[:, part].any(axis=1))
        found.append((part[0] / mask.shape[1], rows[0] / mask.shape[0], (part[-1] + 1) / mask.shape[1], (rows[-1] + 1) / mask.shape[0]))
    return found


def _boxes(given) -> list[Box]:
    return [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in (given if given is not None else ())]


def pixel_skills(locate: Callable[[np.ndarray], list[Box]], inpaint: Callable[[np.ndarray, np.ndarray], np.ndarray], verify: Callable[[np.ndarray, list[Box]], tuple[bool, list[str]]]) -> dict[str, Skill]:
    """LOCATE, INPAINT and VERIFY for ``steps.rescued`` over a column of PNG bytes.

    ``inpaint`` gets pixels and mask; of what it gives only the pixels under the mask are taken.  A picture that can not be
    read is an error of its own row, so calls take one picture each.
    """

    def located(xs: list) -> list:
        return [[dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)) for b in locate(read_png(x["path"]))] for x in xs]

    def painted(xs: list) -> list:
        out = []
        for x in xs:
            pixels = read_png(x["path"])
            mask = box_mask(*pixels.shape[:2], _boxes(x["boxes"]))
            made = inpaint(pixels.copy(), mask)
            if made.shape != pixels.shape:
                raise ValueError(f"the inpainter made {made.shape} of {pixels.shape}")
            out.append(write_png(np.where(mask[:, :, None], made, pixels).astype(np.uint8)))
        return out

    def verified(xs: list) -> list:
        out = []
        for x in xs:
            in_boxes, whole = verify(read_png(x["candidate"]), _boxes(x["boxes"]))
            out.append({"in_boxes": bool(in_boxes), "whole": list(whole)})
        return out

    return {
        "locate": Skill("locate", BOXES, located, batch=1),
        "inpaint": Skill("inpaint", "binary", painted, batch=1),
        "verify": Skill("verify", "struct<in_boxes: boolean, whole: array<string>>", verified, batch=1),
    }


#: Colours of the stand-ins, in the first channel: a mark, what is faintly left of one from here up, and an address.
MARK, FAINT, ADDRESS = 255, 250, 245


def locate_marks(pixels: np.ndarray) -> list[Box]:
    return mask_boxes(pixels[:, :, 0] == MARK)


def fill_from_beside(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels become the nearest one in their line that is not masked, the left one of two; a line that is masked whole stays."""
    place = np.arange(pixels.shape[1])
    for y in np.flatnonzero(mask.any(axis=1) & ~mask.all(axis=1)):
        free = place[~mask[y]]
        nearest = free[np.abs(place[:, None] - free[None, :]).argmin(axis=1)]
        pixels[y] = pixels[y, nearest]
    return pixels


def find_rests(pixels: np.ndarray, boxes: list[Box]) -> tuple[bool, list[str]]:
    first = pixels[:, :, 0]
    return bool((first[box_mask(*first.shape, boxes)] >= FAINT).any()), ["rival_url"] if (first == ADDRESS).any() else []


PIXEL_SKILLS = pixel_skills(locate_marks, fill_from_beside, find_rests)


def pictures(spark: SparkSession, folder: str, rows: int = 64) -> DataFrame:
    """(path, content) of the PNG files in a folder and those below it.

    A worker holds a batch of pictures, so the session's rows an Arrow batch are lowered to ``rows``.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    return files.select("path", F.col("content"))
