"""Pictures as pixels: the codec, masks, and the rescue that verifies what was made."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from wareflow.operators import rasters
from wareflow.operators.rasters import NotAPicture, read_png, write_png
from wareflow.plans import steps


def picture(kind, size=(6, 7), seed=0):
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    return np.random.default_rng(seed).integers(0, 256, (*size, channels)).astype(np.uint8)


def encoded(pixels, kind, filters, palette=None, split=1):
    """A PNG whose lines use the given filters, written from the definition of each."""
    h, w, c = pixels.shape
    raw = b""
    for y in range(h):
        f = filters[y % len(filters)]
        line = []
        for x in range(w):
            for k in range(c):
                a = int(pixels[y, x - 1, k]) if x else 0
                b = int(pixels[y - 1, x, k]) if y else 0
                d = int(pixels[y - 1, x - 1, k]) if x and y else 0
                p = a + b - d
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line.append((int(pixels[y, x, k]) - (0, a, b, (a + b) // 2, nearest)[f]) % 256)
        raw += bytes([f, *line])
    packed = zlib.compress(raw)
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)), (b"tEXt", b"a\0b")]
    chunks += [(b"PLTE", palette)] if palette else []
    cut = -(-len(packed) // split)
    chunks += [(b"IDAT", packed[i : i + cut]) for i in range(0, len(packed), cut)] + [(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


@pytest.mark.parametrize("kind", [0, 2, 4, 6])
@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0, 1, 4]])
def test_all_filters_and_colours(kind, filters):
    pixels = picture(kind, seed=kind)
    assert (read_png(encoded(pixels, kind, filters, split=3)) == pixels).all()
    assert (read_png(write_png(pixels)) == pixels).all()


def test_palettes():
    at = np.array([[[0], [1]], [[2], [0]]], np.uint8)
    colours = bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])
    assert read_png(encoded(at, 3, [0], colours)).tolist() == [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [1, 2, 3]]]
    with pytest.raises(NotAPicture, match="palette"):
        read_png(encoded(at, 3, [0], colours[:6]))


def test_damaged_files_are_no_pictures():
    good = write_png(picture(2))
    flipped = bytearray(good)
    flipped[45] ^= 1
    head = struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)
    huge = good[:8] + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + good[33:]
    for data, why in ((b"", "no PNG"), (b"GIF89a" * 9, "no PNG"), (good[:-15], "cut off"), (good[:20], "cut off"), (bytes(flipped), "damaged"), (huge, "too many")):
        with pytest.raises(NotAPicture, match=why):
            read_png(data)


def test_masks_and_their_boxes():
    mask = rasters.box_mask(10, 20, [(0.0, 0.0, 0.1, 0.2), (0.51, 0.5, 0.6, 1.5)])
    assert mask.sum() == 2 * 2 + 2 * 5 and mask[9, 11] and not mask[9, 12]
    assert rasters.mask_boxes(mask) == [(0.0, 0.0, 0.1, 0.2), (0.5, 0.5, 0.6, 1.0)]
    assert (rasters.box_mask(10, 20, rasters.mask_boxes(mask)) == mask).all() and rasters.mask_boxes(np.zeros((3, 3), bool)) == []


def marked(corner=True, seed=1):
    pixels = (picture(0, (8, 10), seed) % 200).astype(np.uint8)
    if corner:
        pixels[:2, :3] = rasters.MARK
    return pixels


def rescue(spark, pictures, **skills):
    rows = spark.createDataFrame([(k, "photo", write_png(p) if isinstance(p, np.ndarray) else p) for k, p in enumerate(pictures)], "id int, kind string, picture binary")
    return {r.id: r for r in steps.rescued(rows, "picture", "kind", **(rasters.PIXEL_SKILLS | skills)).collect()}


def test_what_was_made_is_verified(spark):
    beside, stamped = marked(), marked()
    beside[:2, 3] = rasters.FAINT
    stamped[7, 9] = rasters.ADDRESS
    pictures = [marked(), beside, stamped, marked(False), b"no picture"]
    got = rescue(spark, pictures)
    assert [got[k].status for k in range(5)] == ["rescued", "rejected", "rejected", "rejected", "rejected"]
    assert [got[k].n_boxes for k in range(5)] == [1, 1, 1, 0, 0] and got[4].error == "locate: NotAPicture: no PNG"
    assert all(bytes(got[k].kept) == (p if isinstance(p, bytes) else write_png(p)) for k, p in enumerate(pictures) if k)
    wanted = marked()
    wanted[:2, :3] = wanted[:2, 3:4]
    assert (read_png(bytes(got[0].kept)) == wanted).all()


def test_nothing_outside_the_mask_is_changed(spark):
    def everywhere(pixels, mask):
        return np.zeros_like(pixels)

    got = rescue(spark, [marked()], inpaint=rasters.pixel_skills(rasters.locate_marks, everywhere, rasters.find_rests)["inpaint"])
    made = read_png(bytes(got[0].kept))
    assert got[0].status == "rescued" and (made[:2, :3] == 0).all()
    made[:2, :3] = rasters.MARK
    assert (made == marked()).all()


def test_a_failing_model_keeps_the_original(spark):
    def broken(pixels, mask):
        raise MemoryError("card is full")

    def small(pixels, mask):
        return pixels[:1]

    for model, why in ((broken, "inpaint: MemoryError: card is full"), (small, "inpaint: ValueError: the inpainter made (1, 10, 1) of (8, 10, 1)")):
        got = rescue(spark, [marked()], inpaint=rasters.pixel_skills(rasters.locate_marks, model, rasters.find_rests)["inpaint"])[0]
        assert (got.status, got.error) == ("rejected", why) and bytes(got.kept) == write_png(marked())


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(write_png(marked()))
    (tmp_path / "y.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = rasters.pictures(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in found] == [("x.png", write_png(marked()))]
