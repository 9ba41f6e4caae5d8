"""Files that other programs write: tiles, byte orders, wide samples, several samples, and damage."""

import struct

import numpy as np
import pytest

from evidentia.llm import tiff
from evidentia.llm.shared import BATCH_BYTES, BATCH_ROWS, mapped


def built(pixels, order="<", compression=1, predictor=1, tile=None, strip=3, link=None):
    """One page of ``pixels`` (rows, columns, samples) in strips or tiles; ``link`` is the next directory's place."""
    height, width, samples = pixels.shape
    pixels = pixels.astype(pixels.dtype.newbyteorder(order))
    if tile:
        tw, th = tile
        whole = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), pixels.dtype)
        whole[:height, :width] = pixels
        blocks = [whole[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
    else:
        blocks = [pixels[y : y + strip] for y in range(0, height, strip)]
    if predictor == 2:
        blocks = [np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1).astype(pixels.dtype) for b in blocks]
    packed = [tiff._compress(b.tobytes(), compression) for b in blocks]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    offsets = []
    for block in packed:
        offsets.append(len(out))
        out += block + b"\0" * (len(block) % 2)
    places = {}
    for name, kind, values in (("offsets", "I", offsets), ("sizes", "I", [len(b) for b in packed]), ("bits", "H", [8 * pixels.dtype.itemsize] * samples)):
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(raw) <= 4:
            places[name] = raw.ljust(4, b"\0")
        else:
            places[name] = struct.pack(order + "I", len(out))
            out += raw
    short, long = (lambda v: struct.pack(order + "HH", v, 0)), (lambda v: struct.pack(order + "I", v))
    entries = [(256, 4, 1, long(width)), (257, 3, 1, short(height)), (258, 3, samples, places["bits"]), (259, 3, 1, short(compression)), (277, 3, 1, short(samples)), (317, 3, 1, short(predictor))]
    if tile:
        entries += [(322, 3, 1, short(tile[0])), (323, 3, 1, short(tile[1])), (324, 4, len(packed), places["offsets"]), (325, 4, len(packed), places["sizes"])]
    else:
        entries += [(273, 4, len(packed), places["offsets"]), (278, 3, 1, short(strip)), (279, 4, len(packed), places["sizes"])]
    at = len(out)
    struct.pack_into(order + "I", out, 4, at)
    out += struct.pack(order + "H", len(entries))
    for tag, kind, n, value in sorted(entries):
        out += struct.pack(order + "HHI", tag, kind, n) + value
    return bytes(out + struct.pack(order + "I", at if link == "self" else 0))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("tile", [None, (4, 5), (16, 16)])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_layouts(order, bits, tile, compression):
    draw = np.random.default_rng(bits)
    for samples in (1, 3):
        for predictor in (1, 2):
            pixels = draw.integers(0, 1 << bits, (11, 9, samples), dtype=np.uint64).astype(f"u{bits // 8}")
            (page,) = tiff.pages(built(pixels, order, compression, predictor, tile))
            assert (page["width"], page["height"], page["bits"], page["samples"]) == (9, 11, bits, samples)
            read = np.frombuffer(page["pixels"], f"{order}u{bits // 8}").reshape(pixels.shape)
            assert (read == pixels).all()


def test_damage_raises():
    pixels = np.arange(88, dtype=np.uint8).reshape(11, 8, 1)
    good = built(pixels, compression=tiff.DEFLATE)
    for bad in (b"", b"II", b"not a picture", b"II*\0\xff\xff\xff\x7f", good[:40], good[:-20], good.replace(good[8:12], b"\0\0\0\0", 1)):
        with pytest.raises(Exception):
            list(tiff.pages(bad))
    with pytest.raises(ValueError, match="circle"):
        list(tiff.pages(built(pixels, link="self")))
    with pytest.raises(ValueError, match="compression 7"):
        list(tiff.pages(built(pixels, compression=tiff.NONE).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))))


def test_rows_of_files_of_all_kinds(spark):
    pixels = np.arange(99, dtype=np.uint16).reshape(11, 9, 1)
    files = [(1, built(pixels, ">")), (2, None), (3, tiff.write(bytes(range(64)) * 40000)), (1, built(pixels, "<", tile=(4, 4)))]
    rows = tiff.read_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert sorted((r.doc_id, r.page, r.height, r.bits) for r in rows) == [(1, 0, 11, 16)] * 2 + [(3, 0, 16384, 8), (3, 1, 16384, 8), (3, 2, 7232, 8)]


def test_batches_end_by_bytes(spark):
    """Long rows end a batch early, short rows by their number; no row is lost."""

    def counted(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]}, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("n", pa.int64()), ("size", pa.int64())])
    long = spark.range(0, 100, numPartitions=1).selectExpr("repeat('x', 4000000) AS text")
    found = mapped(long, counted, "n long, size long").collect()
    assert sum(r.n for r in found) == 100 and len(found) > 5 and max(r.size for r in found) < BATCH_BYTES + (16 << 20)
    short = mapped(spark.range(0, 3 * BATCH_ROWS, numPartitions=1).selectExpr("'x' AS text"), counted, "n long, size long").collect()
    assert [r.n for r in short] == [BATCH_ROWS] * 3
