"""TIFF media columns: write 8-bit pages, walk image directories, decode strips and tiles.

The reader takes both byte orders, any chain of directories, strips and tiles, samples side by side
of 8, 16 or 32 bits, no compression, PackBits, LZW and deflate, and the horizontal predictor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored

# Fixed values of the TIFF 6.0 specification.
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Samples in a row, rows in a page and rows in a strip, as ``write`` makes them.
ROW, PAGE_ROWS, STRIP_ROWS = 64, 16384, 2048


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        stop = at + 1
        while stop < n and stop - at < 128 and (stop + 1 >= n or data[stop] != data[stop + 1]):
            stop += 1
        out += bytes((stop - at - 1,)) + data[at:stop]
        at = stop
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc = bits = 0
    out, width, table, word = bytearray(), 9, {bytes((i,)): i for i in range(256)}, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    free = 258
    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        word = longer[-1:]
        if free == 4095:
            put(256)
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free > (1 << width) - 1:
            width += 1
    if word:
        put(table[word])
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    table: list[bytes] = []
    width, acc, bits, last = 9, 0, 0, None
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        # codes grow one entry early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _compress(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits}[compression](data)


def _decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == NONE:
        return data
    raise ValueError(f"TIFF compression {compression} is not read here")


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 1) -> bytes:
    """A little-endian grey TIFF of rows of ``ROW`` 8-bit samples, in as many pages as it takes."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in range(0, len(payload), ROW * PAGE_ROWS):
        page = np.frombuffer(payload[a : a + ROW * PAGE_ROWS], dtype=np.uint8).reshape(-1, ROW)
        if predictor == 2:
            page = np.concatenate((page[:, :1], np.diff(page, axis=1)), axis=1)
        strips = [_compress(page[r : r + STRIP_ROWS].tobytes(), compression) for r in range(0, len(page), STRIP_ROWS)]
        offsets = []
        for strip in strips:
            offsets.append(len(out))
            out += strip + b"\0" * (len(strip) % 2)
        arrays = {}
        for tag, values in ((STRIP_OFFSETS, offsets), (STRIP_BYTES, [len(s) for s in strips])):
            arrays[tag] = values[0] if len(values) == 1 else len(out)
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        entries = [(WIDTH_TAG, 4, 1, ROW), (HEIGHT_TAG, 4, 1, len(page)), (BITS_TAG, 3, 1, 8), (COMPRESSION_TAG, 3, 1, compression), (PHOTOMETRIC_TAG, 3, 1, 1), (STRIP_OFFSETS, 4, len(strips), arrays[STRIP_OFFSETS]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_BYTES, 4, len(strips), arrays[STRIP_BYTES]), (PREDICTOR, 3, 1, predictor)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for entry in entries:
            out += struct.pack("<HHII", *entry)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages(media: bytes) -> Iterator[dict]:
    """One dict a page: page, width, height, bits, samples, compression, pixels (bytes, rows in order)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, number = struct.unpack_from(order + "I", media, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the image directories form a circle")
        seen.add(at)
        tags: dict[int, tuple] = {}
        (count,) = struct.unpack_from(order + "H", media, at)
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            if kind in TYPES:
                form = f"{order}{n}{TYPES[kind]}"
                place = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, media, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", media, place)[0])
        yield {"page": number} | _page(media, tags, order)
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * count)
        number += 1


def _page(media: bytes, tags: dict[int, tuple], order: str) -> dict:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH_TAG), one(HEIGHT_TAG), one(SAMPLES, 1), one(BITS_TAG, 1)
    if bits not in (8, 16, 32) or one(PLANAR, 1) != 1:
        raise ValueError("only samples of 8, 16 or 32 bits, side by side, are read here")
    dtype = np.dtype(f"{order}u{bits // 8}")
    if TILE_OFFSETS in tags:
        w, h, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        w, h, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    out = np.zeros((height, width, samples), dtype=dtype)
    across = -(-width // w)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if TILE_OFFSETS in tags else min(h, height - y)
        need = rows * w * samples * dtype.itemsize
        block = np.frombuffer(_decompress(media[offset : offset + size], one(COMPRESSION_TAG, NONE), need), dtype=dtype, count=rows * w * samples).reshape(rows, w, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"TIFF predictor {one(PREDICTOR)} is not read here")
        out[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": one(COMPRESSION_TAG, NONE), "pixels": out.tobytes()}


PAGE_SCHEMA = "page int, width int, height int, bits int, samples int, compression int, pixels binary"


def _paged(keep: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, dict]] = []
            size = 0
            for i, media in enumerate(batch.column(column)):
                if media.is_valid:
                    for page in pages(media.as_py()):
                        rows.append((i, page))
                        size += len(page["pixels"])
                        if size > 4 << 20:
                            yield _page_rows(batch, keep, rows)
                            rows, size = [], 0
            if rows:
                yield _page_rows(batch, keep, rows)

    return run


def _page_rows(batch: pa.RecordBatch, keep: list[str], rows: list[tuple[int, dict]]) -> pa.RecordBatch:
    at = pa.array([i for i, _ in rows], pa.int64())
    fields = ["page", "width", "height", "bits", "samples", "compression"]
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], *[pa.array([p[f] for _, p in rows], pa.int32()) for f in fields], pa.array([p["pixels"] for _, p in rows], pa.binary())], [*keep, *fields, "pixels"])


def read_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of the TIFF files in column ``media``, with the columns ``keep``.

    A null file has no pages.  Damaged files and kinds that are not read here raise.  The rows of a
    file follow each other in page order.
    """
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(df.select(*keep, media), _paged(list(keep), media), f"{types}, {PAGE_SCHEMA}")


def _stored_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            rows = batch.slice(a, 500)
            raw = [(t or "").encode() for t in rows.column("text").to_pylist()]
            media = [write(r + b"\0" * (-len(r) % ROW or ROW * (not r))) for r in raw]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, media): each text as a TIFF file.

    The text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are the samples.
    Null texts are empty; repeated rows give repeated rows; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _stored_text, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file from its consecutive pages."""
    kept = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    state: dict | None = None

    def row(s: dict) -> tuple:
        p = s["counts"] / s["counts"].sum()
        mean = float((p * np.arange(256)).sum())
        entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
        spread = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
        feature = f"pages={s['pages']};width={s['width']};height={s['height']};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f}"
        return (*s["key"], s["size"], s["hash"].hexdigest(), zlib.crc32(s["tail"]), feature)

    names = [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        keys = list(zip(*[batch.column(c).to_pylist() for c in kept], strict=True))
        for i, (key, page) in enumerate(zip(keys, batch.column("page").to_pylist(), strict=True)):
            pixels = batch.column("pixels")[i].as_py()
            if page == 0:
                if state:
                    out.append(row(state))
                state = {"key": key, "hash": sha256(), "size": 0, "pages": 0, "height": 0, "width": batch.column("width")[i].as_py(), "counts": np.zeros(256, dtype=np.int64)}
            state["hash"].update(pixels)
            state["size"] += len(pixels)
            state["pages"] += 1
            state["height"] += batch.column("height")[i].as_py()
            state["counts"] += np.bincount(np.frombuffer(pixels, dtype=np.uint8), minlength=256)
            state["tail"] = pixels[-64:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(state), types, strict=True)], names)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF in a table, read the table's bytes back, decode them page by page and
    sum up each file: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  The cases of ``text_media`` hold."""
    media = stored(text_media(docs), "media")
    found = read_pages(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    types = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return mapped(found, _summed, types).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
