"""Image files: uncompressed TIFF and DNG both ways, embedded JPEG previews, baseline JPEG out, and generated rasters.

Files are read as binary rows and decoded a batch at a time into pixel rows; frames are encoded one to a task.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.colour import noise
from rasterloom.functions.dialect import SPARK, Dialect, num

MOST_SIDE, MOST_PIXELS = 16384, 200_000_000
#: Lines of the tallest picture that is read back, and of the tallest a JPEG holds in whole blocks.
TIFF_LINES, JPEG_LINES = MOST_SIDE, 65_528


def decode_tiff(data: bytes) -> np.ndarray | None:
    """S3: linear values (height, width, 3) of the first image, or None if it isn't an uncompressed 8- or 16-bit file within limits; grey is repeated."""
    if len(data) < 16 or data[:4] not in (b"II*\0", b"MM\0*"):
        return None
    end = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(end + "I", data, 4)
    if at + 2 > len(data):
        return None
    (n,) = struct.unpack_from(end + "H", data, at)
    if at + 2 + 12 * n > len(data):
        return None
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        value = struct.unpack_from(end + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
        if kind == 3 and count > 2:  # more than fits in the entry: the first of the list
            (place,) = struct.unpack_from(end + "I", data, at + 10 + 12 * i)
            if place + 2 > len(data):
                return None
            (value,) = struct.unpack_from(end + "H", data, place)
        tags[tag] = value
    w, h, bits, spp = tags.get(0x100, 0), tags.get(0x101, 0), tags.get(0x102, 8), tags.get(0x115, 3)
    start = tags.get(0x111, 0)
    if tags.get(0x103, 1) != 1 or not 0 < w <= MOST_SIDE or not 0 < h <= MOST_SIDE or w * h > MOST_PIXELS or bits not in (8, 16) or not 1 <= spp <= 4:
        return None
    size = w * h * spp * bits // 8
    if start + size > len(data):
        return None
    raw = np.frombuffer(data, np.dtype(end + ("u1" if bits == 8 else "u2")), w * h * spp, start).reshape(h, w, spp) / float((1 << bits) - 1)
    return raw[:, :, :3] if spp >= 3 else np.repeat(raw[:, :, :1], 3, 2)


def encode_tiff(rgb: np.ndarray, bits: int = 16, dng: bool = False, model: str = "") -> bytes:
    """K2, K3: an uncompressed little-endian file of integer values (height, width, 3); a DNG adds its version and camera name."""
    h, w, _ = rgb.shape
    body = np.ascontiguousarray(rgb.astype("<u2" if bits == 16 else "u1")).tobytes()
    name = (model or "camera").encode() + b"\0"
    entries = [(0xFE, 4, 1, 0), (0x100, 4, 1, w), (0x101, 4, 1, h), (0x102, 3, 3, "bits"), (0x103, 3, 1, 1), (0x106, 3, 1, 34892 if dng else 2), (0x111, 4, 1, "body"), (0x115, 3, 1, 3), (0x116, 4, 1, h), (0x117, 4, 1, len(body)), (0x11C, 3, 1, 1)]
    if dng:
        entries += [(0xC612, 1, 4, int.from_bytes(bytes((1, 4, 0, 0)), "little")), (0xC614, 2, len(name), "name")]
    after = 8 + 2 + 12 * len(entries) + 4
    places = {"bits": after, "name": after + 6}
    places["body"] = after + 6 + len(name) + len(name) % 2
    out = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for tag, kind, count, v in entries:
        out += struct.pack("<HHII", tag, kind, count, places.get(v, v))
    out += struct.pack("<I", 0) + struct.pack("<HHH", bits, bits, bits) + name + b"\0" * (len(name) % 2)
    return out + body


def jpeg_size(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(width, height) of a JPEG that starts at a place, from its frame header."""
    p = at + 2
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            p += 1
            continue
        marker, p = data[p + 1], p + 2
        if marker in (0xD9, 0xDA):
            return None
        if marker == 0 or 0xD0 <= marker <= 0xD7:
            continue
        if p + 2 > len(data):
            return None
        (size,) = struct.unpack_from(">H", data, p)
        if size < 2 or p + size > len(data):
            return None
        if 0xC0 <= marker <= 0xC3 and p + 7 <= len(data):
            h, w = struct.unpack_from(">HH", data, p + 3)
            return (w, h) if w and h else None
        p += size
    return None


def embedded_preview(data: bytes, most: int = 8 << 20) -> tuple[int, int, bytes] | None:
    """Width, height and bytes of the longest JPEG inside the first bytes of a file (each ends at its first end mark)."""
    data = data[:most]
    if data[:2] == b"\xff\xd8" and (size := jpeg_size(data)):
        return *size, data
    best, at = None, data.find(b"\xff\xd8\xff")
    while at >= 0:
        if size := jpeg_size(data, at):
            end = data.find(b"\xff\xd9", at + 2)
            if end >= 0 and (best is None or end + 2 - at > len(best[2])):
                best = (*size, data[at : end + 2])
        at = data.find(b"\xff\xd8\xff", at + 1)
    return best


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows (path, x, y, r, g, b) of image files below path; files that can't be decoded give none. Camera formats need an outside decoder."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"]):
                img = decode_tiff(data)
                if img is None:
                    continue
                h, w, _ = img.shape
                for y0 in range(0, h, max(1, 500_000 // w)):  # bands bound the rows held at once
                    band = img[y0 : y0 + max(1, 500_000 // w)]
                    ys, xs = np.mgrid[y0 : y0 + len(band), 0:w]
                    yield pd.DataFrame({"path": p, "x": xs.ravel(), "y": ys.ravel(), "r": band[..., 0].ravel(), "g": band[..., 1].ravel(), "b": band[..., 2].ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x long, y long, r double, g double, b double")


def read_previews(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, jpeg) of files that hold a preview."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(p, *x) for p, d in zip(part["path"], part["content"]) if (x := embedded_preview(d))]
            yield pd.DataFrame(found, columns=["path", "width", "height", "jpeg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, jpeg binary")


def encode_frames(df: DataFrame, kind: str = "tiff16", quality: int = 90, lines: int | None = None) -> DataFrame:
    """K1-K3: (frame_id, width, height, data) of quantised pixels (frame_id, x, y, r8, g8, b8), a picture to a task. kind: tiff8, tiff16, dng or jpeg.

    lines: taller frames become several pictures of the frame's width and so many lines, the last of what is left, each with its
    first line in column top; a band without any pixel is black. Else a frame is one picture.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        top = int(part["top"].iloc[0])
        w, h = int(part["w"].iloc[0]), int(part["h"].iloc[0]) - top
        h = min(h, lines) if lines else h
        seen = part[part["x"].notna()]
        img = np.zeros((h, w, 3), np.uint16)
        img[seen["y"].astype(int) - top, seen["x"].astype(int)] = seen[["r8", "g8", "b8"]]
        data = encode_jpeg(img, quality) if kind == "jpeg" else encode_tiff(img, 8 if kind == "tiff8" else 16, kind == "dng")
        return pd.DataFrame({"frame_id": [part["frame_id"].iloc[0]], "width": [w], "height": [h], "data": [data], "top": [top]})

    band = f"y div {lines} * {lines}" if lines else "0"
    rows = df.selectExpr("frame_id", "x", "y", "r8", "g8", "b8", f"CAST({band} AS BIGINT) AS top")
    # every band of a frame is a picture, also where it has no pixels; sizes are one row a frame
    sizes = df.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    tops = sizes.withColumn("top", F.explode(F.expr(f"sequence(0L, CAST(h - 1 AS BIGINT), {lines}L)" if lines else "array(0L)")))
    out = tops.join(rows, ["frame_id", "top"], "left").groupBy("frame_id", "top")
    made = out.applyInPandas(run, f"frame_id {df.schema['frame_id'].dataType.simpleString()}, width int, height int, data binary, top long")
    return made if lines else made.drop("top")


# The baseline JPEG quantisation tables, and code lengths and symbols of its entropy tables.
_LUMA_Q = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
_CHROMA_Q = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32


def _zigzag() -> list[int]:
    """Places of an 8 x 8 block along its diagonals."""
    order = sorted(((i + j, i if (i + j) % 2 else j, i, j) for i in range(8) for j in range(8)))
    return [8 * i + j for _, _, i, j in order]


def _flat_code(symbols: list[int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A prefix code of equal-length words for symbols (a JPEG table may hold any), as header bytes and (code, length) by symbol."""
    bits = max(1, (len(symbols)).bit_length())  # the word of all ones stays free
    counts = [0] * 16
    counts[bits - 1] = len(symbols)
    return bytes(counts) + bytes(symbols), {s: (i, bits) for i, s in enumerate(symbols)}


def encode_jpeg(rgb: np.ndarray, quality: int = 90) -> bytes:
    """K1: baseline, full colour resolution; tables scaled by quality (1 to 100)."""
    q = min(max(quality, 1), 100)
    s = 5000 // q if q < 50 else 200 - 2 * q
    tables = [np.clip((np.array(t) * s + 50) // 100, 1, 255).astype(np.int64) for t in (_LUMA_Q, _CHROMA_Q)]
    zz = _zigzag()
    h, w, _ = rgb.shape
    r, g, b = (np.pad(rgb[..., k].astype(float), ((0, -h % 8), (0, -w % 8)), "edge") for k in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    basis = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    blocks = []
    for k, p in enumerate(planes):
        t = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        f = basis @ t @ basis.T
        blocks.append(np.rint(f.reshape(*f.shape[:2], 64) / tables[min(k, 1)]).astype(np.int64)[..., zz])
    dc_head, dc = _flat_code(list(range(12)))
    ac_head, ac = _flat_code([0x00, 0xF0, *(run << 4 | n for run in range(16) for n in range(1, 11))])
    out, acc, held = bytearray(), 0, 0

    def put(code: int, n: int) -> None:
        nonlocal acc, held
        acc, held = acc << n | code, held + n
        while held >= 8:
            byte = acc >> (held - 8) & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            held -= 8
            acc &= (1 << held) - 1

    def number(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return (v if v >= 0 else v + (1 << n) - 1), n

    last = [0, 0, 0]
    for i in range(blocks[0].shape[0]):
        for j in range(blocks[0].shape[1]):
            for k in range(3):
                block = blocks[k][i, j].tolist()
                v, n = number(block[0] - last[k])
                last[k] = block[0]
                put(*dc[n]), put(v, n)
                run = 0
                top = max((x for x in range(1, 64) if block[x]), default=0)
                for x in range(1, top + 1):
                    if not block[x]:
                        run += 1
                        continue
                    while run > 15:
                        put(*ac[0xF0])
                        run -= 16
                    v, n = number(block[x])
                    put(*ac[run << 4 | n]), put(v, n)
                    run = 0
                if top < 63:
                    put(*ac[0])
    if held:
        put((1 << (8 - held)) - 1, 8 - held)
    seg = lambda m, body: bytes((255, m)) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(seg(0xDB, bytes((k,)) + bytes(int(t[z]) for z in zz)) for k, t in enumerate(tables))
    head += seg(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes((1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1)))
    head += seg(0xC4, b"\0" + dc_head) + seg(0xC4, b"\x10" + ac_head)
    return head + seg(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))) + bytes(out) + b"\xff\xd9"


def exif_rational(seconds: float) -> tuple[int, int]:
    """K5: an exposure time as a fraction: 1 / n below a second, else thousandths."""
    return (1, max(1, math.floor(1 / seconds + 0.5))) if 0 < seconds < 1 else (math.floor(seconds * 1000 + 0.5), 1000)


def exif_payload(meta: dict) -> bytes:
    """K5: an Exif block (make, model, exposure_time, f_number, iso_speed, focal_length, gps_latitude, gps_longitude)."""
    pad = lambda s: s.encode() + b"\0"
    fraction = lambda *v: struct.pack(f"<{2 * len(v)}I", *(x for p in v for x in p))
    thousand = lambda v: (math.floor(v * 1000 + 0.5), 1000)

    def degrees(v: float) -> bytes:
        v = abs(v)
        d, m = int(v), int(v * 60 % 60)
        return fraction((d, 1), (m, 1), thousand((v * 60 - int(v * 60)) * 60))

    def ifd(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
        head, body = struct.pack("<H", len(entries)), b""
        after = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            if len(value) <= 4:
                head += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, count, after + len(body))
                body += value + b"\0" * (len(value) % 2)
        return head + struct.pack("<I", 0) + body

    text = lambda tag, v: (tag, 2, len(pad(v)), pad(v))
    exif = [(0x829A, 5, 1, fraction(exif_rational(meta["exposure_time"]))), (0x829D, 5, 1, fraction(thousand(meta["f_number"]))), (0x8827, 3, 1, struct.pack("<H", min(65535, int(meta["iso_speed"])))), (0x920A, 5, 1, fraction(thousand(meta["focal_length"])))]
    gps = []
    if meta.get("gps_latitude") is not None and meta.get("gps_longitude") is not None:
        lat, lon = meta["gps_latitude"], meta["gps_longitude"]
        gps = [text(1, "N" if lat >= 0 else "S"), (2, 5, 3, degrees(lat)), text(3, "E" if lon >= 0 else "W"), (4, 5, 3, degrees(lon))]
    main = lambda e, g: [text(0x10F, meta.get("make", "")), text(0x110, meta.get("model", "")), (0x8769, 4, 1, struct.pack("<I", e)), *([(0x8825, 4, 1, struct.pack("<I", g))] if gps else [])]
    first = len(ifd(main(0, 0), 8))
    e_at = 8 + first
    e = ifd(exif, e_at)
    g_at = e_at + len(e)
    return b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + ifd(main(e_at, g_at), 8) + e + (ifd(gps, g_at) if gps else b"")


def synthetic_colours(width: int, height: int, d: Dialect = SPARK) -> dict[str, str]:
    """SQL of a generated test frame at x, y: sky, twelve patches, frequency bars and edges, with noise of column grain that depends on place and frame."""
    u, v = f"(x / {num(width)})", f"(y / {num(height)})"
    patch = f"CAST({d.idiv('x * 12', str(width))} AS INT)"
    tone = lambda k: f"(0.15e0 + 0.7e0 * (({patch} * {k} + {k}) % 12) / 11e0)"
    bars = f"(0.1e0 + 0.7e0 * (sin(x * 0.1e0 * (10e0 + {u} * 200e0)) * 0.5e0 + 0.5e0))"
    step = lambda f: f"CASE WHEN x % 32 < 16 THEN 0.85e0 ELSE 0.15e0 END * {num(f)}"
    make = lambda sky, k, f: f"CASE WHEN {v} < {num(1 / 3)} THEN {sky} WHEN {v} < {num(2 / 3)} THEN {tone(k)} WHEN {u} < 0.5e0 THEN {bars} ELSE {step(f)} END"
    y = f"(y + frame_id * {height})"
    grainy = lambda e, s: f"greatest(0e0, {e} + ({noise(d, 'x', y, s)} - {noise(d, 'x', y, s + 50)}) * grain)"
    return {"r": grainy(make(f"0.2e0 + 0.3e0 * {v}", 1, 1.0), 1), "g": grainy(make(f"0.4e0 + 0.3e0 * {v}", 5, 0.9), 2), "b": grainy(make(f"0.8e0 - 0.2e0 * {v}", 7, 0.8), 3)}


def synthetic_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """A generated frame for each row of frames (frame_id, grain); rows are made line by line where the frame's row is."""
    lines = frames.select("frame_id", "grain", F.explode(F.sequence(F.lit(0), F.lit(height - 1)).cast("array<bigint>")).alias("y"))
    px = lines.select("frame_id", "grain", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")).alias("x"))
    return px.selectExpr("frame_id", "x", "y", *[f"{e} AS {k}" for k, e in synthetic_colours(width, height).items()])


def synthetic(spark: SparkSession, width: int, height: int, frame_id: int = 0, grain: float = 0.01) -> DataFrame:
    """One generated frame."""
    return synthetic_frames(spark.range(1).selectExpr(f"{frame_id} AS frame_id", f"{num(grain)} AS grain"), width, height)


def tile(df: DataFrame, x: int, y: int, w: int, h: int, pad: int, width: int, height: int) -> DataFrame:
    """A padded window: a range filter that reaches the scan, with places relative to its corner."""
    x0, y0 = max(0, x - pad), max(0, y - pad)
    x1, y1 = min(width, x + w + pad), min(height, y + h + pad)
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).withColumns({"tx": F.col("x") - x0, "ty": F.col("y") - y0})


def halo_tiles(df: DataFrame, size: int = 2048, pad: int = 16) -> DataFrame:
    """Every pixel with each tile (tile_x, tile_y) whose padded window holds it: up to four, so the table grows by the share of the rims."""
    span = lambda c: F.sequence(F.greatest(F.expr(f"({c} - {pad}) div {size}"), F.lit(0)), F.expr(f"({c} + {pad}) div {size}"))
    return df.withColumn("tile_x", F.explode(span("x"))).withColumn("tile_y", F.explode(span("y")))


# 5 x 7 glyphs of the printable characters from the space on, a number of seven bits (lowest on top) for each of five columns.
GLYPHS = {
    " ": (0x00, 0x00, 0x00, 0x00, 0x00), "!": (0x00, 0x00, 0x5F, 0x00, 0x00), '"': (0x00, 0x07, 0x00, 0x07, 0x00), "#": (0x14, 0x7F, 0x14, 0x7F, 0x14),
    "$": (0x24, 0x2A, 0x7F, 0x2A, 0x12), "%": (0x23, 0x13, 0x08, 0x64, 0x62), "&": (0x36, 0x49, 0x55, 0x22, 0x50), "'": (0x00, 0x05, 0x03, 0x00, 0x00),
    "(": (0x00, 0x1C, 0x22, 0x41, 0x00), ")": (0x00, 0x41, 0x22, 0x1C, 0x00), "*": (0x08, 0x2A, 0x1C, 0x2A, 0x08), "+": (0x08, 0x08, 0x3E, 0x08, 0x08),
    ",": (0x00, 0x50, 0x30, 0x00, 0x00), "-": (0x08, 0x08, 0x08, 0x08, 0x08), ".": (0x00, 0x60, 0x60, 0x00, 0x00), "/": (0x20, 0x10, 0x08, 0x04, 0x02),
    "0": (0x3E, 0x51, 0x49, 0x45, 0x3E), "1": (0x00, 0x42, 0x7F, 0x40, 0x00), "2": (0x42, 0x61, 0x51, 0x49, 0x46), "3": (0x21, 0x41, 0x45, 0x4B, 0x31),
    "4": (0x18, 0x14, 0x12, 0x7F, 0x10), "5": (0x27, 0x45, 0x45, 0x45, 0x39), "6": (0x3C, 0x4A, 0x49, 0x49, 0x30), "7": (0x01, 0x71, 0x09, 0x05, 0x03),
    "8": (0x36, 0x49, 0x49, 0x49, 0x36), "9": (0x06, 0x49, 0x49, 0x29, 0x1E), ":": (0x00, 0x36, 0x36, 0x00, 0x00), ";": (0x00, 0x56, 0x36, 0x00, 0x00),
    "<": (0x08, 0x14, 0x22, 0x41, 0x00), "=": (0x14, 0x14, 0x14, 0x14, 0x14), ">": (0x00, 0x41, 0x22, 0x14, 0x08), "?": (0x02, 0x01, 0x51, 0x09, 0x06),
    "@": (0x32, 0x49, 0x79, 0x41, 0x3E), "A": (0x7E, 0x11, 0x11, 0x11, 0x7E), "B": (0x7F, 0x49, 0x49, 0x49, 0x36), "C": (0x3E, 0x41, 0x41, 0x41, 0x22),
    "D": (0x7F, 0x41, 0x41, 0x22, 0x1C), "E": (0x7F, 0x49, 0x49, 0x49, 0x41), "F": (0x7F, 0x09, 0x09, 0x09, 0x01), "G": (0x3E, 0x41, 0x49, 0x49, 0x7A),
    "H": (0x7F, 0x08, 0x08, 0x08, 0x7F), "I": (0x00, 0x41, 0x7F, 0x41, 0x00), "J": (0x20, 0x40, 0x41, 0x3F, 0x01), "K": (0x7F, 0x08, 0x14, 0x22, 0x41),
    "L": (0x7F, 0x40, 0x40, 0x40, 0x40), "M": (0x7F, 0x02, 0x0C, 0x02, 0x7F), "N": (0x7F, 0x04, 0x08, 0x10, 0x7F), "O": (0x3E, 0x41, 0x41, 0x41, 0x3E),
    "P": (0x7F, 0x09, 0x09, 0x09, 0x06), "Q": (0x3E, 0x41, 0x51, 0x21, 0x5E), "R": (0x7F, 0x09, 0x19, 0x29, 0x46), "S": (0x46, 0x49, 0x49, 0x49, 0x31),
    "T": (0x01, 0x01, 0x7F, 0x01, 0x01), "U": (0x3F, 0x40, 0x40, 0x40, 0x3F), "V": (0x1F, 0x20, 0x40, 0x20, 0x1F), "W": (0x3F, 0x40, 0x38, 0x40, 0x3F),
    "X": (0x63, 0x14, 0x08, 0x14, 0x63), "Y": (0x07, 0x08, 0x70, 0x08, 0x07), "Z": (0x61, 0x51, 0x49, 0x45, 0x43), "[": (0x00, 0x7F, 0x41, 0x41, 0x00),
    "\\": (0x02, 0x04, 0x08, 0x10, 0x20), "]": (0x00, 0x41, 0x41, 0x7F, 0x00), "^": (0x04, 0x02, 0x01, 0x02, 0x04), "_": (0x40, 0x40, 0x40, 0x40, 0x40),
    "`": (0x00, 0x01, 0x02, 0x04, 0x00), "a": (0x20, 0x54, 0x54, 0x54, 0x78), "b": (0x7F, 0x48, 0x44, 0x44, 0x38), "c": (0x38, 0x44, 0x44, 0x44, 0x20),
    "d": (0x38, 0x44, 0x44, 0x48, 0x7F), "e": (0x38, 0x54, 0x54, 0x54, 0x18), "f": (0x08, 0x7E, 0x09, 0x01, 0x02), "g": (0x08, 0x14, 0x54, 0x54, 0x3C),
    "h": (0x7F, 0x08, 0x04, 0x04, 0x78), "i": (0x00, 0x44, 0x7D, 0x40, 0x00), "j": (0x20, 0x40, 0x44, 0x3D, 0x00), "k": (0x7F, 0x10, 0x28, 0x44, 0x00),
    "l": (0x00, 0x41, 0x7F, 0x40, 0x00), "m": (0x7C, 0x04, 0x18, 0x04, 0x78), "n": (0x7C, 0x08, 0x04, 0x04, 0x78), "o": (0x38, 0x44, 0x44, 0x44, 0x38),
    "p": (0x7C, 0x14, 0x14, 0x14, 0x08), "q": (0x08, 0x14, 0x14, 0x18, 0x7C), "r": (0x7C, 0x08, 0x04, 0x04, 0x08), "s": (0x48, 0x54, 0x54, 0x54, 0x20),
    "t": (0x04, 0x3F, 0x44, 0x40, 0x20), "u": (0x3C, 0x40, 0x40, 0x20, 0x7C), "v": (0x1C, 0x20, 0x40, 0x20, 0x1C), "w": (0x3C, 0x40, 0x30, 0x40, 0x3C),
    "x": (0x44, 0x28, 0x10, 0x28, 0x44), "y": (0x0C, 0x50, 0x50, 0x50, 0x3C), "z": (0x44, 0x64, 0x54, 0x4C, 0x44), "{": (0x00, 0x08, 0x36, 0x41, 0x00),
    "|": (0x00, 0x00, 0x7F, 0x00, 0x00), "}": (0x00, 0x41, 0x36, 0x08, 0x00), "~": (0x08, 0x08, 0x2A, 0x1C, 0x08),
}


def glyph_cells(text: str, scale: int, font: dict[str, tuple[int, ...]]) -> set[tuple[int, int]]:
    """Places of a text's ink from its upper left corner, a place for each byte of it; what the font lacks is a blank."""
    signs = [font.get(chr(b), (0,) * 5) for b in text.encode()]
    return {((7 * i + col) * scale + dx, row * scale + dy) for i, sign in enumerate(signs) for col, bits in enumerate(sign) for row in range(7) if bits >> row & 1 for dx in range(scale) for dy in range(scale)}


def watermark(df: DataFrame, width: int, height: int, text: str, font: dict[str, tuple[int, ...]] = GLYPHS, below: bool = True) -> DataFrame:
    """K6: quantised pixels with centred text on a dark margin below (its rows are generated), or blended into the lower right corner.

    font: five column numbers for each character; the default one has the printable ones. Glyph cells are few and broadcast.
    """
    scale = max(1, width // 1000)
    tall, long = max(60, int(height * 0.08)), 7 * scale * len(text.encode())
    left, top = (max(20, (width - long) // 2), height + (tall - 7 * scale) // 2) if below else (max(20, width - long - 30 * scale), height - 31 * scale)
    cells = sorted((left + x, top + y) for x, y in glyph_cells(text, scale, font) if left + x < width and 0 <= top + y < height + tall * below)
    spark, cols = df.sparkSession, ("r8", "g8", "b8")
    marks = F.broadcast(spark.createDataFrame(cells or [(-1, -1)], "x long, y long").withColumn("ink", F.lit(True)))
    pixels = df.select("frame_id", "x", "y", *cols)
    if not below:
        blended = [F.when(F.col("ink"), F.floor((F.col(c) * 30 + 255 * 225) / 255)).otherwise(F.col(c)).cast("int").alias(c) for c in cols]
        return pixels.join(marks, ["x", "y"], "left").select("frame_id", "x", "y", *blended)
    ink, dark = (0xE5, 0xE5, 0xEA), (0x0F, 0x0F, 0x12)
    margin = spark.range(width * tall).select(F.expr(f"CAST(id % {width} AS BIGINT)").alias("x"), F.expr(f"{height} + id div {width}").alias("y")).join(marks, ["x", "y"], "left")
    margin = margin.crossJoin(F.broadcast(df.select("frame_id").distinct()))
    return pixels.unionByName(margin.select("frame_id", "x", "y", *[F.when(F.col("ink"), a).otherwise(b).cast("int").alias(k) for k, a, b in zip(cols, ink, dark)]))
