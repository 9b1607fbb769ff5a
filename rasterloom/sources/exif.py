"""Exif directories: written from columns, read from files of either byte order, in bare TIFF and DNG files and in a JPEG's first segments.

A directory is read within its file's bounds: entries whose values lie outside are left out, chains of directories aren't followed twice,
and a file that has none gives nulls. Rows are worked off one by one in Arrow batches; a file's directory is small, and only its first
HEAD bytes are looked at.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 1 << 20
#: Tags by directory (main, exif, gps), and what kind of value each has.
TEXT, SHORT, LONG, RATIO = 2, 3, 4, 5
MAIN = {"make": (0x010F, TEXT), "model": (0x0110, TEXT), "orientation": (0x0112, SHORT), "software": (0x0131, TEXT), "taken": (0x0132, TEXT), "width": (0x0100, LONG), "height": (0x0101, LONG)}
EXIF = {"exposure_time": (0x829A, RATIO), "f_number": (0x829D, RATIO), "iso_speed": (0x8827, SHORT), "focal_length": (0x920A, RATIO), "lens": (0xA434, TEXT)}
EXIF_AT, GPS_AT, TAKEN = 0x8769, 0x8825, 0x9003
LATITUDE, LONGITUDE = (1, 2, "NS", 90), (3, 4, "EW", 180)
FIELDS = "make string, model string, orientation int, software string, taken string, width int, height int, exposure_time double, f_number double, iso_speed int, focal_length double, lens string, latitude double, longitude double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_SIZE = {1: 1, TEXT: 1, SHORT: 2, LONG: 4, RATIO: 8}


# ---- writing


def _ratio(x: float, per: int) -> tuple[int, int]:
    return int(math.floor(abs(x) * per + 0.5)), per


def _angle(x: float) -> list[tuple[int, int]]:
    degrees = abs(x)
    minutes = (degrees - int(degrees)) * 60
    return [(int(degrees), 1), (int(minutes), 1), (int((minutes - int(minutes)) * 6000 + 0.5), 100)]


def build(row: dict, big: bool = False) -> bytes:
    """A TIFF header and its directories: texts, times as one over a whole number, apertures and focal lengths in tenths, places in hundredths of a second."""
    e = ">" if big else "<"
    there = lambda v: v is not None and v == v
    main = [(t, k, row[n]) for n, (t, k) in MAIN.items() if there(row.get(n))]
    exif = [(t, k, row[n]) for n, (t, k) in EXIF.items() if there(row.get(n))]
    if there(row.get("taken")):
        exif.append((TAKEN, TEXT, row["taken"]))
    gps = []
    for name, (ref, tag, signs, _) in (("latitude", LATITUDE), ("longitude", LONGITUDE)):
        if there(row.get(name)):
            gps += [(ref, TEXT, signs[row[name] < 0]), (tag, RATIO, _angle(row[name]))]

    def value(tag: int, kind: int, v: object) -> tuple[int, bytes]:
        if kind == TEXT:
            raw = str(v).encode() + b"\0"
            return len(raw), raw
        if kind == RATIO:
            pairs = v if isinstance(v, list) else [(1, max(1, int(1 / v + 0.5)))] if tag == EXIF["exposure_time"][0] and v > 0 else [_ratio(v, 10)]
            return len(pairs), b"".join(struct.pack(e + "II", *p) for p in pairs)
        return 1, struct.pack(e + ("H" if kind == SHORT else "I"), int(v))

    def directory(entries: list[tuple[int, int, object]], at: int) -> bytes:
        """The directory at a place, its longer values right behind it."""
        heap_at, heap, out = at + 2 + 12 * len(entries) + 4, b"", struct.pack(e + "H", len(entries))
        for tag, kind, v in sorted(entries, key=lambda x: x[0]):
            n, raw = value(tag, kind, v)
            out += struct.pack(e + "HHI", tag, kind, n)
            if len(raw) <= 4:
                out += raw.ljust(4, b"\0")
            else:
                out += struct.pack(e + "I", heap_at + len(heap))
                heap += raw + b"\0" * (len(raw) % 2)
        return out + struct.pack(e + "I", 0) + heap

    # directories lie one behind the other; pointers don't change the main one's length
    parts, start = [], 8 + len(directory([*main, *((t, LONG, 0) for t, d in ((EXIF_AT, exif), (GPS_AT, gps)) if d)], 8))
    for tag, entries in ((EXIF_AT, exif), (GPS_AT, gps)):
        if entries:
            main.append((tag, LONG, start))
            parts.append(directory(entries, start))
            start += len(parts[-1])
    return struct.pack(e + "2sHI", b"MM" if big else b"II", 42, 8) + directory(main, 8) + b"".join(parts)


def in_jpeg(tiff: bytes) -> bytes:
    """A JPEG's start with the directories in its first segment."""
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


# ---- reading


def _tiff(data: bytes) -> bytes | None:
    """The part of a file that starts with a TIFF header."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        (size,) = struct.unpack_from(">H", data, at + 2)
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            inner = data[at + 10 : at + 2 + size]
            return inner if inner[:4] in (b"II*\0", b"MM\0*") else None
        at += 2 + max(size, 2)
    return None


def parse(data: bytes | None) -> dict | None:
    """The fields of a file's directories, or None if it has none."""
    tiff = _tiff(data[:HEAD]) if data else None
    if tiff is None or len(tiff) < 8:
        return None
    e = "<" if tiff[:1] == b"I" else ">"

    def directory(at: int) -> dict[int, object]:
        if at < 8 or at + 2 > len(tiff):
            return {}
        found = {}
        for i in range(struct.unpack_from(e + "H", tiff, at)[0]):
            p = at + 2 + 12 * i
            if p + 12 > len(tiff):
                break
            tag, kind, n = struct.unpack_from(e + "HHI", tiff, p)
            size = _SIZE.get(kind, 0) * n
            place = p + 8 if size <= 4 else struct.unpack_from(e + "I", tiff, p + 8)[0]
            if not size or place + size > len(tiff):
                continue
            raw = tiff[place : place + size]
            if kind == TEXT:
                found.setdefault(tag, raw.split(b"\0")[0].decode("utf-8", "replace"))
            elif kind in (SHORT, LONG):
                found.setdefault(tag, struct.unpack_from(e + ("H" if kind == SHORT else "I"), raw)[0])
            elif kind == RATIO:
                pairs = struct.iter_unpack(e + "II", raw)
                found.setdefault(tag, [a / b if b else None for a, b in pairs])
        return found

    main = directory(struct.unpack_from(e + "I", tiff, 4)[0])
    own = {t: directory(main[t]) if isinstance(main.get(t), int) else {} for t in (EXIF_AT, GPS_AT)}
    out: dict = dict.fromkeys(NAMES)
    for name, (tag, kind) in MAIN.items():
        v = main.get(tag)
        out[name] = v if isinstance(v, str if kind == TEXT else int) else None
    for name, (tag, kind) in EXIF.items():
        v = own[EXIF_AT].get(tag)
        out[name] = v[0] if kind == RATIO and isinstance(v, list) else v if isinstance(v, str if kind == TEXT else int) else None
    if out["taken"] is None and isinstance(own[EXIF_AT].get(TAKEN), str):
        out["taken"] = own[EXIF_AT][TAKEN]
    for name, (ref, tag, signs, most) in (("latitude", LATITUDE), ("longitude", LONGITUDE)):
        v = own[GPS_AT].get(tag)
        if isinstance(v, list) and len(v) == 3 and None not in v:
            size = v[0] + v[1] / 60 + v[2] / 3600
            out[name] = (-size if own[GPS_AT].get(ref) == signs[1] else size) if size <= most else None
    return out


def _frame(rows: list[dict | None]) -> pd.DataFrame:
    df = pd.DataFrame([r or dict.fromkeys(NAMES) for r in rows], columns=NAMES)
    whole = [n for n, f in zip(NAMES, FIELDS.split(", ")) if f.endswith(" int")]
    return df.astype({n: "Int32" for n in whole} | {n: "float64" for n, f in zip(NAMES, FIELDS.split(", ")) if f.endswith(" double")})


def read_exif(df: DataFrame, data: str = "data") -> DataFrame:
    """Df with the Exif fields of its files (column of bytes) in place of the bytes; nulls where a file has none."""
    @F.pandas_udf(FIELDS)
    def fields(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in files:
            yield _frame([parse(bytes(d) if d is not None else None) for d in part])

    own = [c for c in df.columns if c != data and c not in NAMES]
    return df.select(*own, fields(data).alias("_exif")).select(*own, "_exif.*")


def write_exif(df: DataFrame, big: Column, jpeg: Column, out: str = "data") -> DataFrame:
    """K2: df with the bytes of directories of its columns (of NAMES, those it has); big: big-endian order; jpeg: inside a JPEG's start."""
    has = [n for n in NAMES if n in df.columns]

    @F.pandas_udf("binary")
    def built(parts: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, order, inside in parts:
            made = [build({n: None if pd.isna(v) else v for n, v in zip(has, r)}, bool(b)) for r, b in zip(rows.itertuples(index=False, name=None), order)]
            yield pd.Series([in_jpeg(t) if j else t for t, j in zip(made, inside)])

    return df.withColumn(out, built(F.struct(*has), big, jpeg))


def camera_name(make: Column, model: Column) -> Column:
    """The model alone if it begins with the make (in any case), else both."""
    make, model = F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))
    return F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def upright(orientation: Column) -> Column:
    """How a preview is turned: quarter turns clockwise and whether it is mirrored first, from its orientation (1 to 8; any other: none)."""
    turns = F.when(orientation.isin(3, 4), 2).when(orientation.isin(6, 7), 1).when(orientation.isin(5, 8), 3).otherwise(0)
    return F.struct(turns.alias("quarter_turns"), F.coalesce(orientation.isin(2, 4, 5, 7), F.lit(False)).alias("mirrored"))
