"""Catalog operations: file names, sidecars and presets, parameter merges, upserts, enrichment, ranking and trimming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rasterloom.functions.dialect import num
from rasterloom.operators import xmp
from rasterloom.sources.staging import cut

# Suffixes of raw files, and file types by format.
RAW = ("dng", "arw", "cr2", "cr3", "nef", "raf", "orf", "rw2", "pef")
FORMATS = {"jpeg": ("jpg", "image/jpeg"), "tiff16": ("tif", "image/tiff"), "webp": ("webp", "image/webp"), "dng": ("dng", "image/x-adobe-dng")}


def suffix(name: str) -> str:
    return f"lower(substring_index({name}, '.', -1))"


def is_raw(name: str | Column) -> Column:
    """S9."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.substring_index(c, ".", -1)).isin(*RAW)


def file_type(fmt: Column) -> tuple[Column, Column]:
    """File suffix and media type of an export format; JPEG for any other."""
    pick = lambda k: F.coalesce(*[F.when(F.lower(fmt) == f, F.lit(v[k])) for f, v in FORMATS.items()], F.lit(FORMATS["jpeg"][k]))
    return pick(0), pick(1)


def shown_exif(df: DataFrame) -> DataFrame:
    """Display strings of exposure_time, f_number, iso_speed and focal_length (0: empty); 1 / time is cut off, numbers are written in full."""
    t = F.col("exposure_time")
    shutter = F.when(t <= 0, "").when(t < 1, F.concat(F.lit("1/"), F.floor(1 / t).cast("string"), F.lit("s"))).otherwise(F.concat(t.cast("double").cast("string"), F.lit("s")))
    return df.select(
        "*",
        shutter.alias("shutter_text"),
        F.when(F.col("f_number") > 0, F.concat(F.lit("f/"), F.col("f_number").cast("double").cast("string"))).otherwise("").alias("aperture_text"),
        F.when(F.col("iso_speed") > 0, F.concat(F.lit("ISO "), F.col("iso_speed").cast("string"))).otherwise("").alias("iso_text"),
        F.when(F.col("focal_length") > 0, F.concat(F.floor("focal_length").cast("string"), F.lit("mm"))).otherwise("").alias("focal_text"),
    )


def exposure_line(camera: Column, lens: Column, focal: Column, aperture: Column, shutter: Column, iso: Column, owner: str) -> Column:
    """One line of text under a picture."""
    s = F.when((shutter < 1) & (shutter > 0), F.concat(F.lit("1/"), F.floor(1 / shutter + 0.5).cast("string"), F.lit("s"))).otherwise(F.concat(shutter.cast("string"), F.lit("s")))
    return F.concat(camera, F.lit("  |  "), lens, F.lit("  |  "), F.floor(focal).cast("string"), F.lit("mm  f/"), F.format_string("%.1f", aperture), F.lit("  "), s, F.lit("  ISO "), iso.cast("string"), F.lit(f"  |  {owner}"))


def exposure_seconds(text: Column) -> Column:
    """Seconds of '1/250s', '1/250' or '0.5'; null if it's none of these."""
    clean = F.trim(F.regexp_replace(text, "s$", ""))
    num_, den = F.element_at(F.split(clean, "/"), 1).try_cast("double"), F.try_element_at(F.split(clean, "/"), F.lit(2)).try_cast("double")
    return F.when(clean.contains("/") & (F.size(F.split(clean, "/")) == 2), F.when(den != 0, num_ / den)).otherwise(clean.try_cast("double"))


def sample_size(width: Column, height: Column, wanted: int) -> Column:
    """The largest power of two by which both sides can be divided and still reach the wanted size."""
    longest = F.least(width, height) / F.lit(float(wanted))
    return F.when(longest < 1, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(longest)))).cast("int")


# Sidecar tags of development settings.
SETTINGS = {
    "exposure_ev": "crs:Exposure2012", "kelvin": "crs:Temperature", "tint": "crs:Tint", "contrast": "crs:Contrast2012", "highlights": "crs:Highlights2012",
    "shadows": "crs:Shadows2012", "whites": "crs:Whites2012", "blacks": "crs:Blacks2012", "vibrance": "crs:Vibrance", "saturation": "crs:Saturation",
    "clarity": "crs:Clarity2012", "dehaze": "crs:Dehaze", "sharpening": "crs:Sharpness", "luminance_nr": "crs:LuminanceSmoothing", "chroma_nr": "crs:ColorNoiseReduction",
}
LABELS = ("none", "red", "yellow", "green", "blue", "purple")


def read_sidecar(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Rating, label, pick, dates and settings of sidecar texts; what is absent or no number is null (pick and label: none)."""
    t = lambda *names: F.coalesce(*[xmp.value("_tags", n) for n in names])
    pick, label = t("crs:Pick", "photoshop:Urgency").try_cast("int"), F.lower(t("xmp:Label"))
    return xmp.tokens(df, xml).select(
        *[c for c in df.columns if c != xml],
        t("xmp:Rating").try_cast("int").alias("rating"),
        F.when(label.isin(*LABELS), label).otherwise("none").alias("label"),
        F.when(pick.isin(-1, 1), pick).otherwise(0).alias("pick"),
        t("xmp:CreateDate", "photoshop:DateCreated", "exif:DateTimeOriginal").alias("capture_date"),
        t("tiff:Make").alias("make"),
        t("tiff:Model").alias("model"),
        t("aux:Lens", "exif:LensModel").alias("lens"),
        *[t(name).try_cast("double").alias(c) for c, name in SETTINGS.items() if c != "chroma_nr"],
    )


def read_preset(df: DataFrame, xml: str = "xml", default: str = "Imported Preset") -> DataFrame:
    """Name, category (upper case), settings and the grey flag of preset texts. Names are looked for in elements first, settings in attributes."""
    own = lambda *names: F.trim(xmp.first("_tags", "elements", *names, filled=True))
    attribute = lambda name: F.trim(xmp.first("_tags", "attributes", name, filled=True))
    number = lambda name: F.coalesce(*[xmp.plain_number(xmp.first("_tags", kind, name)) for kind in ("attributes", "elements")])
    name = F.coalesce(own("crs:PresetName", "dc:title", "xmp:Name"), attribute("crs:PresetName"), F.lit(default))
    group = F.coalesce(own("crs:Group", "crs:Cluster"), attribute("crs:Group"), F.lit("USER"))
    grey = F.exists(F.concat("_tags.attributes", "_tags.elements"), lambda t: (t["name"] == "crs:ConvertToGrayscale") & (t["value"] == "True"))
    return xmp.tokens(df, xml).select(*[k for k in df.columns if k != xml], name.alias("name"), F.upper(group).alias("category"), *[number(t).alias(k) for k, t in SETTINGS.items()], grey.alias("monochrome"))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def setting_texts(settings: dict[str, Column]) -> dict[str, Column]:
    """K8: how settings are written: exposure with sign and two digits, tint with one, all else cut off to whole numbers."""
    how = lambda k, c: F.format_string("%+.2f", c) if k == "exposure_ev" else F.format_string("%.1f", c) if k == "tint" else c.cast("int").cast("string")
    return {SETTINGS[k]: how(k, c) for k, c in settings.items()}


HEAD = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n  <rdf:Description rdf:about=""\n    xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/"\n'
TAIL = '>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'


def write_packet(tags: dict[str, Column]) -> Column:
    """K7, K8: a new packet with these tags as attributes."""
    lines = [F.concat(F.lit(f'   {t}="'), v, F.lit('"')) for t, v in tags.items()]
    return F.concat(F.lit(HEAD), F.concat_ws("\n", *lines), F.lit(TAIL))


def upsert_tags(xml: Column, tags: dict[str, Column]) -> Column:
    """K7: each tag replaced where it stands (attribute, else element) or put into the first description's opening tag."""
    return xmp.changed(xml, tags)


# Bits of a batch sync and the settings that each copies; limits of preset blends.
SYNC = {
    1: ("kelvin", "tint"),
    2: ("exposure_ev", "contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation", "dehaze", "clarity", "texture"),
    4: ("monochrome",),
    8: ("luminance_nr", "chroma_nr", "sharpening"),
    16: ("tone_curve",),
    32: ("rating", "label"),
    64: ("geometry",),
    128: ("split_toning", "grading"),
    256: ("lens_correction",),
    512: ("mask_layers",),
}
ALL = 0xFFFFFFFF
ONLY_ALL = ("output_space", "dither")
LIMITS = {"exposure_ev": (-5, 5), "kelvin": (2000, 12000), "sharpening": (0, 150), "luminance_nr": (0, 100), "chroma_nr": (0, 100)}


def sync_columns(mask: int, columns: Iterable[str]) -> list[str]:
    """The columns that a mask copies."""
    chosen = {c for bit, names in SYNC.items() if mask & bit for c in names} | (set(ONLY_ALL) if mask == ALL else set())
    return [c for c in columns if c in chosen]


def batch_sync(targets: DataFrame, source: DataFrame, mask: int) -> DataFrame:
    """Targets with the masked settings of the one source row, which is broadcast."""
    cols = sync_columns(mask, targets.columns)
    one = source.limit(1).select(*[F.col(c).alias(f"_{c}") for c in cols], F.lit(1).alias("_one"))
    return targets.crossJoin(F.broadcast(one)).withColumns({c: F.col(f"_{c}") for c in cols}).select(*targets.columns)


def preset_blend(base: str, preset: str, setting: str, amount: float) -> str:
    """A setting moved by part of a preset's, within its limits; kelvin counts from 5500."""
    low, high = LIMITS.get(setting, (-100, 100))
    off = f"({preset} - 5500e0)" if setting == "kelvin" else preset
    return f"least(greatest({base} + {off} * {num(max(0.0, amount / 100))}, {num(low)}), {num(high)})"


def preset_monochrome(base: str, preset: str, amount: float) -> str:
    t = max(0.0, amount / 100)
    return f"CASE WHEN {preset} THEN {base} OR {'TRUE' if t >= 0.3 else 'FALSE'} WHEN {base} AND {'TRUE' if t >= 0.5 else 'FALSE'} THEN FALSE ELSE {base} END"


def enrich(shots: DataFrame, catalog: DataFrame, key: str = "uri") -> DataFrame:
    """Catalog values over a shot's own: ratings over 0, picks and labels other than none, texts other than empty; the date only where there is none."""
    c = catalog.select(F.col(key), *[F.col(k).alias(f"_{k}") for k in catalog.columns if k != key])
    df = shots.join(c, key, "left")
    new = {}
    for k in catalog.columns:
        if k == key or k not in shots.columns:
            continue
        v = F.col(f"_{k}")
        good = {"rating": v > 0, "pick_status": v != "NONE", "color_label": v != "NONE", "capture_date": (v != "") & (F.coalesce(F.col(k), F.lit("")) == "")}.get(k)
        new[k] = F.when(good if good is not None else v != "", v).otherwise(F.col(k))
    return df.withColumns(new).select(*shots.columns)


def append_new(old: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """Rows of new whose key isn't in old, after old; one row for each new key."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh.select(*old.columns))


# Fields of a stored catalog entry, their columns and what a missing one is.
ENTRY = {
    "filePath": ("file_path", ""), "fileName": ("file_name", ""), "lastEditedAt": ("last_edited_at", 0), "devParamsJson": ("settings_json", ""), "masksJson": ("masks_json", ""),
    "rating": ("rating", 0), "pickStatus": ("pick_status", "NONE"), "colorLabel": ("colour_label", "NONE"), "captureDate": ("capture_date", ""), "cameraModel": ("camera", ""),
    "lensModel": ("lens", ""), "fNumber": ("f_number", ""), "exposureTime": ("exposure_time", ""), "isoSpeed": ("iso_speed", ""), "focalLength": ("focal_length", ""),
}


def stored_entries(df: DataFrame, json: str = "json") -> DataFrame:
    """Entries of stored catalogs (JSON arrays of objects), newest first by ``position`` (from 1; equal times in stored order).

    A missing field takes its default; a text that is null reads 'null'. What is no object, has no uri, or has a time or rating that is
    there but no number (null is none) ends its catalog: it and what follows are left out. A text that is no JSON array has no entries.
    """
    held = F.transform(F.from_json(json, "array<string>"), lambda e: F.from_json(e, "map<string,string>"))
    number = lambda c: F.coalesce(c.try_cast("long"), c.try_cast("double").cast("long"))
    numeric = [k for k, (_, v) in ENTRY.items() if v == 0]
    there = lambda e, k: F.map_contains_key(e, F.lit(k))
    at = lambda e, k: F.try_element_at(e, F.lit(k))
    wrong = lambda e: e.isNull() | ~there(e, "uri") | F.greatest(*[there(e, k) & number(at(e, k)).isNull() for k in numeric])
    read = lambda e, k: number(at(e, k)) if k in numeric else F.coalesce(at(e, k), F.lit("null"))
    value = lambda e, k: F.when(there(e, k), read(e, k)).otherwise(F.lit(ENTRY[k][1])).alias(ENTRY[k][0])
    end = F.array_position(F.transform("_held", wrong), True)
    good = F.slice("_held", F.lit(1), F.when(end > 0, end - 1).otherwise(F.size("_held")).cast("int"))
    entry = lambda e, i: F.struct((-value(e, "lastEditedAt")).alias("_at"), i.alias("_k"), read(e, "uri").alias("uri"), *[value(e, k) for k in ENTRY])
    rest = [c for c in df.columns if c != json]
    out = df.withColumn("_held", held).where("_held IS NOT NULL").select(*rest, F.posexplode(F.array_sort(F.transform(good, entry))).alias("_p", "_e"))
    return out.select(*rest, (F.col("_p") + 1).alias("position"), "_e.uri", *[F.col(f"_e.{c}") for c, _ in ENTRY.values()])


def save_entries(old: DataFrame, new: DataFrame, cap: int = 50, key: str = "uri", at: str = "last_edited_at") -> DataFrame:
    """New entries over old ones of the same key (empty texts and nulls keep the old value), the newest ``cap`` of all."""
    prior = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    text = {f.name for f in old.schema.fields if isinstance(f.dataType, T.StringType)}
    keep = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit("")) if c in text else F.coalesce(F.col(c), F.col(f"_{c}"))
    merged = new.join(prior, key, "left").select(*[F.col(c) if c == key else keep(c).alias(c) for c in old.columns])
    return merged.unionByName(old.join(new.select(key), key, "left_anti")).orderBy(F.desc(at), key).limit(cap)


def newest(df: DataFrame, n: int, at: str, *ties: str) -> DataFrame:
    """A top-n, which the engine takes without sorting all."""
    return df.orderBy(F.desc(at), *ties).limit(n)


def trim_oldest(files: DataFrame, cap: int, size: str = "bytes", at: str = "modified", groups: int = 1) -> DataFrame:
    """T4: files to delete, oldest first, until 80 % of the cap is left; none while the cap holds.

    The running sum is taken per time bucket first (``groups`` ranges), so no task orders all files. Rows are written with their bucket:
    bounds of ranges are drawn from a sample, another one whenever they are worked out again.
    """
    total = files.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= cap:
        return files.limit(0)
    goal = int(cap * 0.8)
    spread = cut(files.repartitionByRange(max(1, groups), at, "name").withColumn("_p", F.spark_partition_id()))
    before = {r["_p"]: r["s"] for r in spread.groupBy("_p").agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).collect()}  # one row a range
    start, run = {}, 0
    for p in sorted(before):
        start[p] = run
        run += before[p]
    base = F.element_at(F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)]), F.col("_p"))
    gone = base + F.sum(size).over(W.partitionBy("_p").orderBy(at, "name").rowsBetween(W.unboundedPreceding, -1))
    freed = F.coalesce(gone, base)
    return spread.withColumn("_f", freed).where(F.lit(total) - F.col("_f") > goal).drop("_p", "_f")


def cache_key(path: Column, uri: Column) -> Column:
    """P41."""
    return F.md5(F.coalesce(F.nullif(path, F.lit("")), uri))


def sidecar_path(path: Column) -> Column:
    """The suffix of the file name replaced by .xmp."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp"))


def intent_uris(stream: Column, clip: Column) -> Column:
    """The stream list as it is, then clip entries that aren't in it, once each."""
    return F.concat(stream, F.array_distinct(F.array_except(clip, stream)))


# Preset categories in two languages.
CATEGORIES = {"PORTRAIT": "ポートレート", "LANDSCAPE": "風景", "MONOCHROME": "モノクロ", "CINEMATIC": "シネマ", "FILM": "フィルム", "USER": "ユーザー"}


def category_name(c: Column) -> Column:
    """The category of a name in either language; an unknown name is its own, in upper case."""
    known = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (v, k)])
    return F.coalesce(F.element_at(known, F.trim(c)), F.upper(F.trim(c)))


def viewport(view_w: str, view_h: str, image_w: str, image_h: str, scale: str, off_x: str, off_y: str) -> list[dict[str, str]]:
    """The visible part of an image (left, top, right, bottom from 0 to 1) under zoom and a clamped offset."""
    return [
        {"_fit": f"least({view_w} / {image_w}, {view_h} / {image_h})"},
        {"_fw": f"{image_w} * _fit", "_fh": f"{image_h} * _fit"},
        {"_mx": f"greatest(0e0, (_fw * {scale} - {view_w}) * 0.5e0)", "_my": f"greatest(0e0, (_fh * {scale} - {view_h}) * 0.5e0)"},
        {"_ox": f"least(greatest({off_x}, -_mx), _mx)", "_oy": f"least(greatest({off_y}, -_my), _my)"},
        {
            "left_part": f"least(greatest(0.5e0 - ({view_w} * 0.5e0 + _ox) / (_fw * {scale}), 0e0), 1e0)",
            "top_part": f"least(greatest(0.5e0 - ({view_h} * 0.5e0 + _oy) / (_fh * {scale}), 0e0), 1e0)",
            "right_part": f"least(greatest(0.5e0 + ({view_w} * 0.5e0 - _ox) / (_fw * {scale}), 0e0), 1e0)",
            "bottom_part": f"least(greatest(0.5e0 + ({view_h} * 0.5e0 - _oy) / (_fh * {scale}), 0e0), 1e0)",
        },
    ]


def horizon(dx: str, dy: str) -> str:
    """Degrees to turn so that a drawn line is level."""
    return f"-degrees(atan2({dy}, {dx}))"


def slider_kind(value: str, before: str, low: float = -100.0, high: float = 100.0, step: float = 0.05) -> str:
    """limit, zero (crossed), step or none, in this order."""
    return f"CASE WHEN ({value} <= {num(low)} AND {before} > {num(low)}) OR ({value} >= {num(high)} AND {before} < {num(high)}) THEN 'limit' WHEN ({before} < 0e0 AND {value} >= 0e0) OR ({before} > 0e0 AND {value} <= 0e0) THEN 'zero' WHEN abs({value} - {before}) >= {num(step)} THEN 'step' ELSE 'none' END"


def bezier(t: str, x1: float, y1: float, x2: float, y2: float, rounds: int = 12) -> list[dict[str, str]]:
    """The easing value at progress t: the curve's parameter by bisection (a fixed number of halvings), then its height."""
    curve = lambda u, a, b: f"(3e0 * (1e0 - {u}) * (1e0 - {u}) * {u} * {num(a)} + 3e0 * (1e0 - {u}) * {u} * {u} * {num(b)} + {u} * {u} * {u})"
    steps = [{"_u": "0.5e0"}]
    for k in range(2, rounds + 2):
        steps.append({"_u": f"_u + CASE WHEN {curve('_u', x1, x2)} < {t} THEN {num(0.5**k)} ELSE {num(-(0.5**k))} END"})
    return [*steps, {"eased": f"CASE WHEN {t} <= 0e0 THEN 0e0 WHEN {t} >= 1e0 THEN 1e0 ELSE {curve('_u', y1, y2)} END"}]


def recipes(images: DataFrame, table: DataFrame) -> DataFrame:
    """Each image with each of a few recipes (a fixed table, broadcast), named by format."""
    ext, media = file_type(F.col("format"))
    return images.crossJoin(F.broadcast(table)).withColumns({"suffix": ext, "media_type": media})
