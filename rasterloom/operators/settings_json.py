"""Development settings and mask layers from and to JSON text.

One description of the fields gives the Spark type, the reader and the writer. Reading goes field by field in the order of the
description, as its rules say: a field that isn't there keeps its default; one whose value doesn't fit ends the reading,
and what comes behind keeps its defaults too. Inside objects and lists a value that doesn't fit is its default. Texts that aren't JSON
give defaults only. Mask lists end before the first layer that can't be read.

All is done by built-in functions: the text is parsed once into a map of raw values, nested values once more; a list of objects is
parsed element by element only if one of them isn't an object.
Lists of layers go shorter ways where these are exact (read_layers, written_layers).
Numbers are single floats; text that holds a number counts as that number, and text that holds JSON as what it holds. A layer
without an id is named by its place.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER, WHOLE, FLAG, TEXT, NUMBERS = "FLOAT", "INT", "BOOLEAN", "STRING", "ARRAY<FLOAT>"


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    kind: str
    default: object = None
    values: tuple[str, ...] = ()  # of an enumeration: any other text is the default


@dataclasses.dataclass(frozen=True)
class Group:
    """An object, or a list of objects: of a fixed size (missing ones have defaults) or any."""

    name: str
    fields: tuple[Field, ...]
    many: bool = False
    size: int | None = None


def _numbers(default: float, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, NUMBER, default) for n in names)


# fixed values: names, order and defaults of stored settings
SPACES = ("LinearRec2020", "LinearSRGB", "ACEScg", "sRGB", "DisplayP3", "AdobeRGB")
RATIOS = ("ORIGINAL", "FREE", "RATIO_1X1", "RATIO_4X5", "RATIO_3X2", "RATIO_16X9", "RATIO_2X1", "RATIO_65X24", "GOLDEN")
GUIDES = ("NONE", "RULE_OF_THIRDS", "GOLDEN_RATIO", "GOLDEN_SPIRAL", "DIAGONALS", "GRID")
MASK_TYPES = ("LINEAR_GRADIENT", "RADIAL_GRADIENT", "POLYGON_BEZIER", "BRUSH", "LUMINANCE_RANGE", "COLOR_RANGE", "DEPTH_MAP", "SOBEL_EDGE")
OPERATIONS = ("REPLACE", "UNION", "SUBTRACT", "INTERSECT")
MONO_WEIGHTS = (0.18, 0.24, 0.22, 0.16, 0.08, 0.06, 0.03, 0.03)
_SHIFT = _numbers(0.0, "h", "s")
SETTINGS: tuple[Field | Group, ...] = (
    Field("exposureEV", NUMBER, 0.0), Field("kelvin", NUMBER, 5500.0),
    *_numbers(0.0, "tint", "shadowTintR", "shadowTintG", "shadowTintB", "contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation", "dehaze", "clarity", "texture"),
    Field("colorProfile", TEXT, "cinetone"), Field("isMonochrome", FLAG, False),
    Group("hslBands", _numbers(0.0, "h", "s", "l"), many=True, size=8),
    Field("monochromeWeights", NUMBERS, MONO_WEIGHTS),
    Field("luminanceNR", NUMBER, 0.0), Field("luminanceNRDetail", NUMBER, 50.0), Field("luminanceNRContrast", NUMBER, 0.0),
    Field("chromaNR", NUMBER, 0.0), Field("chromaNRDetail", NUMBER, 50.0), Field("chromaNRSmoothness", NUMBER, 50.0),
    Field("sharpeningAmount", NUMBER, 0.0), Field("sharpeningRadius", NUMBER, 1.0), Field("sharpeningDetail", NUMBER, 25.0), Field("sharpeningMasking", NUMBER, 20.0), Field("sharpeningPreviewMask", FLAG, False),
    Field("toneCurveLUT", NUMBERS, ()),
    Group("primaryRed", _SHIFT), Group("primaryGreen", _SHIFT), Group("primaryBlue", _SHIFT),
    Group("splitToning", _numbers(0.0, "hh", "hs", "sh", "ss", "bal")),
    Group("lensCorrection", (Field("enable", FLAG, False), *_numbers(100.0, "dist", "vig", "ca"), *_numbers(0.0, "dfp", "dfg"))),
    Group("geometry", (*_numbers(0.0, "x", "y"), *_numbers(1.0, "w", "h"), Field("ratio", TEXT, "ORIGINAL", RATIOS), Field("rot", NUMBER, 0.0), Field("steps", WHOLE, 0), Field("flipH", FLAG, False), Field("flipV", FLAG, False), *_numbers(0.0, "perspV", "perspH", "dist"), Field("guide", TEXT, "NONE", GUIDES))),
    Field("outputColorSpace", TEXT, "sRGB", SPACES), Field("enableDithering", FLAG, True),
)
#: What a layer's values are read as before its points, strokes and adjustments, and behind them.
LAYER: tuple[Field | Group, ...] = (
    Field("id", TEXT, None), Field("name", TEXT, "Mask Layer"), Field("enabled", FLAG, True), Field("inverted", FLAG, False), Field("opacity", NUMBER, 1.0),
    Field("type", TEXT, "RADIAL_GRADIENT", MASK_TYPES), Field("booleanOp", TEXT, "UNION", OPERATIONS),
    *_numbers(0.2, "linearStartX", "linearStartY"), *_numbers(0.8, "linearEndX", "linearEndY"), Field("linearFeather", NUMBER, 0.2),
    *_numbers(0.5, "radialCenterX", "radialCenterY"), *_numbers(0.3, "radialRadiusX", "radialRadiusY"), Field("radialAngle", NUMBER, 0.0), Field("radialFeather", NUMBER, 0.5),
    Group("polygonVertices", _numbers(0.0, "x", "y"), many=True),
    Group("brushStrokes", (*_numbers(0.0, "x", "y"), Field("p", NUMBER, 1.0), Field("r", NUMBER, 25.0), Field("f", NUMBER, 1.0), Field("er", FLAG, False)), many=True),
    Field("brushRadius", NUMBER, 30.0), Field("brushFeather", NUMBER, 0.5),
    Field("lumaMin", NUMBER, 0.0), Field("lumaMax", NUMBER, 1.0), Field("lumaFeather", NUMBER, 0.1),
    *_numbers(0.0, "colorTargetHue", "colorTargetSat"), Field("colorTargetLum", NUMBER, 0.5), Field("colorTolHue", NUMBER, 30.0), *_numbers(0.3, "colorTolSat", "colorTolLum"),
    Field("depthMin", NUMBER, 0.0), Field("depthMax", NUMBER, 1.0), Field("edgeThreshold", NUMBER, 0.15),
    Group("adjustments", _numbers(0.0, "exposureEV", "contrast", "highlights", "shadows", "whites", "blacks", "kelvinOffset", "tintOffset", "saturation", "clarity", "dehaze")),
)

OBJECT, LIST = "MAP<STRING, STRING>", "ARRAY<STRING>"
OBJECTS = f"ARRAY<{OBJECT}>"


# ---- types and defaults


def type_of(f: Field | Group) -> str:
    if isinstance(f, Field):
        return f.kind
    one = f"STRUCT<{', '.join(f'{x.name}: {x.kind}' for x in f.fields)}>"
    return f"ARRAY<{one}>" if f.many else one


def struct_type(fields: tuple[Field | Group, ...]) -> str:
    return f"STRUCT<{', '.join(f'{f.name}: {type_of(f)}' for f in fields)}>"


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, tuple):
        return f"CAST(array({', '.join(f'{v!r}e0' for v in value)}) AS {kind})"
    if isinstance(value, str):
        return f"'{value}'"
    return f"CAST({value!r}{'e0' if isinstance(value, float) else ''} AS {kind})"


def _struct(fields: tuple[Field, ...], value: Callable[[Field], str]) -> str:
    inner = ", ".join(f"'{f.name}', {value(f)}" for f in fields)
    return f"named_struct({inner})"


def default_of(f: Field | Group) -> str:
    if isinstance(f, Field):
        return _literal(f.default, f.kind)
    one = _struct(f.fields, default_of)
    if not f.many:
        return one
    return f"array_repeat({one}, {f.size})" if f.size else f"CAST(array() AS {type_of(f)})"


# ---- reading


def _scalar(f: Field, raw: str) -> str:
    """The value of raw text, null if it doesn't fit."""
    if f.values:
        return f"CASE WHEN {raw} IN ({', '.join(map(repr, f.values))}) THEN {raw} END"
    if f.kind == FLAG:
        return f"CASE lower({raw}) WHEN 'true' THEN true WHEN 'false' THEN false END"
    if f.kind == TEXT:
        return raw
    number = f"try_cast({raw} AS DOUBLE)"
    return f"CAST({number} AS FLOAT)" if f.kind == NUMBER else f"try_cast({number} AS INT)"


def _optional(f: Field, raw_map: str) -> str:
    return _or_default(f, f"element_at({raw_map}, {f.name!r})")


def _or_default(f: Field, raw: str) -> str:
    return f"coalesce({_scalar(f, raw)}, {default_of(f)})"


def _readable(f: Field | Group, at: str) -> str:
    """Whether the value at hand (raw text, or parsed once more for lists and objects) can be read."""
    if isinstance(f, Group) and f.many:
        seen = f"slice({at}, 1, {f.size})" if f.size else at
        return f"{at} IS NOT NULL AND forall({seen}, e -> e IS NOT NULL)"
    if isinstance(f, Group) or f.kind == NUMBERS:
        return f"{at} IS NOT NULL"
    if f.values or f.kind == TEXT:
        return "true"
    return f"({_scalar(f, at)}) IS NOT NULL"


def _value(f: Field | Group, at: str) -> str:
    if isinstance(f, Group):
        if not f.many:
            return _struct(f.fields, lambda x: _optional(x, at))
        one = _struct(f.fields, lambda x: _optional(x, "o"))
        read = f"transform({at}, o -> {one})"
        if not f.size:
            return read
        # objects before the first one that can't be read stay
        bad = f"coalesce(nullif(array_position(transform({at}, e -> e IS NULL), true), 0) - 1, size({at}))"
        return f"slice(concat(slice({read}, 1, CAST(least({bad}, {f.size}) AS INT)), {default_of(f)}), 1, {f.size})"
    if f.kind == NUMBERS:
        read = f"transform({at}, e -> CAST(coalesce(try_cast(e AS DOUBLE), 0e0) AS FLOAT))"
        return f"CASE WHEN size({at}) = {len(f.default)} THEN {read} ELSE {default_of(f)} END" if f.default else read
    if f.kind == TEXT:
        return f"coalesce({_scalar(f, at)}, {default_of(f) if f.values else repr('null')})"
    return _scalar(f, at)


def _objects(whole: str, text: str) -> str:
    """The objects of a list as maps, null where one isn't an object; whole: the text parsed at once, which holds if each element is an object."""
    return f"CASE WHEN forall({whole}, e -> e IS NOT NULL) THEN {whole} ELSE transform(from_json({text}, '{LIST}'), e -> from_json(e, '{OBJECT}')) END"


def _parsed(f: Field | Group, raw: str) -> str:
    if isinstance(f, Group) and f.many:
        return f"element_at(transform(array(from_json({raw}, '{OBJECTS}')), w -> {_objects('w', raw)}), 1)"
    if isinstance(f, Group):
        return f"from_json({raw}, '{OBJECT}')"
    return f"from_json({raw}, '{LIST}')" if f.kind == NUMBERS else raw


def read_settings(df: DataFrame, text: str, out: str = "settings") -> DataFrame:
    """df with the settings that column text holds."""
    own = df.columns
    raw = df.withColumn("_raw", F.from_json(F.col(text), OBJECT))
    raw = raw.withColumn("_raw", F.expr("coalesce(_raw, CAST(map() AS MAP<STRING, STRING>))"))
    parsed = raw.select(*own, "_raw", F.struct(*[F.expr(_parsed(f, f"element_at(_raw, {f.name!r})")).alias(f.name) for f in SETTINGS]).alias("_at"))
    stops = [f"CASE WHEN map_contains_key(_raw, '{f.name}') AND NOT ({_readable(f, f'_at.{f.name}')}) THEN {i} END" for i, f in enumerate(SETTINGS)]
    stopped = parsed.withColumn("_stop", F.expr(f"coalesce(least({', '.join(stops)}), {len(SETTINGS)})"))

    def final(i: int, f: Field | Group) -> str:
        # a list of fixed size keeps what came before the object that ended the reading
        behind = "_stop >= " if isinstance(f, Group) and f.size else "_stop > "
        there = f"map_contains_key(_raw, '{f.name}') AND {behind}{i}" + (f" AND _at.{f.name} IS NOT NULL" if isinstance(f, Group) and f.size else "")
        return f"CASE WHEN {there} THEN {_value(f, f'_at.{f.name}')} ELSE {default_of(f)} END"

    return stopped.select(*[F.col(c) for c in own if c != out], F.struct(*[F.expr(final(i, f)).alias(f.name) for i, f in enumerate(SETTINGS)]).alias(out))


def _count(text: str, char: str) -> str:
    return f"(size(split({text}, '{char}', -1)) - 1)"


#: How many keys a layer has in which none is missing, without those of its lists' objects.
KEYS = len(LAYER) + sum(len(f.fields) for f in LAYER if isinstance(f, Group) and not f.many)


def _keys(layers: str) -> str:
    """How many keys a list of layers has in which none is missing."""
    many = [f"{len(f.fields)} * size(flatten({layers}.{f.name}))" for f in LAYER if isinstance(f, Group) and f.many]
    return f"({KEYS} * size({layers}) + {' + '.join(many)})"


def _wide(fields: tuple[Field | Group, ...]) -> str:
    """struct_type with double numbers."""
    return struct_type(fields).replace(NUMBER, "DOUBLE")


def _complete(fields: tuple[Field | Group, ...], at: str) -> str:
    """Whether all values of a struct with double numbers are there, finite, and of their enumerations; null counts as no."""
    numbers = [f"{at}.{f.name}" for f in fields if isinstance(f, Field) and f.kind == NUMBER]
    told = [f"abs({' + '.join(numbers)}) < double('infinity')"]
    for f in fields:
        x = f"{at}.{f.name}"
        if isinstance(f, Group):
            told.append(f"forall({x}, o -> coalesce({_complete(f.fields, 'o')}, false))" if f.many else _complete(f.fields, x))
        elif f.values:
            told.append(f"{x} IN ({', '.join(map(repr, f.values))})")
        elif f.kind != NUMBER:
            told.append(f"{x} IS NOT NULL")
    return " AND ".join(told)


def _layers(df: DataFrame, items: str, out: str, value: Callable[[str, str], str], there: Callable[[str, str], str], cast: bool = False) -> DataFrame:
    """df with the layers of items (objects with raw values) up to the first that can't be read, null where items is.

    cast: numbers are single floats already, null where the raw value was none.
    """
    own = df.columns
    groups = [f for f in LAYER if isinstance(f, Group)]
    # nested values are parsed once for each layer
    inner = ", ".join(f"'{g.name}', {_parsed(g, value('m', g.name))}" for g in groups)
    at = df.withColumn("_at", F.expr(f"transform({items}, m -> named_struct('raw', m, {inner}))"))
    fits = " AND ".join(f"(NOT {there('a.raw', g.name)} OR ({_readable(g, f'a.{g.name}')}))" for g in groups)
    readable = f"transform(_at, a -> a.raw IS NOT NULL AND coalesce({fits}, false))"
    upto = at.withColumn("_ok", F.expr(readable)).withColumn("_n", F.expr("CAST(coalesce(nullif(array_position(_ok, false), 0) - 1, size(_ok), 0) AS INT)"))

    def final(f: Field | Group) -> str:
        raw = value("a.raw", f.name)
        if isinstance(f, Group):
            return f"CASE WHEN a.{f.name} IS NULL THEN {default_of(f)} ELSE {_value(f, f'a.{f.name}')} END"
        if f.kind == TEXT and not f.values:
            return f"CASE WHEN {there('a.raw', f.name)} THEN coalesce({raw}, 'null') ELSE " + ("concat('mask-', i)" if f.name == "id" else default_of(f)) + " END"
        return f"coalesce({raw}, {default_of(f)})" if cast and f.kind == NUMBER else _or_default(f, raw)

    one = ", ".join(f"'{f.name}', {final(f)}" for f in LAYER)
    return upto.select(*own, F.expr(f"transform(slice(_at, 1, _n), (a, i) -> named_struct({one}))").alias(out))


def read_layers(df: DataFrame, text: str, out: str = "layers") -> DataFrame:
    """df with the list of mask layers that column text holds.

    Maps of raw values are right for all texts, but dear. So texts are read in the first of three ways that is exact for them:

    - All at once, if each layer has each field, once and of its own type: no value is missing from what was parsed, and the text
      has no more colons than these values have keys, so there are no further keys, and no key twice.
    - With structs of raw values, null where a key isn't there (nulls in the text are made texts, which read alike), if no key comes
      twice: what was parsed, written again, has as many colons as the text. Texts with escapes or single quotes aren't read so.
    - With maps of raw values.
    """
    own = [c for c in df.columns if c != out]
    typed = df.withColumn("_colons", F.expr(f"CASE WHEN startswith({text}, '[') THEN {_count(text, ':')} ELSE 0 END"))
    typed = typed.withColumn("_typed", F.expr(f"CASE WHEN _colons >= {KEYS} THEN from_json({text}, 'ARRAY<{_wide(LAYER)}>') END"))
    typed = typed.withColumn("_full", F.expr(f"coalesce(_colons = {_keys('_typed')} AND forall(_typed, l -> coalesce({_complete(LAYER, 'l')}, false)), false)"))

    plain = f"NOT _full AND _colons > 0 AND NOT contains({text}, '\\\\') AND NOT contains({text}, '\\'')"
    nulls = f"""CASE WHEN contains({text}, 'null') THEN regexp_replace({text}, '("\\\\s*:\\\\s*)null', '$1"null"') ELSE {text} END"""
    strings = typed.withColumn("_plain", F.expr(f"CASE WHEN {plain} THEN {nulls} END"))
    strings = strings.withColumn("_structs", F.expr(f"from_json(_plain, 'ARRAY<STRUCT<{', '.join(f'{f.name}: STRING' for f in LAYER)}>>')"))
    strings = strings.withColumn("_again", F.expr("to_json(_structs)"))
    # an element that is no object ends the list, unless it's a text that holds one; in such lists numbers beyond doubles read otherwise
    first = "element_at(from_json(_plain, 'ARRAY<STRING>'), CAST(array_position(transform(_structs, e -> e IS NULL), true) AS INT))"
    whole = f"CASE WHEN exists(_structs, e -> e IS NULL) THEN from_json({first}, '{OBJECT}') IS NULL AND NOT contains(_again, 'Infinity') AND NOT contains(_again, 'NaN') ELSE true END"
    # an object as an id or name is shown as it stands, with its nulls
    shown = "concat('|', array_join(_structs.id, '|'), '|', array_join(_structs.name, '|'))"
    strings = strings.withColumn("_once", F.expr(f"coalesce(_colons = {_count('_again', ':')} AND NOT contains({shown}, '|{{') AND NOT contains({shown}, '|[') AND {whole}, false)"))
    numbers = [f"ARRAY<STRUCT<{', '.join(f'{f.name}: ' + (kind if isinstance(f, Field) and f.kind == NUMBER else 'STRING') for f in LAYER)}>>" for kind in ("DOUBLE", "FLOAT")]
    structs = f"CASE WHEN _once THEN CAST(try_cast(_structs AS {numbers[0]}) AS {numbers[1]}) END"
    strings = strings.select(*own, *([] if text in own else [text]), "_full", "_once", "_typed", F.expr(structs).alias("_structs"))
    strings = _layers(strings, "_structs", "_plainly", lambda m, name: f"{m}.{name}", lambda m, name: f"{m}.{name} IS NOT NULL", cast=True).drop("_structs")

    rest = strings.withColumn("_rest", F.expr(f"CASE WHEN NOT _full AND NOT _once THEN {text} END"))
    maps = rest.withColumn("_whole", F.expr(f"from_json(_rest, '{OBJECTS}')")).withColumn("_list", F.expr(_objects("_whole", "_rest"))).drop("_whole")
    maps = _layers(maps, "_list", "_mapped", lambda m, name: f"element_at({m}, {name!r})", lambda m, name: f"map_contains_key({m}, {name!r})")
    kind = f"ARRAY<{struct_type(LAYER)}>"
    return maps.select(*[F.col(c) for c in own], F.expr(f"CASE WHEN _full THEN CAST(_typed AS {kind}) ELSE coalesce(_plainly, _mapped, CAST(array() AS {kind})) END").alias(out))


# ---- writing


def _written(f: Field | Group, x: str) -> str:
    """JSON text of column x: whole numbers without a fraction."""
    if isinstance(f, Group):
        if not f.many:
            return _object(f.fields, x)
        return f"concat('[', array_join(transform({x}, o -> {_object(f.fields, 'o')}), ','), ']')"
    if f.kind == NUMBERS:
        return f"CASE WHEN forall({x}, v -> {_number('v')} IS NOT NULL) THEN concat('[', array_join(transform({x}, v -> {_number('v')}), ','), ']') END"
    if f.kind == NUMBER:
        return _number(x)
    if f.kind == TEXT:
        return f"replace(regexp_extract(to_json(named_struct('v', {x})), '(?s):(.*)[}}]$', 1), '/', '\\\\/')"
    return f"CAST({x} AS STRING)"


def _number(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} = try_cast({d} AS BIGINT) THEN CAST(try_cast({d} AS BIGINT) AS STRING) WHEN isnan({d}) OR abs({d}) = double('infinity') THEN NULL ELSE CAST({d} AS STRING) END"


def _object(fields: tuple[Field | Group, ...], x: str) -> str:
    parts = ", ',', ".join(f"'\"{f.name}\":', {_written(f, f'{x}.{f.name}')}" for f in fields)
    return f"concat('{{', {parts}, '}}')"


def write_settings(settings: str) -> str:
    """SQL of the JSON text of a settings column; null if a number isn't finite."""
    return _object(SETTINGS, settings)


def write_layers(layers: str) -> str:
    """SQL of the JSON text of a list of layers; no layers give an empty text."""
    return f"CASE WHEN size({layers}) = 0 THEN '' ELSE concat('[', array_join(transform({layers}, l -> {_object(LAYER, 'l')}), ','), ']') END"


def written_layers(df: DataFrame, layers: str, out: str = "json") -> DataFrame:
    """df with the text that write_layers gives for a column of layers as read_layers has them.

    Lists are written at once, and fractions of whole numbers taken off behind. That isn't done if a value is missing (fewer colons),
    infinite, minus zero or written with an exponent, or if a text has a colon or what could be taken for a fraction: such lists are
    written field by field.
    """
    texts = ", ".join(f"array_join({layers}.{f.name}, '|')" for f in LAYER if isinstance(f, Field) and f.kind == TEXT)
    told = df.withColumn("_json", F.expr(f"to_json(CAST({layers} AS ARRAY<{_wide(LAYER)}>))")).withColumn("_texts", F.expr(f"concat_ws('|', {texts})"))
    # the names' own E's are known, so any other is an exponent's
    large = sum(x.name.count("E") for f in LAYER for x in (f, *(f.fields if isinstance(f, Group) and not f.many else ())))
    plain = f"NOT contains(_texts, ':') AND NOT contains(_texts, '.0') AND {_count('_json', ':')} = {_keys(layers)} AND {_count('_json', 'E')} = {large} * size({layers}) + {_count('_texts', 'E')}"
    plain += """ AND NOT contains(_json, 'Infinity"') AND NOT contains(_json, 'NaN"') AND (NOT contains(_json, '-0.0') OR NOT contains(_json, '-0.0,') AND NOT contains(_json, '-0.0}'))"""
    bare = F.expr("regexp_replace(_json, '\\\\.0([,}])', '$1')")
    told = told.withColumn("_bare", F.expr(f"size({layers}) > 0 AND {plain}"))
    own = [c for c in df.columns if c != out]
    return told.select(*own, F.when(F.col("_bare"), F.replace(bare, F.lit("/"), F.lit("\\/"))).otherwise(F.expr(write_layers(layers))).alias(out))
