"""Sidecar markup as tokens: one pass cuts a text into tags, their attributes and the text behind them.

A text is split at ``<``; a piece is split at double quotes, so every second part is an attribute's value and the first other part
with ``>`` ends the tag. Nothing else of a text is searched, and each tag's name is compared as a whole. Reading and changing work on
the same pieces; a piece that has no ``>`` is plain text. Values are read with their entities decoded and written as they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decoded(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pieces(xml: Column) -> Column:
    """Array of pieces, each an array of parts; the first piece is what stands before any tag."""
    return F.transform(F.split(xml, "<", -1), lambda p: F.split(p, '"', -1))


def joined(pieces_: Column) -> Column:
    return F.array_join(F.transform(pieces_, lambda p: F.array_join(p, '"')), "<")


def _end(p: Column) -> Column:
    """From 1: the part in which a piece's tag ends; 0 if it doesn't."""
    return F.array_position(F.transform(p, lambda x, i: (i % 2 == 0) & x.contains(">")), True)


def _element(p: Column) -> Column:
    """A piece's element name; closing ones begin with a slash."""
    return F.substring_index(F.substring_index(F.translate(p[0], "\n\r\t>", "    "), " ", 1), "/>", 1)


def _attribute(x: Column) -> Column:
    """The name in front of a value: the last word before the equals sign."""
    return F.when(F.endswith(F.rtrim(x), F.lit("=")), F.element_at(F.split(F.rtrim(F.translate(x, "=\n\r\t", "    ")), " "), -1))


def _behind(p: Column, end: Column) -> Column:
    """The text behind a piece's tag."""
    last = F.element_at(p, end.cast("int"))
    rest = F.slice(p, (end + 1).cast("int"), F.size(p))
    return F.array_join(F.concat(F.array(F.substr(last, F.instr(last, ">") + 1)), rest), '"')


def tokens(df: DataFrame, xml: str, out: str = "_tags", entities: bool = True) -> DataFrame:
    """df with the attributes and the elements that hold text only, each an array of (name, value) in the order of the text.

    entities: whether they are decoded in values.
    """
    own, read = df.columns, decoded if entities else (lambda c: c)
    cut = df.withColumn("_pieces", pieces(F.col(xml)))
    attribute = lambda p: F.filter(F.transform(p, lambda x, i: F.struct(F.when((i % 2 == 0) & (i + 1 < _end(p)), _attribute(x)).alias("name"), read(F.get(p, i + 1)).alias("value"))), lambda t: t["name"].isNotNull())
    closes = lambda p, i: F.coalesce(F.startswith(F.array_join(F.get(F.col("_pieces"), i + 1), '"'), F.concat(F.lit("/"), _element(p), F.lit(">"))), F.lit(False))
    element = lambda p, i: F.when((_end(p) > 0) & closes(p, i), F.struct(_element(p).alias("name"), read(_behind(p, _end(p))).alias("value")))
    return cut.select(*own, F.struct(F.flatten(F.transform("_pieces", attribute)).alias("attributes"), F.filter(F.transform("_pieces", element), lambda t: t.isNotNull()).alias("elements")).alias(out))


def first(tags: str, kind: str, *names: str, filled: bool = False) -> Column:
    """The first value of an attribute or element with one of these names; filled: only of those that aren't empty."""
    wanted = lambda t: t["name"].isin(*names) & ((t["value"] != "") if filled else F.lit(True))
    return F.get(F.filter(F.col(f"{tags}.{kind}"), wanted), 0)["value"]


def value(tags: str, name: str) -> Column:
    """A tag's value: its attribute form, else its element form; null if there is neither."""
    return F.coalesce(first(tags, "attributes", name), first(tags, "elements", name))


def plain_number(c: Column) -> Column:
    """A decimal number without exponent that ends with a digit, else null."""
    signs = F.translate(c, "0123456789", "")
    return F.when((F.replace(F.ltrim(signs), F.lit(".")).isin("", "+", "-")) & F.right(c, F.lit(1)).between("0", "9"), c.try_cast("double"))


def changed(xml: Column, tags: dict[str, Column]) -> Column:
    """K7: each tag's value put where the tag stands, as attributes, else as elements, else into the first description's opening tag."""
    at = pieces(xml)
    for name, new in tags.items():
        at = _changed(at, name, new)
    return joined(at)


def _changed(at: Column, name: str, new: Column) -> Column:
    is_value = lambda p, i: (i % 2 == 1) & (i < _end(p)) & (_attribute(F.get(p, i - 1)) == name)
    has = lambda p: F.exists(F.transform(p, lambda x, i: F.coalesce(is_value(p, i), F.lit(False))), lambda b: b)
    as_attribute = F.transform(at, lambda p: F.transform(p, lambda x, i: F.when(is_value(p, i), new).otherwise(x)))
    closing = F.lit(f"/{name}>")
    holds = lambda p, i: (_end(p) == 1) & (_element(p) == name) & F.startswith(F.array_join(F.get(at, i + 1), '"'), closing)
    tag = lambda p: F.array(F.concat(F.substring_index(p[0], ">", 1), F.lit(">"), new))
    as_element = F.transform(at, lambda p, i: F.when(F.coalesce(holds(p, i), F.lit(False)), tag(p)).otherwise(p))
    opening = F.array_position(F.transform(at, lambda p: (_element(p) == "rdf:Description") & (_end(p) > 0)), True)
    inserted = F.transform(at, lambda p, i: F.when(i + 1 == opening, _with(p, name, new)).otherwise(p))
    found = F.exists(F.transform(at, lambda p, i: F.coalesce(holds(p, i), F.lit(False))), lambda b: b)
    return F.when(F.exists(at, has), as_attribute).when(found, as_element).otherwise(inserted)


def _with(p: Column, name: str, new: Column) -> Column:
    """A piece's parts with one more attribute before its tag ends; the white space and the slash there stay behind it."""
    end = _end(p).cast("int")
    last = F.element_at(p, end)
    before = F.substring_index(last, ">", 1)
    slash = F.when(F.endswith(F.rtrim(before), F.lit("/")), F.substr(F.rtrim(before), F.lit(1), F.length(F.rtrim(before)) - 1)).otherwise(before)
    kept = F.regexp_replace(slash, r"\s+$", "")
    suffix = F.substr(last, F.length(kept) + 1)
    return F.concat(F.slice(p, F.lit(1), end - 1), F.array(F.concat(kept, F.lit(f"\n   {name}=")), new, suffix), F.slice(p, end + 1, F.size(p)))
