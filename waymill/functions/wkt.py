"""Well-known text as column expressions (all JVM-side, inside whole-stage code generation where Spark allows).

Accepted spellings: any case, an ``SRID=n;`` prefix, blanks anywhere, ``Z``/``M``/``ZM`` marks with further
ordinates (ignored), plain and exponent numbers. A null, blank, EMPTY, truncated or non-numeric text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymill.functions.expressions import let

#: The forms of the accepted texts. Group 1 is the coordinate text.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POSITION = rf"\s*{NUMBER}(?:\s+{NUMBER}){{1,3}}\s*"
PREFIX = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*"
#: Loop-free: long lines would overflow the stack of a nested repetition in java.util.regex.
LINE = PREFIX + r"LINESTRING\s*(?:ZM|Z|M)?\s*\(([^()]*)\)\s*$"
POINT = PREFIX + rf"POINT\s*(?:ZM|Z|M)?\s*\(({POSITION})\)\s*$"


def _positions(text: Column) -> Column:
    """Comma-separated positions to x/y structs; a coordinate that is no number is null."""
    words = F.transform(F.split(text, ","), lambda p: F.split(F.btrim(p, F.lit(" \t\r\n")), r"\s+"))
    ordinate = lambda w, i: F.get(w, i).try_cast("double")
    return F.transform(words, lambda w: F.struct(ordinate(w, 0).alias("x"), ordinate(w, 1).alias("y")))


def _finite(c: Column) -> Column:
    """Whether both coordinates are numbers (a comparison with null is null, which no test takes for true)."""
    return (F.abs(c.x) < float("inf")) & (F.abs(c.y) < float("inf"))


def line_coords(text: Column) -> Column:
    """LINESTRING text to ``array<struct<x: double, y: double>>``; null if any position can't be read."""
    return let(_positions(F.regexp_extract(text, LINE, 1)), lambda c: F.when((F.size(c) >= 2) & F.forall(c, lambda v: F.coalesce(_finite(v), F.lit(False))), c))


def point_xy(text: Column) -> Column:
    """POINT text to ``struct<x: double, y: double>``; null if it can't be read."""
    return let(F.get(_positions(F.regexp_extract(text, POINT, 1)), 0), lambda p: F.when(_finite(p), p))


def centimetres(metres: Column) -> Column:
    """Whole centimetres, rounded half up."""
    return F.floor(metres * 100.0 + 0.5).cast("bigint")


def line_text(coords: Column) -> Column:
    """LINESTRING text of an array of x/y structs; ``LINESTRING EMPTY`` for an empty array."""
    body = F.array_join(F.transform(coords, lambda c: F.concat_ws(" ", c.x.cast("string"), c.y.cast("string"))), ", ")
    return F.when(F.size(coords) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.lit("LINESTRING ("), body, F.lit(")")))


def polygon_rings(text: Column) -> Column:
    """POLYGON or MULTIPOLYGON text to ``array<array<struct<x, y>>>``: all rings of all parts; null if unreadable.

    Even-odd counting over all rings gives the right inside test for parts with holes, since the parts of a valid
    multipolygon don't overlap.
    """
    inner = F.regexp_extract(text, PREFIX + r"(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*\(([-+0-9.eE,()\s]*)\)\s*$", 1)
    rings = F.regexp_extract_all(inner, F.lit(r"\(([^()]+)\)"), 1)
    readable = lambda parsed: (F.size(parsed) > 0) & F.forall(parsed, lambda r: F.forall(r, lambda c: F.coalesce(_finite(c), F.lit(False))))
    return let(F.transform(rings, _positions), lambda parsed: F.when(readable(parsed), parsed))
