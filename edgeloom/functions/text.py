"""Text rules of the lineage model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom import constants as C

# Everything up to and including the space counts as padding; Spark's bare trim drops spaces only.
_PADDING = "".join(chr(i) for i in range(33))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_PADDING))


def trim_lower(c: Column) -> Column:
    return F.lower(trimmed(c))


def is_blank(c: Column) -> Column:
    """Null, or nothing left after trimming."""
    return c.isNull() | (trimmed(c) == "")


def is_white(c: Column) -> Column:
    """Null, or Unicode white space only. Unlike `is_blank` this counts wide spaces and not control codes."""
    return c.isNull() | c.rlike(r"^\p{javaWhitespace}*\z")


def _without_trailing_dots(c: Column) -> Column:
    return F.rtrim(c, F.lit("."))


def short_name(c: Column) -> Column:
    """Last dotted part; trailing dots do not open a part."""
    return F.substring_index(_without_trailing_dots(c), ".", -1)


def is_dots_only(c: Column) -> Column:
    return (F.length(c) > 0) & (_without_trailing_dots(c) == "")


def schema_of_name(c: Column) -> Column:
    """Dotted prefix of a table name, or the default schema. `.a` has an empty prefix, which is kept."""
    name = _without_trailing_dots(trimmed(c))
    prefix_length = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(F.contains(name, F.lit(".")), F.substring(name, F.lit(1), prefix_length)).otherwise(
        C.UNKNOWN_SCHEMA
    )


def full_name(schema: Column, name: Column) -> Column:
    return F.when(is_white(schema), name).otherwise(F.concat(schema, F.lit("."), name))


def line_number(text: Column) -> Column:
    """Line number from text such as `12` or `L12`; null when it is neither."""
    digits = F.regexp_extract(trimmed(text), r"^[lL]?([+-]?[0-9]+)\z", 1)
    return digits.try_cast("int")


def contains_any_case(c: Column, q: Column) -> Column:
    """Plain containment, so `_` and `%` stand for themselves."""
    return F.contains(F.lower(c), F.lower(q))


def dedupe_part(c: Column) -> Column:
    """A key part in which null and empty text are the same."""
    return F.coalesce(c.cast("string"), F.lit(""))


def mask_secret(c: Column) -> Column:
    return F.when(c.isNull() | (F.length(c) < 6), C.SECRET_MASK).otherwise(
        F.concat(F.substring(c, 1, 3), F.lit(C.SECRET_MASK), F.right(c, F.lit(3)))
    )


# Text to enum. Roles and edge types ignore case; file types and states do not.


def asset_role(c: Column) -> Column:
    role = F.upper(c)
    return F.when(role.isin(C.SOURCE, C.TARGET), role).otherwise(C.INTERMEDIATE)


def edge_type(c: Column) -> Column:
    return F.when(F.upper(c).isin("COLUMN_LINEAGE", "COLUMN_EDGE"), C.COLUMN_EDGE).otherwise(C.TABLE_EDGE)


def file_type(c: Column) -> Column:
    return F.when(c == "JINJA2", "JINJA2").otherwise("SQL")


def file_status(c: Column) -> Column:
    return F.when(c == "success", C.SUCCESS).when(c == "failed", C.FAILED).otherwise(C.SKIPPED)
