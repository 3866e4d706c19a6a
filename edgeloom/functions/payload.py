"""Access to the untyped event payload.

A JSON value is read in two forms. The *text form* holds it only if it is JSON text: a variant casts to binary from
text and from nothing else. The *any form* holds every value spelt out. A value present in the any form alone is
therefore a number, a flag, an object or a list - nothing is coerced by accident. Both forms are single casts of a
whole object or list, done in native code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.text import line_number


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def in_binary(shape: str) -> str:
    return shape.replace(":string", ":binary").replace("<string>", "<binary>")


def text_as(v: Column, path: str, shape: str) -> Column:
    """The text form in a nested shape written with `string` leaves."""
    return any_as(v, path, in_binary(shape)).cast(shape)


def any_as(v: Column, path: str, shape: str) -> Column:
    return F.try_variant_get(v, path, shape)


def struct_of(names: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{n}:string" for n in names) + ">"


def text(v: Column, path: str = "$") -> Column:
    """The value if it is JSON text, else null."""
    return F.try_variant_get(v, path, "binary").cast("string")


def is_not_text(text_form: Column, any_form: Column) -> Column:
    """Present, not null and not text."""
    return text_form.isNull() & any_form.isNotNull()


def is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "struct<`_`:variant>").isNotNull()


def number_to_int(text_form: Column, any_form: Column) -> Column:
    """A JSON number cut to an int; anything else is null. Flags, objects and lists do not read as numbers."""
    return F.when(text_form.isNull(), any_form.try_cast("double").try_cast("int"))


def line_to_int(text_form: Column, any_form: Column) -> Column:
    """A line reference: a number, or text with an optional leading `L`."""
    return F.coalesce(line_number(text_form), number_to_int(text_form, any_form))


_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?\z"


def event_time(c: Column) -> Column:
    """Zone-less time with up to six fraction digits. The guard keeps out dates and zone suffixes."""
    return F.when(c.rlike(_TIME), c.try_cast("timestamp_ntz"))
