"""JSON inside free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FENCED = r"(?s)```(json)?\s*([\[{].*?[\]}])\s*```"


def json_block(text: Column) -> Column:
    """The fenced JSON block of a text, else the span from its first to its last bracket."""
    fenced = F.regexp_extract(text, FENCED, 2)
    span = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fenced != "", fenced).when(span != "", span)


def response_object(text: Column) -> Column:
    """The JSON object a response holds, as VARIANT; of a list the last element.

    Null for texts without JSON, unreadable JSON, and JSON that is not an object.
    """
    parsed = F.try_parse_json(json_block(text))
    listed = F.try_variant_get(parsed, "$", "array<variant>")
    last = F.get(listed, F.size(listed) - 1)
    chosen = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), last).otherwise(parsed)
    return F.when(F.schema_of_variant(chosen).startswith("OBJECT"), chosen)
