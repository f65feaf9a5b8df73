"""JSON texts merged at every depth, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import let

DEPTH = 8


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def merged_variant(base: Column, extra: Column, depth: int = DEPTH) -> Column:
    """Objects merge key by key; anything else, arrays and nulls too, is replaced by the right side. Objects on both sides below
    ``depth`` levels end the job with an error, as they would have to merge further."""
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")

    def one(a: Column, b: Column) -> Column:
        if depth <= 1:
            both = F.raise_error(F.lit("JSON objects are nested too deep to be merged")).cast("variant")
        else:
            both = merged_variant(a, b, depth - 1)
        return F.when(b.isNull(), a).when(a.isNull(), b).when(_is_object(a) & _is_object(b), both).otherwise(b)

    return F.to_variant_object(F.map_zip_with(fields(base), fields(extra), lambda _, a, b: one(a, b)))


def merged(base: Column, extra: Column, depth: int = DEPTH) -> Column:
    """Two JSON texts as one. Null: the other side."""
    def both(a: Column, b: Column) -> Column:
        return F.to_json(F.when(_is_object(a) & _is_object(b), merged_variant(a, b, depth)).otherwise(b))

    return F.when(base.isNull(), extra).when(extra.isNull(), base).otherwise(let(F.parse_json(base), lambda a: let(F.parse_json(extra), lambda b: both(a, b))))
