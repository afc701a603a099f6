"""JSON expressions: repair, validation, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    """Without Markdown code fences."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def repaired(text: Column) -> Column:
    """A model's answer as VARIANT: as it is, else unfenced, else its outermost braces; null if none parses."""
    bare = unfenced(text)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def repaired_unfenced_first(text: Column) -> Column:
    bare = unfenced(text)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def valid_response(v: Column) -> Column:
    """Has a mode, and a plan if the mode is to create."""
    mode = F.try_variant_get(v, "$.mode", "string")
    return F.coalesce(mode.isNotNull() & ((mode != "create_workflow") | F.try_variant_get(v, "$.workflowPlan", "variant").isNotNull()), F.lit(False))
