"""Typed equality of JSON: a filter object's members must all be in the metadata with equal type and value."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_or_empty(text: Column) -> Column:
    """The text if it is JSON, else an empty object."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit("{}"))


def member(document: Column, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(F.try_parse_json(document), f"$['{quoted}']", "variant")


def equals(value: Column, wanted: Any) -> Column:
    """1, 1.0 and '1' differ; the order of an object's keys doesn't matter. A missing member equals nothing."""
    other = F.parse_json(F.lit(json.dumps(wanted)))
    kind = lambda v: F.schema_of_variant(v)
    return F.coalesce((F.to_json(value) == F.to_json(other)) & (kind(value) == kind(other)), F.lit(False))


def matches(metadata: Column, wanted: Any) -> Column:
    """Whether metadata has all members of wanted; a filter that is no object filters nothing."""
    if not isinstance(wanted, dict):
        return F.lit(True)
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & equals(member(metadata, key), value)
    return out


def flattened(metadata: Column) -> Column:
    """A map of strings: members without the quotes of strings."""
    return F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
