"""Auxiliary tags: a map from a two-letter name to its type and its value as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "map<string,struct<type:string,value:string>>"


def empty() -> Column:
    return F.create_map().cast(TAGS)


def entry(name: str, kind: str | Column, value: Column) -> Column:
    """A key and its entry; the value is null where the row has no such tag."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(name).alias("key"), F.struct(kind.alias("type"), value.cast("string").alias("value")).alias("value"))


def tag(name: str, column: str = "tags") -> Column:
    return F.get(F.map_values(F.map_filter(column, lambda k, _: k == name)), F.lit(0))["value"]


def from_fields(fields: Column) -> Column:
    """The map of a text line's optional fields NAME:TYPE:VALUE; the first of one name counts."""
    whole = F.filter(fields, lambda x: x.rlike("^..:.:"))
    names = F.transform(whole, lambda x: F.substring(x, 1, 2))
    first = F.filter(whole, lambda x, i: F.array_position(names, F.substring(x, 1, 2)) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value")).alias("value"))))


def to_fields(tags: Column) -> Column:
    """The optional fields of a line, in the order of the map."""
    return F.transform(F.map_entries(F.coalesce(tags, empty())), lambda x: F.concat_ws(":", x["key"], x["value"]["type"], x["value"]["value"]))


def complete(rows: DataFrame) -> Column:
    """The tags of rows with what their own columns rg and rx say in place of RG and RX."""
    held = F.coalesce("tags", empty()) if "tags" in rows.columns else empty()
    own = [c for c in ("rg", "rx") if c in rows.columns]
    rest = F.map_filter(held, lambda k, _: ~k.isin(*[c.upper() for c in own])) if own else held
    made = F.filter(F.array(*[entry(c.upper(), "Z", F.col(c)) for c in own]), lambda x: x["value"]["value"].isNotNull()) if own else None
    return F.map_concat(rest, F.map_from_entries(made)) if own else rest


def with_tags(rows: DataFrame, changed: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with tags set from name -> (type, value); a null value removes the tag."""
    made = F.map_from_entries(F.filter(F.array(*[entry(n, t, v) for n, (t, v) in changed.items()]), lambda x: x["value"]["value"].isNotNull()))
    if "tags" not in rows.columns:
        return rows.withColumn("tags", made.cast(TAGS))
    return rows.withColumn("tags", F.map_concat(F.map_filter(F.coalesce("tags", empty()), lambda k, _: ~k.isin(*changed)), made))
