"""Counters: group, name, value.

Parsers yield ``ARRAY<STRUCT<counter_group, counter_name, value>>``; tables hold
``MAP<group, MAP<name, value>>`` built with :func:`nested`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CELL = "struct<counter_group:string,counter_name:string,value:bigint>"
CELLS = f"array<{CELL}>"
NESTED = "map<string,map<string,bigint>>"

# Layout of the compact text form {(group)(label)[(name)(label)(value)]...}...
# Possessive, so a long text is read once and never backtracked into.
_TOKEN = r"\(([^()\\]*+(?:\\.[^()\\]*+)*+)\)"
_BLOCK = r"\[[^\[\]\\]*+(?:\\.[^\[\]\\]*+)*+\]"
GROUP_PATTERN = r"\{" + _TOKEN + _TOKEN + r"((?:" + _BLOCK + r")*+)\}"
COUNTER_PATTERN = r"\[" + _TOKEN + _TOKEN + r"\((-?[0-9]+)\)\]"

JSON_COUNTERS = (
    "struct<name:string,groups:array<struct<name:string,"
    "counts:array<struct<name:string,value:bigint>>>>>"
)

# Which counter kind each field or record name stands for.
TEXT_KINDS = {"counters": "total", "map_counters": "map", "reduce_counters": "reduce"}
JSON_KINDS = {
    "COUNTERS": "total",
    "TOTAL_COUNTERS": "total",
    "TASK_COUNTERS": "total",
    "TASK_ATTEMPT_COUNTERS": "total",
    "MAP_COUNTERS": "map",
    "REDUCE_COUNTERS": "reduce",
}


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"\\(.)", "$1")).otherwise(text)


def from_text(compact: Column) -> Column:
    """Cells of the compact text form. Text that is not well formed yields no cells."""
    groups = F.regexp_extract_all(compact, F.lit(GROUP_PATTERN), F.lit(0))
    # the well-formed groups must make up the whole text
    well_formed = F.array_join(groups, "") == F.trim(compact)

    def cells(group: Column) -> Column:
        name = unescape(F.regexp_extract(group, GROUP_PATTERN, 1))
        body = F.regexp_extract(group, GROUP_PATTERN, 3)
        names = F.regexp_extract_all(body, F.lit(COUNTER_PATTERN), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(COUNTER_PATTERN), F.lit(3))
        return F.zip_with(
            names,
            values,
            lambda n, v: F.struct(
                name.alias("counter_group"), unescape(n).alias("counter_name"),
                v.try_cast("bigint").alias("value"),
            ),
        )

    empty = F.array().cast(CELLS)
    return F.when(well_formed, F.flatten(F.transform(groups, cells))).otherwise(empty)


def parse_json(text: Column) -> Column:
    return F.from_json(text, JSON_COUNTERS)


def json_kind(parsed: Column) -> Column:
    """Counter kind of a parsed JSON counter record; null when its name is unknown."""
    kinds = F.create_map(*[F.lit(x) for pair in JSON_KINDS.items() for x in pair])
    return F.try_element_at(kinds, parsed["name"])


def from_json(parsed: Column) -> Column:
    def cells(group: Column) -> Column:
        return F.transform(
            group["counts"],
            lambda c: F.struct(
                group["name"].alias("counter_group"), c["name"].alias("counter_name"),
                c["value"].alias("value"),
            ),
        )

    return F.coalesce(F.flatten(F.transform(parsed["groups"], cells)), F.array().cast(CELLS))


def nested(cells: Column) -> Column:
    """Cells to group -> name -> value."""
    groups = F.array_distinct(F.transform(cells, lambda c: c["counter_group"]))

    def entry(group: Column) -> Column:
        own = F.filter(cells, lambda c: c["counter_group"] == group)
        inner = F.map_from_entries(F.transform(own, lambda c: F.struct(c["counter_name"], c["value"])))
        return F.struct(group, inner)

    return F.map_from_entries(F.transform(groups, entry))


def value(counters: Column, group: str | Column, name: str | Column) -> Column:
    """One counter of a nested map, 0 when it is missing."""
    g = group if isinstance(group, Column) else F.lit(group)
    n = name if isinstance(name, Column) else F.lit(name)
    return F.coalesce(F.try_element_at(F.try_element_at(counters, g), n), F.lit(0).cast("bigint"))


def from_qualifier(qualifier: Column, value_: Column) -> Column:
    """One stored cell ``group!name`` to its parts; any other number of parts is an error."""
    parts = F.split(qualifier, "!")
    cell = F.struct(
        F.try_element_at(parts, F.lit(1)).alias("counter_group"),
        F.try_element_at(parts, F.lit(2)).alias("counter_name"),
        value_.cast("bigint").alias("value"),
    )
    bad = F.concat(F.lit("Malformed counter column qualifier: "), qualifier)
    return F.when(F.size(parts) == 2, cell).otherwise(F.raise_error(bad).cast(CELL))
