"""Deeply nested records to flat, linked tables (problem 1).

Every target table is described by a :class:`Child`. One projection per source attaches the ancestor keys and the
array positions inside nested ``transform`` calls, ``flatten`` joins the arrays of the targets that share a schema,
and a single ``inline`` per target table emits the rows. There is no join and no Python; the only shuffle is the
one that removes parents delivered twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """A child table: ``path`` leads from the root to the array, through structs and further arrays.

    ``path`` is a sequence of steps; each step is the dotted path of an array inside the element reached so far. A
    path of two steps describes a grandchild, which carries the positions of both levels.
    """

    name: str
    path: tuple[str, ...]
    fields: tuple[str, ...] = field(default=())


def _get(base: Column | None, dotted: str) -> Column:
    first, *rest = dotted.split(".")
    column = F.col(f"`{first}`") if base is None else base.getField(first)
    for part in rest:
        column = column.getField(part)
    return column


def child_structs(key: Column, child: Child, key_name: str = "parent_id", with_table: bool = False) -> Column:
    """ARRAY of STRUCT(key, pos[, pos_1 ...], fields...) of one parent row; null and empty arrays give an empty array.

    Null elements give no row, but they are counted by the positions.
    """

    def level(base: Column | None, steps: Sequence[str], positions: list[Column]) -> Column:
        array = _get(base, steps[0])

        def emit(element: Column, position: Column) -> Column:
            places = [*positions, position]
            if len(steps) > 1:
                return level(element, steps[1:], places)
            head = [F.lit(child.name).alias("child_table")] if with_table else []
            place_names = [f"pos_{i}" for i in range(len(places) - 1)] + ["pos"]
            columns = [*head, key.alias(key_name), *(p.alias(n) for p, n in zip(places, place_names))]
            columns += [_get(element, f).alias(f.replace(".", "_")) for f in child.fields]
            return F.when(element.isNotNull(), F.struct(*columns))

        mapped = F.transform(array, emit)
        if len(steps) > 1:
            return F.flatten(F.filter(mapped, lambda x: x.isNotNull()))
        return F.filter(mapped, lambda x: x.isNotNull())

    return level(None, child.path, [])


def flatten_children(df: DataFrame, key: str, child: Child, key_name: str = "parent_id") -> DataFrame:
    """One child table with one row per non-null element of each distinct parent.

    A parent delivered again with the same content counts once: the projected arrays are compared as a whole,
    before they are expanded, so the shuffle moves one row per parent and is combined on the map side. Parents
    whose key is null keep their children, with a null key. An empty table gives an empty table with the same
    schema; other columns of ``df``, whatever their names, are never read.
    """
    links = df.select(F.coalesce(child_structs(F.col(f"`{key}`"), child, key_name), F.array()).alias("links"))
    return links.distinct().select(F.inline("links"))


def flatten_positions(sources: Sequence[tuple[DataFrame, str, Sequence[Child]]]) -> DataFrame:
    """(child_table, parent_id, pos) of all children of all ``sources``, each a (table, key, children) triple."""
    out: DataFrame | None = None
    for df, key, children in sources:
        bare = [Child(c.name, c.path) for c in children]
        arrays = [F.coalesce(child_structs(F.col(f"`{key}`").cast("string"), c, with_table=True), F.array()) for c in bare]
        rows = df.select(F.flatten(F.array(*arrays)).alias("links")).distinct().select(F.inline("links"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources")
    return out


CHECKS = Child("checks", ("checks",), ("name", "passed", "detail"))
MEASUREMENTS = Child("detected_measurements", ("output_summary.detected_measurements",), ("name", "value", "unit", "source"))
VARIABLES = Child("variables", ("variables",), ("name", "description", "unit", "required"))
