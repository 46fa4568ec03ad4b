"""Attribute-value rows as a wide table with typed columns (problem 5).

The entity-by-attribute grid is completed from the entities and the fixed list of attributes; values are joined to it
from the left; each entity's values are collected as an array sorted by attribute position; fixed indices of the array
are projected to columns by try casts of their types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.text import param_name, squeeze
from pagelathe.functions.values import CELLS, SQL_TYPES
from pagelathe.operators.history import dated_versions
from pagelathe.session import written


def attributes(params: DataFrame) -> list[tuple[str, str]]:
    """Column and type by position. The parameter table is configuration of fixed size; of two types of a column the first in order counts."""
    rows = params.where(F.col("column_name").isNotNull() & F.col("column_type").isin(list(CELLS))).groupBy("column_name").agg(F.min("column_type").alias("t")).collect()
    return sorted((r.column_name, r.t) for r in rows)


def entity_values(history: DataFrame, params: DataFrame, columns: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Entities (``title``), and their filled values (``title, pos, cell``): the last entry for a column that states a value.

    The row of each title that counts is chosen once and written, reduced to the entries that feed a column.
    """
    latest = F.max_by("structured_part", F.struct("at", "loaded_at", "rev_id", "structured_part")).alias("parts")
    current = dated_versions(history).groupBy("title").agg(latest)
    position = {c: i for i, (c, _) in enumerate(columns)}
    names = {r.name: position[r.column_name] for r in params.where("name is not null").select("name", "column_name").distinct().orderBy("name", "column_name").collect() if r.column_name in position}
    if not names:
        return current.select("title"), current.select("title", F.lit(0).alias("pos"), F.lit("").alias("cell")).limit(0)
    lookup = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    entry = F.transform("parts", lambda e, i: F.struct(i.alias("i"), F.element_at(lookup, param_name(e["name"])).alias("pos"), squeeze(e["text"]).alias("t")))
    chosen = written(current.select("title", F.filter(entry, lambda e: e["pos"].isNotNull() & (e["t"] != "")).alias("entries")), "current")
    entries = chosen.select("title", F.explode("entries").alias("e")).select("title", "e.*")
    kinds = F.array([F.lit(t) for _, t in columns])

    def cell(e: Column) -> Column:
        """The cell of one entry. As a lambda it is evaluated as it stands: compiled, the five parsers exceed a method's size."""
        out = F.lit(None).cast("string")
        for kind, parse in CELLS.items():
            out = F.when(F.get(kinds, e["pos"]) == kind, parse(e["t"])).otherwise(out)
        return out

    parsed = F.get(F.transform(F.array(F.struct("pos", "t")), cell), F.lit(0))
    cells = entries.select("title", "pos", "i", parsed.alias("cell")).where("cell is not null")
    return chosen.select("title"), cells.groupBy("title", "pos").agg(F.max_by("cell", "i").alias("cell"))


def value_arrays(history: DataFrame, params: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """``title, a``: the completed grid, each entity's (pos, cell) sorted by attribute position."""
    entities, values = entity_values(history, params, columns)
    grid = entities.select("title", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("pos"))
    return grid.join(values, ["title", "pos"], "left").groupBy("title").agg(F.sort_array(F.collect_list(F.struct("pos", "cell"))).alias("a"))


def wide_table(history: DataFrame, params: DataFrame) -> DataFrame:
    """One row per title with the typed columns of ``params``, null where nothing is stated.

    history: as in ``history.attribute_periods``; a title whose latest counting part is empty has a row of nulls, an
    empty table gives none. params: ``name`` (by the name rule), ``column_name``, ``column_type``. Names not listed,
    null names and null texts fill nothing; a whole number beyond 64 bits fills nothing. A decimal with more digits
    than its type has is rounded to 16 places, or null beyond 22 whole digits; ``found_cells`` has all digits.
    """
    columns = attributes(params)
    if not columns:
        return entity_values(history, params, columns)[0]
    arrays = value_arrays(history, params, columns)
    return arrays.select("title", *[F.get("a", F.lit(i))["cell"].try_cast(SQL_TYPES[kind]).alias(name) for i, (name, kind) in enumerate(columns)])


def found_cells(history: DataFrame, params: DataFrame) -> DataFrame:
    """``title, column_name, cell``: the filled cells of the wide table as text, decimals with all their digits."""
    columns = attributes(params)
    if not columns:
        return entity_values(history, params, columns)[1].select("title", F.lit("").alias("column_name"), "cell")
    texts = []
    for i, (name, kind) in enumerate(columns):
        text = F.get("a", F.lit(i))["cell"]
        typed = text.try_cast("double" if kind == "decimal" else SQL_TYPES[kind])
        texts.append(F.struct(F.lit(name).alias("column_name"), F.when(typed.isNotNull(), text).alias("cell")))
    rows = value_arrays(history, params, columns).select("title", F.explode(F.array(*texts)).alias("x"))
    return rows.select("title", "x.column_name", "x.cell").where("cell is not null")
