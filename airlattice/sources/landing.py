"""Landing of upstream payloads (S4, S5) and nested-record flattening.

Payloads are read with ``spark.read.json`` (or arrive as nested columns) and are
flattened by walking the *schema* on the driver -- the data itself never leaves the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlattice.operators import clean


def _array_sizes(col: Column, dtype: T.DataType, path: tuple, exclude: set) -> dict[tuple, Column]:
    """Per array path, the largest number of elements it has in a row (null: none)."""
    if isinstance(dtype, T.StructType):
        out = {}
        for f in dtype.fields:
            if f.name not in exclude:
                out |= _array_sizes(col.getField(f.name), f.dataType, (*path, f.name), exclude)
        return out
    if isinstance(dtype, T.ArrayType):
        out = {path: F.size(col)}
        inner = _array_sizes(F.element_at(col, 1), dtype.elementType, (*path, "[]"), exclude)
        for p in inner:
            out[p] = F.array_max(F.transform(col, _size_at(dtype.elementType, (*path, "[]"), exclude, p)))
        return out
    return {}


def _size_at(dtype: T.DataType, path: tuple, exclude: set, wanted: tuple):
    """Function of one element: the size of the array at ``wanted`` inside it."""
    return lambda x: _array_sizes(x, dtype, path, exclude)[wanted]


def longest_arrays(df: DataFrame, exclude=(), keep=()) -> dict[tuple, int]:
    """The longest length of every array path over all rows: one aggregate, one row."""
    sizes = {}
    for f in df.schema.fields:
        if f.name not in keep and f.name not in exclude:
            sizes |= _array_sizes(F.col(f"`{f.name}`"), f.dataType, (f.name,), set(exclude))
    if not sizes:
        return {}
    row = df.agg(*[F.max(c).alias(f"c{i}") for i, c in enumerate(sizes.values())]).first()
    return {p: max(row[i] or 0, 0) for i, p in enumerate(sizes)}


def _flatten_col(col: Column, dtype: T.DataType, name: str, exclude: set,
                 longest: dict[tuple, int], path: tuple, guard: Column | None) -> list[Column]:
    """Columns for one nested value: struct paths joined by '_', arrays of one element
    collapse without an index, longer arrays are indexed up to the longest there is."""
    def out(c: Column) -> Column:
        return (F.when(guard, c) if guard is not None else c)

    if isinstance(dtype, T.StructType):
        cols = []
        for f in dtype.fields:
            if f.name in exclude:
                continue
            cols += _flatten_col(col.getField(f.name), f.dataType,
                                 f"{name}_{f.name}" if name else f.name, exclude, longest, (*path, f.name), guard)
        return cols
    if isinstance(dtype, T.ArrayType):
        single = F.size(col) == 1
        multi = F.size(col) > 1
        g1 = single if guard is None else (guard & single)
        gm = multi if guard is None else (guard & multi)
        n, inner = longest.get(path, 0), (*path, "[]")
        cols = _flatten_col(F.get(col, F.lit(0)), dtype.elementType, name, exclude, longest, inner, g1)
        for i in range(n if n > 1 else 0):
            cols += _flatten_col(F.get(col, F.lit(i)), dtype.elementType, f"{name}_{i}", exclude, longest, inner, gm)
        return cols
    return [out(col).alias(name)]


def flatten(df: DataFrame, exclude=(), keep: list[str] | None = None, drop_empty: bool = True) -> DataFrame:
    """Flatten every nested column of ``df``.

    ``exclude`` names are skipped at every depth; null leaves are kept. A Spark schema is
    fixed, so array positions are declared up to the longest array of the data (one
    aggregate finds the lengths): no element is left out. With ``drop_empty`` columns
    that no row fills are removed, as a record-by-record flattening would never have
    produced them.
    """
    keep = keep or []
    exclude = set(exclude)
    longest = longest_arrays(df, exclude, keep)
    cols = [F.col(k) for k in keep]
    for f in df.schema.fields:
        if f.name in keep or f.name in exclude:
            continue
        cols += _flatten_col(F.col(f"`{f.name}`"), f.dataType, f.name, exclude, longest, (f.name,), None)
    flat = df.select(*cols)
    # Same name produced twice (e.g. a collapsed array and a sibling) keeps the first.
    seen, uniq = set(), []
    for c in flat.columns:
        if c not in seen:
            seen.add(c)
            uniq.append(c)
    flat = flat.select(*[F.col(f"`{c}`") for c in uniq]) if len(uniq) != len(flat.columns) else flat
    return clean.drop_null_columns(flat, keep=keep) if drop_empty else flat


def land_pollution(payload: DataFrame, keys: list[str], list_col: str = "list") -> DataFrame:
    """One row per ``list[]`` element; ``dt`` -> ``time``, ``main`` and ``components``
    merged into one flat row."""
    rows = payload.select(*keys, F.explode(list_col).alias("_r"))
    return rows.select(*keys, F.col("_r.dt").alias("time"), "_r.main.*", "_r.components.*")


def land_weather(payload: DataFrame, keys: list[str], hourly_col: str = "hourly") -> DataFrame:
    """One row per ``hourly[]`` element, flattened, renamed and narrowed."""
    rows = payload.select(*keys, F.explode(hourly_col).alias("_h"))
    flat = flatten(rows.select(*keys, "_h.*"), keep=keys)
    return clean.drop_unneeded(clean.rename(flat))


def read_payloads(spark, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read landed JSON payload files (one document per file or per line)."""
    reader = spark.read.option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
