"""Flattening of JSON records whose keys differ from row to row (P3, U3, S4), in one scan.

``landing.flatten`` needs one schema for all rows and a pass over the data for the lengths of its
arrays. Here each record is a VARIANT that flattens itself into a map from flat name to value, by array
expressions in the JVM: no inferred schema, no sizing pass, no shuffle. The columns wanted are
named with their types and taken from the map, so records of other keys give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.operators import clean

DEPTH = 6      # levels of nesting that are taken apart; what lies deeper stays one value


def _entry(name: Column, value: Column) -> Column:
    return F.struct(name.alias("p"), value.alias("v"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression named inside a lambda runs for every element."""
    return F.transform(F.array(value), use)[0]


def _open(entry: Column, exclude: tuple) -> Column:
    """The entries one level below: fields joined by '_', a list of one item without an index, longer lists with it."""
    name, value = entry["p"], entry["v"]
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    if exclude:
        fields = F.filter(fields, lambda f: ~f["key"].isin(*exclude))
    fields = F.transform(fields, lambda f: _entry(F.when(name == "", f["key"]).otherwise(F.concat(name, F.lit("_"), f["key"])), f["value"]))
    items = _once(F.try_variant_get(value, "$", "array<variant>"), lambda xs: F.transform(xs, lambda x, i: _entry(
        F.when(F.size(xs) == 1, name).otherwise(F.concat_ws("_", F.when(name != "", name), i.cast("string"))), x)))
    return F.coalesce(fields, items, F.array(entry))


def flat_record(value: Column, exclude: list[str] | tuple = (), depth: int = DEPTH) -> Column:
    """Map from flat name to VARIANT of one record; null for a null record.

    ``exclude`` names are skipped at every depth and null leaves are kept. An empty object or
    list has no leaves. Where two paths give one name the first stays. Values nested deeper
    than ``depth`` levels stay objects or lists."""
    entries = F.array(_entry(F.lit(""), value))
    for _ in range(depth):
        entries = F.flatten(F.transform(entries, lambda e: _open(e, tuple(exclude))))
    first = _once(entries, lambda es: _once(F.transform(es, lambda e: e["p"]), lambda names: F.filter(
        es, lambda e, i: F.array_position(names, e["p"]) == i + 1)))
    return F.when(value.isNotNull(), F.map_from_entries(first))


def flatten_records(df: DataFrame, payload: str, wanted: dict[str, str], keep: list[str] = (),
                    exclude: list[str] | tuple = (), depth: int = DEPTH) -> DataFrame:
    """P3 over JSON text: ``keep`` and a column per wanted flat name, of its type.

    ``payload`` is a string column, or a VARIANT. Text that is no JSON gives nulls, as do names a
    record lacks and values that do not fit their type."""
    value = F.col(payload) if dict(df.dtypes)[payload] == "variant" else F.try_parse_json(payload)
    flat = df.select(*keep, flat_record(value, exclude, depth).alias("_flat"))
    return flat.select(*keep, *[F.try_variant_get(F.try_element_at("_flat", F.lit(n)), "$", t).alias(n) for n, t in wanted.items()])


def land_weather(df: DataFrame, payload: str, keys: list[str], wanted: dict[str, str], hourly: str = "hourly") -> DataFrame:
    """S4 over JSON text: one row per item of the ``hourly`` list, flattened, renamed and narrowed.

    ``wanted`` names the columns as the records flatten them, before they are renamed. A payload without the list gives no row."""
    hours = F.try_variant_get(F.try_parse_json(payload), f"$.{hourly}", "array<variant>")
    rows = df.select(*keys, F.explode(hours).alias("_hour"))
    return clean.drop_unneeded(clean.rename(flatten_records(rows, "_hour", wanted, keys)))
