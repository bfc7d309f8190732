"""Keyed changes on immutable tables: last or first wins, upsert, cascade. Every operator returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; give a full order, or rows that tie are interchangeable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest(df: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The newest delivery of each key."""
    return one_per_key(df, [key], [F.col(at).desc_nulls_last()])


def inserted_or_ignored(base: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`base` with the first new row of each key that it lacks. Null keys are never equal, so such rows all come in."""
    fresh = one_per_key(new.na.drop(subset=keys), keys, order)
    keyless = new.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    return base.unionByName(fresh.join(base.select(*keys), keys, "left_anti")).unionByName(keyless)


def upserted(base: DataFrame, new: DataFrame, key: str, id_col: str | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """`base` with the rows of `new` put in by `key` (unique in each).

    Columns that `new` has replace the old ones where the key matches, except the id and the `kept` ones; a new key gets an id
    after the largest one.
    """
    stay = {key, id_col, *kept} - {None}
    taken = [c for c in new.columns if c in base.columns and c not in stay]
    b, n = base.alias("b"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full")
    columns = []
    for c in base.columns:
        old = F.col(f"b.{c}")
        if c == key or (c in kept and c in new.columns):
            columns.append(F.coalesce(old, F.col(f"n.{c}")).alias(c))
        elif c in taken:
            columns.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    out = joined.select(*columns)
    if id_col is None:
        return out
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    from .ranking import ranked

    fresh = ranked(out.where(F.col(id_col).isNull()), [F.col(key)], "_n").crossJoin(top).withColumn(id_col, F.col("_top") + F.col("_n")).drop("_top", "_n")
    return out.where(F.col(id_col).isNotNull()).unionByName(fresh.select(*out.columns))


def updated(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`base` with the non-null values of `columns` in `new` (unique by key) put over the old ones."""
    over = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = base.join(over, key, "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def without(df: DataFrame, column: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """The rows whose `column` isn't among the values that go; null values stay."""
    return df.join(gone.select(F.col(gone_col).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def edges_without(edges: DataFrame, gone: DataFrame, gone_col: str) -> DataFrame:
    """Edges after functions are deleted: those from them go too, those to them lose their target."""
    left = without(edges, "caller_function_id", gone, gone_col)
    ids = gone.select(F.col(gone_col).alias("callee_function_id"), F.lit(True).alias("_gone")).distinct()
    joined = left.join(ids, "callee_function_id", "left")
    target = F.when(F.col("_gone").isNull(), F.col("callee_function_id"))
    return joined.withColumn("callee_function_id", target).select(*edges.columns)
