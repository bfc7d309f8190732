"""What changed between two states of a text, and what is to be analysed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base priority of each reason; other reasons have 1, exported functions 5 more.
BASE_PRIORITY = {"new": 5, "signature_changed": 10, "body_changed": 7, "deps_changed": 3}


def diff_ratio(old: Column, new: Column) -> Column:
    """Distinct trimmed lines of one side only, over the larger number of lines; may exceed 1."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    sa, sb = (F.array_distinct(F.transform(x, lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+\z", ""))) for x in (a, b))
    changed = F.size(F.array_except(sa, sb)) + F.size(F.array_except(sb, sa))
    return changed / F.greatest(F.size(a), F.size(b), F.lit(1))


def reanalysis_reason(old_hash: Column, old_signature: Column, old_body: Column, hash_: Column, signature: Column, body: Column, threshold: float = 0.3) -> Column:
    """new, unchanged, signature_changed, body_changed or minor_change; a null old hash means there was none."""
    return (
        F.when(old_hash.isNull(), "new").when(old_hash == hash_, "unchanged").when(~old_signature.eqNullSafe(signature), "signature_changed")
        .when(diff_ratio(old_body, body) > threshold, "body_changed").otherwise("minor_change")
    )


def priority(reason: Column, exported: Column) -> Column:
    base = F.lit(1)
    for name, value in BASE_PRIORITY.items():
        base = F.when(reason == name, value).otherwise(base)
    return base + F.when(exported, 5).otherwise(0)


def file_changes(old: DataFrame, new: DataFrame, path_col: str = "path", hash_col: str = "content_hash") -> DataFrame:
    """(path, status): added, changed, unchanged or removed, from a full join of two states keyed by path."""
    o = old.select(F.col(path_col).alias("path"), F.col(hash_col).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(F.col(path_col).alias("path"), F.col(hash_col).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, "path", "full").select("path", status.alias("status"))
