"""Parameter trees as tables of paths, and rules that match paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_tree(tree: Mapping, separator: str = "/", prefix: str = "") -> dict:
    """Leaves of a nested mapping by path."""
    out = {}
    for key, value in tree.items():
        path = f"{prefix}{separator}{key}" if prefix else str(key)
        if isinstance(value, Mapping):
            out |= flatten_tree(value, separator, path)
        else:
            out[path] = value
    return out


def recover_tree(flat: Mapping, separator: str = ".") -> dict:
    """The nested mapping of leaves by path."""
    out: dict = {}
    for path, value in flat.items():
        *above, last = path.split(separator)
        at = out
        for key in above:
            at = at.setdefault(key, {})
        at[last] = value
    return out


# Partition rules of the decoder's parameters, in order; the first that matches holds.
PARTITION_RULES = [
    ("transformer/wte/embedding", "mp,fsdp"),
    ("attention/(wq|wk|wv)/kernel", "fsdp,mp"),
    ("attention/wo/kernel", "mp,fsdp"),
    ("feed_forward/w1/kernel", "fsdp,mp"),
    ("feed_forward/w2/kernel", "mp,fsdp"),
    ("feed_forward/w3/kernel", "fsdp,mp"),
    ("attention_norm/kernel", ""),
    ("ffn_norm/kernel", ""),
    ("transformer/ln_f/kernel", ""),
    ("lm_head/kernel", "fsdp,mp"),
    (".*", ""),
]


def first_match(path: Column, rules: list[tuple[str, str]], scalar: Column | None = None) -> Column:
    """The value of the first rule found in the path; a scalar leaf isn't partitioned; no rule at all is an error in the row."""
    out = F.when(scalar, F.lit("")) if scalar is not None else None
    for pattern, value in rules:
        out = F.when(path.rlike(pattern), F.lit(value)) if out is None else out.when(path.rlike(pattern), F.lit(value))
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no partition rule for "), path)).cast("string"))


def any_match(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def trainable(path: Column, patterns: list[str]) -> Column:
    return F.when(any_match(path, patterns), "trainable").otherwise("frozen")


def decayed(path: Column, exclusions: list[str]) -> Column:
    """Whether weight decay applies: to what no exclusion matches."""
    return ~any_match(path, exclusions)


def normalised_key(path: Column, prefix: str) -> Column:
    """The key without a leading prefix."""
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def loaded_names(params: DataFrame, prefix: str = "", known: list[str] | None = None, inserted: str = "inner_opt_state") -> DataFrame:
    """Parameters under the names that a target knows: only those below ``prefix``, which is cut off, and where a name isn't
    among ``known`` but would be with ``inserted`` after its first part, that one."""
    path = F.col("path")
    if prefix:
        params = params.where(F.startswith(path, F.lit(prefix + "/"))).withColumn("path", normalised_key(path, prefix + "/"))
    if known is None:
        return params
    names = F.array(*map(F.lit, known)).cast("array<string>")
    other = F.regexp_replace(path, "^([^/]+)/", f"$1/{inserted}/")
    return params.withColumn("path", F.when(~F.array_contains(names, path) & F.array_contains(names, other), other).otherwise(path))


def soup(params: DataFrame, key: list[str], expert: str, alpha: Column, value: Column) -> DataFrame:
    """Average of the experts' parameters with weights softmax(alpha): one value for each key."""
    w = F.exp(alpha)
    return params.groupBy(*key).agg((F.sum(w * value) / F.sum(w)).alias("value"))


def extended_rows(rows: DataFrame, model: str, row: str, value: str, base_rows: int, n_rows: int) -> DataFrame:
    """Rows below ``base_rows`` of each model as they are; above, every model gets the mean of the models that have the row."""
    models = rows.select(model).distinct()
    low = rows.where(F.col(row) < base_rows).select(model, row, value)
    high = rows.where((F.col(row) >= base_rows) & (F.col(row) < n_rows)).groupBy(row).agg(F.avg(value).alias(value))
    return low.unionByName(high.crossJoin(F.broadcast(models)).select(model, row, value))
