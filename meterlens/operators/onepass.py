"""Several grouped results from one scan of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import shared_path


@dataclass(frozen=True)
class Grouped:
    """A result of the form: filter, group, aggregate, finish.

    ``keys``: name -> expression; ``aggregates``: name -> (function, expression),
    the function one that ignores nulls (sum, avg, count, min, max);
    ``where``: which rows take part (all if None); ``finish``: from the
    grouped frame (keys and aggregates) to the result.
    """

    keys: Mapping[str, Column]
    aggregates: Mapping[str, tuple[Callable[[Column], Column], Column]]
    where: Column | None = None
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)


def one_pass(df: DataFrame, results: Mapping[str, Grouped], path: str | None = None) -> dict[str, DataFrame]:
    """Every result of ``results`` from a single scan of ``df``.

    The key sets become the grouping sets of one aggregate and each
    aggregate counts the rows of its own result alone, so one partial
    aggregate per task feeds one shuffle.  The groups, which are few beside
    the rows, are written once to ``path`` (a new shared folder unless
    given); each result is then cut out of them.  Empty results stay empty,
    and null keys are groups like others.
    """
    if not results:
        return {}
    names = list(results)
    # Equal keys of several results are one column; their grouping set is one too.
    columns: dict[str, Column] = {}
    sets: dict[str, tuple[str, ...]] = {}
    for name in names:
        own = []
        for alias, expression in results[name].keys.items():
            same = next((c for c, e in columns.items() if str(e) == str(expression)), None)
            key = same or f"_k{len(columns)}_{alias}"
            columns.setdefault(key, expression)
            own.append(key)
        sets[name] = tuple(own)
    ready = df.select(*[e.alias(c) for c, e in columns.items()],
                      *[(F.lit(True) if results[n].where is None else F.coalesce(results[n].where, F.lit(False))).alias(f"_in{i}")
                        for i, n in enumerate(names)],
                      *[e.alias(f"_v{i}_{a}") for i, n in enumerate(names) for a, (_, e) in results[n].aggregates.items()])
    states = [F.count(F.when(F.col(f"_in{i}"), F.lit(1))).alias(f"_rows{i}") for i in range(len(names))]
    states += [function(F.when(F.col(f"_in{i}"), F.col(f"_v{i}_{a}"))).alias(f"_a{i}_{a}")
               for i, n in enumerate(names) for a, (function, _) in results[n].aggregates.items()]
    distinct: Sequence[tuple[str, ...]] = list(dict.fromkeys(sets.values()))
    grouped = (ready.groupingSets([[F.col(c) for c in s] for s in distinct], *columns)
               .agg(F.grouping_id().alias("_set"), *states))
    path = path or shared_path(df, "one-pass")
    grouped.write.parquet(path)
    stored = df.sparkSession.read.schema(grouped.schema).parquet(path)
    # Bits of grouping_id from the left, 1 for columns that are not in the set.
    number = {s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for s in distinct}
    found = {}
    for i, name in enumerate(names):
        own = stored.filter((F.col("_set") == number[sets[name]]) & (F.col(f"_rows{i}") > 0))
        found[name] = results[name].finish(own.select(
            *[F.col(c).alias(alias) for c, alias in zip(sets[name], results[name].keys)],
            *[F.col(f"_a{i}_{a}").alias(a) for a in results[name].aggregates]))
    return found
