"""Sequential work on small groups of rows, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame


def dealt(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One shuffle by key and one sort: a group's rows stand together, in order, in one task."""
    return frame.repartition(*keys).sortWithinPartitions(*keys, *order)


def running(frame: DataFrame, keys: list[str], order: list, columns: list[str], start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """``name``: what a group's own function, made by ``start``, gives for the columns of each of its rows, in order.

    For folds that remember little: no group is ever held, so its size doesn't matter.
    """

    def run(batches):
        last, step = None, None
        for batch in batches:
            out = []
            for *key, values in zip(*(batch[k].tolist() for k in keys), zip(*(batch[c].tolist() for c in columns), strict=True), strict=True):
                if key != last:
                    last, step = key, start()
                out.append(step(*values))
            yield batch.assign(**{name: out})

    return dealt(frame, keys, order).mapInPandas(run, f"{fields(frame)}, {name} {kind}")


def by_group(frame: DataFrame, keys: list[str], order: list, work: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each group, in order, as named tuples; it gives the result's rows as tuples.

    A task streams through its groups and holds one at a time, a page as a rule. For
    many small groups this costs a fraction of one call of Spark's own grouped map for
    each.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        held, last = [], None
        for batch in batches:
            out = []
            keyed = zip(*(batch[k].tolist() for k in keys), strict=True)
            for key, row in zip(keyed, batch.itertuples(index=False, name="Row"), strict=True):
                if key != last and held:
                    out.extend(work(held))
                    held = []
                last = key
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            out = list(work(held))
            if out:
                yield pd.DataFrame(out, columns=names)

    return dealt(frame, keys, order).mapInPandas(run, schema)


def groups(rows: Iterable, opens: Callable, joins: Callable) -> Iterable[list]:
    """Rows in order as groups: one is opened by a row that ``opens`` says so of, or that doesn't join the last group."""
    held: list = []
    for row in rows:
        if held and (opens(row) or not joins(held, row)):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def fields(frame: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in frame.dtypes)
