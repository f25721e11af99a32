"""Folds over sorted rows, where a row's result depends on all before it.

Rows are dealt by their keys and sorted where they are; a task then reads them
in one pass and keeps what the fold of one key needs, never the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.tables import distrust_unions

#: Rows that a fold sends on at once.
ROWS = 10_000


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold gets the rows of one key in order, as tuples of `values`, and gives
    the rest of its result rows; schema: the keys, then those."""
    distrust_unions(df.sparkSession)
    n, columns = len(keys), [*keys, *values]
    names = [*keys, *[part.split()[0] for part in schema.split(", ")]]
    types = {k: t for k, t in df.select(*keys).dtypes}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*[batch[c] for c in columns]))
        out: list[tuple] = []
        for key, group in groupby(rows, itemgetter(slice(0, n))):
            for found in fold(row[n:] for row in group):
                out.append((*key, *found))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    whole = ", ".join([*[f"{k} {types[k]}" for k in keys], schema])
    return df.select(*dict.fromkeys([*columns, *order])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(of, whole)
