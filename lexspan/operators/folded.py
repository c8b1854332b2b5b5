"""Folds in Python over the rows of a key in order, for what hangs on the row before in a way no window says.

Spark sorts the rows, on disk where they are many, and the fold takes them one by one: neither a key's rows nor a key's
results are ever held together, and keys cost nothing of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

from pyspark.sql import DataFrame

from ..binding import known_to_workers

BATCH = 10_000


def _mapped(rows: DataFrame, make: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    known_to_workers(rows.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))
    most = BATCH

    def each(batches):
        found = iter(make(tuple(v.as_py() for v in row) for b in batches for row in zip(*b.columns, strict=True)))
        while part := list(islice(found, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), out, strict=True)], names=out.names)

    return rows.mapInArrow(each, schema)


def by_row(rows: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """What make(*row) yields of each row, as rows of schema."""
    return _mapped(rows, lambda every: (made for row in every for made in make(*row)), schema)


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[object, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What fold(key, its rows in order) yields, as rows of schema; key is the first column of rows."""
    make = lambda every: (made for k, own in groupby(every, itemgetter(0)) for made in fold(k, own))
    return _mapped(rows.repartition(key).sortWithinPartitions(key, *order), make, schema)
