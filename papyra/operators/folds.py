"""Folds over the ordered rows of each key, in constant memory: for state that windows can't express.

Rows are brought together and sorted by a shuffle whose sort spills; a task then runs over them once and holds the state of
one key at a time, so the rows of a key may be any number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 4096


class Fold:
    """State of a key. step takes a row as a dict and gives output rows, tuples without the key; finish gives the last ones."""

    def step(self, row: dict) -> Iterator[tuple]:
        return iter(())

    def finish(self) -> Iterator[tuple]:
        return iter(())


def fold(rows: DataFrame, keys: list[str], order: list, make: Callable[[], Fold], schema: str) -> DataFrame:
    """Runs a Fold over the rows of each key in order: rows of the keys and of schema. Null keys are keys; no rows, no keys."""
    names, given = T.StructType.fromDDL(schema).names, T.StructType.fromDDL(schema)
    whole = T.StructType([*(rows.schema[k] for k in keys), *given.fields])
    arrow, width = to_arrow_schema(whole), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def put(key, found):
            for row in found:
                if len(row) != width:
                    raise ValueError(f"{len(row)} values for {width} columns")
                out.append((*key, *row))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        put(now, state.finish())
                    now, state = key, make()
                put(key, state.step(row))
                if len(out) >= ROWS:
                    yield batch()
        if state is not None:
            put(now, state.finish())
        yield batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)
