"""Running a Python state machine over ordered rows of a key, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def run_columns(df: DataFrame, keys: tuple[str, ...], order: str, reads: tuple[str, ...], make: Callable[[], Callable], extra: T.StructType) -> DataFrame:
    """The rows of df for which a key's machine gives a tuple, all their columns unchanged, with the tuple as columns `extra`.

    make() gives a key's machine, which is called with the values of `reads`; rows pass by as Arrow columns and never
    become Python objects. Rows are shuffled by key once, sorted within their partition, and streamed: memory is one
    batch and one key's state, not a key's rows. A key never spans partitions, so results don't depend on how many there are."""
    names = [*df.columns, *extra.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        added, now, machine = to_arrow_schema(extra), None, None
        for batch in batches:
            kept, out = [], []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys))
            for place, (key, row) in enumerate(zip(key_rows, zip(*(batch.column(c).to_pylist() for c in reads)))):
                if key != now:
                    now, machine = key, make()
                if (found := machine(*row)) is not None:
                    kept.append(place)
                    out.append(found)
            if kept:
                own = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept))
                columns = zip(*out) if len(extra) else ()
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, added))], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, T.StructType([*df.schema.fields, *extra.fields]))
