"""Appending columns computed in Python to a DataFrame, batch by batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import ROWS, bound_batches


def make_room(df: DataFrame, names: list[str]) -> DataFrame:
    """Input columns of these names, whatever their case, are kept as ``<name>_in``."""
    wanted, have = {n.lower() for n in names}, {c.lower() for c in df.columns}
    out = []
    for c in df.columns:
        new = c
        while c.lower() in wanted and new.lower() in have | wanted:
            new += "_in"
        have.add(new.lower())
        out.append(new)
    return df.toDF(*out) if out != df.columns else df


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside the heap of their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def append_columns(df: DataFrame, inputs: list[str], added: T.StructType, make: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """``df`` with the columns of ``added``.

    ``make()`` is called once per task and returns a function from the input
    columns, as Arrow arrays, to one list of values per added column. The other
    columns pass through untouched. An added column may replace one of ``inputs``;
    any other column of its name is kept as ``<name>_in``.
    """
    bound_batches(df.sparkSession)
    df = make_room(df, [n for n in added.names if n not in inputs])
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in added.names], *added.fields])
    kept = [f.name for f in df.schema.fields if f.name not in added.names]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = list(added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        gc.disable()  # nothing cyclic is made here, and looking through large tables again and again takes a quarter of the time
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    columns = work(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
                    arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                    arrays += [c if isinstance(c, pa.Array) else pa.array(c, kind, from_pandas=False) for c, kind in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])
        finally:
            gc.enable()
        del work
        give_back()

    return df.mapInArrow(run, schema)
