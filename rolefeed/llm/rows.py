"""Helpers shared by the operators: rows without a key, arrow maps over whole rows."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def fresh(prefix: str = "c") -> str:
    """A column name that no input has."""
    return f"_{prefix}_{uuid.uuid4().hex[:12]}"


def digest_of(*columns: Column) -> Column:
    """16 bytes that identify the content of some columns. NULL and empty differ.

    Rows are told apart by content, not by a key: keys may be NULL or repeated, and equal rows
    get equal results anyway.
    """
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    lengths = [F.coalesce(F.octet_length(c.cast("string")).cast("string"), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *lengths, *parts)))


def give_back() -> None:
    """Return memory that is free to the system. Python workers live on between stages, and what an
    earlier stage took would count beside what this one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(
    df: DataFrame, inputs: list[Column | str], schema: str | StructType,
    function: Callable[[list[pa.Array]], list[pa.Array]], rows: int = 2048, drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with columns computed in Python from some of its values, one batch at a time.

    ``function`` takes the input arrays and returns the new arrays, row for row; it is given at
    most ``rows`` of them at once. Existing columns of the same names are replaced, those in ``drop``
    go, others pass through as they are. An input given by name is a column that passes through; it
    travels once.
    """
    new = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    row = fresh("row")
    gone = {f.name.lower() for f in new} | {c.lower() for c in drop}
    kept = [c for c in df.columns if c.lower() not in gone]
    names = [fresh(f"in{i}") for i, c in enumerate(inputs) if not isinstance(c, str)]
    taken = df.select(
        F.struct(*[df[c] for c in kept]).alias(row) if kept else F.lit(0).alias(row),
        *[c.alias(n) for c, n in zip((c for c in inputs if not isinstance(c, str)), names)],
    )
    # Where each input is: a field of the row, or a column after it.
    place, own = [], iter(range(1, len(names) + 1))
    for c in inputs:
        place.append((0, kept.index(c)) if isinstance(c, str) else (next(own), None))
    out = StructType([taken.schema[row], *new])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                given = [part.column(i) if f is None else part.column(i).field(f) for i, f in place]
                made = function(given)
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[row, *new.names])
                del part, given, made
            # Workers live on between stages; what a batch took goes back.
            pa.default_memory_pool().release_unused()

    mapped = taken.mapInArrow(run, out)
    return mapped.select(*[mapped[row][c].alias(c) for c in kept], *new.names)


def type_of(ddl: str) -> DataType:
    return StructType.fromDDL(f"x {ddl}")["x"].dataType
