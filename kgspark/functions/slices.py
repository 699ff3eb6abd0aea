"""Python steps over rows with texts, a bounded slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a batch that are Python objects at a time; one row may be more.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, texts: list[int], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose columns at ``texts`` hold about ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = [pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in texts]
    start, held = 0, 0
    for row, size in enumerate(sum(sizes).tolist()):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, texts: list[str], step: Callable[[pa.RecordBatch], list], schema: StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``schema`` that ``step`` makes of each slice, column by column (lists or Arrow arrays).

    Unlike a pandas UDF it runs once, whatever filters stand behind it, and
    holds no Python objects of a whole batch.
    """
    at, arrow = [df.columns.index(c) for c in texts], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                columns = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(step(part), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
