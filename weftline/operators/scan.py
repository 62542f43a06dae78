"""Ordered scan: order-dependent greedy folds over the rows of each key.

Rows are brought together by key, sorted by the storage engine (which spills)
and read as a stream in which only the fold's state is held, never a key's
rows. So a fold costs constant memory per key however long the key is. A fold
whose state is a few scalars can't be split further without changing its
result; folds that have exact restart points (see ``dedup``) are cut at them
before they come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A fold is made anew for each key. It takes a row and gives rows to emit; ``None`` asks for the rest.
Fold = Callable[[dict | None], list[dict]]


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Fold], schema: str) -> DataFrame:
    """Rows of ``schema`` (which must begin with the keys) from one fold per key, fed in the given order."""
    from pyspark.sql.types import _parse_datatype_string

    arrow = None
    struct = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = to_arrow_schema(struct)
        current: tuple | None = None
        step: Fold | None = None
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current or step is None:
                    if step is not None:
                        out += [dict(zip(keys, current, strict=True)) | r for r in step(None)]
                    current, step = key, fold()
                out += [dict(zip(keys, current, strict=True)) | r for r in step(row)]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if step is not None:
            out += [dict(zip(keys, current, strict=True)) | r for r in step(None)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
