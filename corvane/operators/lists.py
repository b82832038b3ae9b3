"""Steps that depend on the step before, over one key's bounded list at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def each_list(rows: DataFrame, key: str, fields: list[str], make: Callable[[list[dict]], list[dict]], shape: str) -> DataFrame:
    """make(list of a key's rows, as dictionaries in order of fields) for each key, its results as rows of shape, whose first column is the key.

    A key's rows become one array first, so a Python call serves a whole batch of keys; the
    lists must be bounded (a query's pool, a top k).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(shape))
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                x = whole.slice(at, 512)
                out = [{key: k} | row for k, own in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) for row in make(own)]
                yield pa.RecordBatch.from_pylist(out, schema)

    return lists.mapInArrow(run, shape)
