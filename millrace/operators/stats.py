"""Byte statistics of payloads: counters are made for a whole Arrow batch and then added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import buffers

_ENTROPY = pa.struct([("n_bytes", pa.int64()), ("distinct_bytes", pa.int64()), ("entropy_bits", pa.float64())])


def byte_histogram(df: DataFrame, payload_col: str, *by: str) -> DataFrame:
    """``(by..., byte, n)`` over all payloads. A batch gives a row for each group and byte that it holds, so that a hot group's
    rows are added up before the shuffle; null payloads count as empty."""
    rows = df.select(*by, F.col(payload_col).alias("payload"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.rows_of(batch.column(len(by)))
            keys = pa.StructArray.from_arrays(batch.columns[: len(by)], batch.schema.names[: len(by)]).to_pylist() if by else [()] * batch.num_rows
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault(tuple(k.values()) if by else (), len(known)) for k in keys], np.int64)
            first = np.unique(group, return_index=True)[1]
            sums = np.zeros((len(known), 256), np.int64)
            for at, to, own, ends in buffers.in_turn(data, offsets):
                sums += buffers.counts(own, np.repeat(group[at:to], np.diff(ends)), len(known))
            row, byte = np.nonzero(sums)
            columns = [c.take(pa.array(first[row])) for c in batch.columns[: len(by)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(byte.astype(np.int32)), pa.array(sums[row, byte])], schema.names)

    return rows.mapInArrow(run, schema).groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def _entropies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    out = []
    for k in range(0, len(offsets) - 1, 1024):
        ends = offsets[k : k + 1025]
        n = np.diff(ends)
        share = buffers.counts(data[ends[0] : ends[-1]], np.repeat(np.arange(len(n)), n), len(n))
        weighted = (share * np.log2(np.maximum(share, 1))).sum(1)
        out.append((n, (share > 0).sum(1), np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def byte_entropy(payload: Column | str) -> Column:
    """``STRUCT<n_bytes, distinct_bytes, entropy_bits>`` of each payload: order-0 entropy in bits a byte. Null stays null."""
    return buffers.measure(_entropies, _ENTROPY, "n_bytes long, distinct_bytes long, entropy_bits double")(payload)


def entropy(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``(id, n_bytes, distinct_bytes, entropy_bits)`` for each row; null and empty payloads have no row. There is no shuffle."""
    rows = df.where(F.octet_length(payload_col) > 0).select(id_col, byte_entropy(payload_col).alias("found"))
    return rows.select(id_col, "found.*")
