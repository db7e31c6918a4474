"""Applies vectorised kernels to array columns, one Arrow batch at a time.

Rows with a null array, a null element or no sample rate have null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_TYPES = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have equal lengths as a matrix."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))


def _column(values, ddl: str) -> pa.Array:
    kind = _TYPES[ddl]
    if not ddl.startswith("array"):
        return pa.array(np.asarray(values), kind)
    if isinstance(values, np.ndarray) and values.ndim == 2:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind.value_type))
    return pa.array([np.asarray(v) for v in values], kind)


def _complete(batch: pa.RecordBatch, arrays: list[str], rate: str) -> np.ndarray:
    """Which rows have all arrays without nulls and a rate."""
    good = batch.column(rate).is_valid().to_numpy(zero_copy_only=False)
    for a in arrays:
        column = batch.column(a)
        good = good & column.is_valid().to_numpy(zero_copy_only=False)
        values = column.flatten()
        if values.null_count:
            parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            good[np.unique(parents[~values.is_valid().to_numpy(zero_copy_only=False)])] = False
    return good


def map_arrays(df: DataFrame, arrays: list[str], outputs: dict[str, str], fn: Callable, keep: list[str], rate: str = "sample_rate") -> DataFrame:
    """``keep`` columns plus ``outputs`` (name -> type).

    fn(matrices by name, sample rate) gets rows of equal lengths and rate and returns the outputs by
    name. Only the named columns are read, so the scan below can prune the others.
    """
    needed = list(dict.fromkeys([*keep, *arrays, rate]))
    source = df.select(*needed)
    types = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            good = _complete(whole, arrays, rate)
            if not good.all():
                bad = whole.filter(pa.array(~good))
                yield pa.RecordBatch.from_arrays([*(bad.column(k) for k in keep), *(pa.nulls(bad.num_rows, _TYPES[t]) for t in outputs.values())], names=[*keep, *outputs])
            batch = whole.filter(pa.array(good)) if not good.all() else whole
            if not batch.num_rows:
                continue
            key = np.stack([pc.list_value_length(batch.column(a)).to_numpy(zero_copy_only=False).astype(float) for a in arrays] + [batch.column(rate).to_numpy(zero_copy_only=False).astype(float)])
            _, group = np.unique(key, axis=1, return_inverse=True)
            group = group.ravel()
            for g in range(group.max() + 1):
                rows = np.flatnonzero(group == g)
                part = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
                got = fn({a: matrix(part.column(a)) for a in arrays}, float(key[-1, rows[0]]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(_column(got[n], t) for n, t in outputs.items())], names=[*keep, *outputs])

    return source.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"`{n}` {t}" for n, t in outputs.items()]))
