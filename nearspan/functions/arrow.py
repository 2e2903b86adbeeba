"""Arrow functions over lists of values: nulls are taken out before a kernel runs and put back after it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from nearspan.shipping import ship


def kind_of(returns: str | DataType) -> DataType:
    return returns if isinstance(returns, DataType) else _parse_datatype_string(returns)


def _present(columns: Sequence[pa.Array]) -> np.ndarray:
    mask = np.ones(len(columns[0]), bool)
    for c in columns:
        if c.null_count:
            mask &= c.is_valid().to_numpy(zero_copy_only=False)
    return mask


def _doubles(kind: pa.DataType) -> pa.DataType:
    """Number literals of SQL are decimals: kernels take doubles."""
    if pa.types.is_decimal(kind):
        return pa.float64()
    return pa.list_(_doubles(kind.value_type)) if pa.types.is_list(kind) else kind


def _values(column: pa.Array, mask: np.ndarray) -> list:
    if (kind := _doubles(column.type)) != column.type:
        column = column.cast(kind)
    return (column if mask.all() else column.filter(pa.array(mask))).to_pylist()


def _spread(values: pa.Array, mask: np.ndarray) -> pa.Array:
    """Values at the places of mask, nulls elsewhere."""
    if mask.all():
        return values
    return values.take(pa.array(np.cumsum(mask) - 1, mask=~mask))


def _arrow(values: Any, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.dtype.kind == "f":
        return pa.array(values, kind, mask=np.isnan(values)) if np.isnan(values).any() else pa.array(values, kind)
    return pa.array(values, kind)


def mapped(kernel: Callable, returns: str | DataType) -> Callable[..., pa.Array]:
    """Of kernel(list, ..., *options), a function of Arrow columns: the columns past the first ``kernel.arity`` are options.

    Any null gives null, unless ``kernel.nulls``. Rows of equal options are computed together; mostly all rows are.
    """
    kind = to_arrow_type(kind_of(returns))
    arity, nulls = getattr(kernel, "arity", None), getattr(kernel, "nulls", False)
    same = lambda v: repr(v) if isinstance(v, (dict, list)) else v

    def run(*columns: pa.Array) -> pa.Array:
        mask = np.ones(len(columns[0]), bool) if nulls else _present(columns)
        data = [_values(c, mask) for c in columns]
        n = len(data[0])
        main, extra = data[: arity or len(data)], data[arity or len(data) :]
        if not n or not extra:
            return _spread(_arrow(kernel(*main) if n else [], kind), mask)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*extra)):
            groups.setdefault(tuple(map(same, key)), []).append(i)
        parts, order = [], []
        for rows in groups.values():
            parts.append(_arrow(kernel(*([c[i] for i in rows] for c in main), *(c[rows[0]] for c in extra)), kind))
            order += rows
        values = pa.concat_arrays(parts).take(pa.array(np.argsort(order)))
        return _spread(values, mask)

    return run


def udf(kernel: Callable, returns: str | DataType, arity: int | None = None, nulls: bool = False):
    """A Spark function that calls kernel over whole Arrow batches; with nulls, it sees them."""
    if session := SparkSession.getActiveSession():
        ship(session)

    def call(*args):
        return kernel(*args)

    call.arity, call.nulls = arity, nulls
    return F.arrow_udf(mapped(call, returns), kind_of(returns))


def pairwise(kernel: Callable[[list, list], Any], returns: str | DataType) -> Callable[[Column, Column], Column]:
    """A column function of two columns. Distinct pairs of a batch are computed once."""

    def once(a: list, b: list):
        places: dict[tuple, int] = {}
        at = [places.setdefault(p, len(places)) for p in zip(a, b)]
        if len(places) == len(a):
            return kernel(a, b)
        values = kernel([p[0] for p in places], [p[1] for p in places])
        return values[np.array(at, np.int64)] if isinstance(values, np.ndarray) else [values[i] for i in at]

    return udf(once, returns, 2)


def single(kernel: Callable[[str], Any], returns: str | DataType) -> Callable[[Column], Column]:
    """A column function of one string; distinct strings of a batch are computed once."""

    def once(a: list):
        found = {x: kernel(x) for x in set(a)}
        return [found[x] for x in a]

    return udf(once, returns, 1)


def flattened(kernel: Callable, queries: Sequence[str], targets: Sequence[Sequence[str | None]], *options) -> list[list]:
    """kernel over all (query, target) of each row at once; null targets give nulls."""
    a = [q for q, ts in zip(queries, targets) for t in ts if t is not None]
    b = [t for ts in targets for t in ts if t is not None]
    values = kernel(a, b, *options) if a else []
    if isinstance(values, np.ndarray):
        values = [None if v != v else v for v in values.tolist()]
    it = iter(values)
    return [[None if t is None else next(it) for t in ts] for ts in targets]


def one_to_many(kernel: Callable[[list, list], Any], returns: str) -> Callable[[Column, Column], Column]:
    def run(queries: list, targets: list):
        return flattened(kernel, queries, targets)

    return udf(run, f"array<{returns}>", 2)
