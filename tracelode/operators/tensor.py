"""Tensor algebra on DataFrames.

A tensor is a row of a header (tensor_id, shape array<int>) and rows of cells (tensor_id, idx array<int>, val double), indices
from 0. Permutations, splits and concatenations only rewrite indices and never shuffle; linear and conv2d join on the
contracted index and aggregate. Dense tensors, held as one array a row, have kernels of higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, tensor_id: str, values: str, shape: list[int]) -> DataFrame:
    """Cells of tensors held as flat arrays in row-major order; a null array has none, one of another length than the shape's
    is an error."""
    whole = F.when(F.size(values) == _product(shape), F.col(values)).otherwise(F.raise_error(F.lit(f"values don't fill the shape {shape}")).cast("array<double>"))
    flat = df.where(F.col(values).isNotNull()).select(F.col(tensor_id).alias("tensor_id"), F.posexplode(whole).alias("_p", "val"))
    steps = [_product(shape[i + 1 :]) for i in range(len(shape))]
    idx = F.array(*[(F.floor(F.col("_p") / s) % n).cast("int") for s, n in zip(steps, shape)])
    return flat.select("tensor_id", idx.alias("idx"), F.col("val").cast("double").alias("val"))


def _product(x: list[int]) -> int:
    return reduce(lambda a, b: a * b, x, 1)


def permute(t: DataFrame, dims: list[int]) -> DataFrame:
    """out.shape[i] = in.shape[dims[i]]."""
    if sorted(dims) != list(range(len(dims))):
        raise ValueError("dims must be a permutation")
    return t.withColumn("idx", F.array(*[F.col("idx")[d] for d in dims]))


def transpose(t: DataFrame, dim0: int, dim1: int, ndim: int) -> DataFrame:
    dims = list(range(ndim))
    dims[dim0], dims[dim1] = dims[dim1], dims[dim0]
    return permute(t, dims)


def _with(idx: Column, dim: int, value: Column) -> Column:
    return F.transform(idx, lambda x, i: F.when(i == dim, value.cast("int")).otherwise(x))


def split(t: DataFrame, size: int | list[int], dim: int) -> DataFrame:
    """Cells with a column chunk, from 0: equal chunks of size (the last may be smaller), or chunks of the given sizes."""
    at = F.col("idx")[dim]
    if isinstance(size, int):
        chunk, base = F.floor(at / size), F.floor(at / size) * size
    else:
        bounds = [sum(size[: i + 1]) for i in range(len(size))]
        chunk = reduce(lambda c, b: c + (at >= b).cast("int"), bounds[:-1], F.lit(0))
        base = reduce(lambda c, k: F.when(at >= bounds[k], F.lit(bounds[k])).otherwise(c), range(len(bounds) - 1), F.lit(0))
    return t.withColumn("chunk", chunk.cast("int")).withColumn("idx", _with(F.col("idx"), dim, at - base))


def cat(parts: list[tuple[DataFrame, int]], dim: int) -> DataFrame:
    """Parts (cells, size along dim) one after the other along dim."""
    out, offset = None, 0
    for t, size in parts:
        moved = t.withColumn("idx", _with(F.col("idx"), dim, F.col("idx")[dim] + offset))
        out, offset = moved if out is None else out.unionByName(moved), offset + size
    return out


def linear(t: DataFrame, weight: DataFrame, ndim: int) -> DataFrame:
    """y = x W^T over the last axis; weight has cells (o, k, w) and is a parameter of bounded size, so its join side is
    broadcast by Spark where it is below the threshold and shuffled otherwise."""
    x = t.withColumn("k", F.col("idx")[ndim - 1])
    met = x.join(weight, "k").withColumn("idx", F.array_append(F.slice("idx", 1, ndim - 1), F.col("o").cast("int")))
    return met.groupBy("tensor_id", "idx").agg(F.sum(F.col("val") * F.col("w")).alias("val"))


def conv_size(n: int, kernel: int, stride: int = 1, padding: int = 0, dilation: int = 1) -> int:
    return (n + 2 * padding - dilation * (kernel - 1) - 1) // stride + 1


def conv2d(t: DataFrame, weight: DataFrame, height: int, width: int, kernel: tuple[int, int], stride: int = 1, padding: int = 0, dilation: int = 1) -> DataFrame:
    """Cells (n, c, h, w) with weight cells (o, c, kh, kw, w). Each input cell meets the kernel cells of its channel; those
    whose output position is whole and inside remain."""
    oh, ow = conv_size(height, kernel[0], stride, padding, dilation), conv_size(width, kernel[1], stride, padding, dilation)
    x = t.select("tensor_id", F.col("idx")[0].alias("n"), F.col("idx")[1].alias("c"), F.col("idx")[2].alias("h"), F.col("idx")[3].alias("w_in"), "val")
    met = x.join(weight, "c").withColumns({"a": F.col("h") + padding - dilation * F.col("kh"), "b": F.col("w_in") + padding - dilation * F.col("kw")})
    inside = met.where(f"a >= 0 and b >= 0 and a % {stride} = 0 and b % {stride} = 0 and a div {stride} < {oh} and b div {stride} < {ow}")
    idx = F.array("n", F.col("o").cast("int"), F.expr(f"cast(a div {stride} as int)"), F.expr(f"cast(b div {stride} as int)"))
    return inside.groupBy("tensor_id", idx.alias("idx")).agg(F.sum(F.col("val") * F.col("w")).alias("val"))


def shape_of(t: DataFrame, ndim: int) -> DataFrame:
    """(tensor_id, shape, numel)."""
    top = t.groupBy("tensor_id").agg(*[F.max(F.col("idx")[i]).alias(f"_{i}") for i in range(ndim)], F.count("*").alias("numel"))
    return top.select("tensor_id", F.array(*[(F.col(f"_{i}") + 1).cast("int") for i in range(ndim)]).alias("shape"), "numel")


def compatible(left: DataFrame, right: DataFrame, axis_left: int, axis_right: int) -> DataFrame:
    """Pairs of headers (tensor_id, shape) that agree on one axis."""
    a = left.select(F.col("tensor_id").alias("left_id"), F.element_at("shape", axis_left).alias("n"))
    b = right.select(F.col("tensor_id").alias("right_id"), F.element_at("shape", axis_right).alias("n"))
    return a.join(b, "n")


def allclose(a: DataFrame, b: DataFrame, rtol: float = 1e-2, atol: float = 1e-2) -> DataFrame:
    """(tensor_id, equal): all cells within atol + rtol |b|, and none missing on either side."""
    met = a.join(b.select("tensor_id", "idx", F.col("val").alias("other")), ["tensor_id", "idx"], "full_outer")
    near = F.coalesce(F.abs(F.col("val") - F.col("other")) <= atol + rtol * F.abs(F.col("other")), F.lit(False))
    return met.groupBy("tensor_id").agg(F.bool_and(near).alias("equal"))


def reductions(t: DataFrame) -> DataFrame:
    """(tensor_id, total, mean, above_mean)."""
    centred = t.withColumn("_m", F.avg("val").over(Window.partitionBy("tensor_id")))
    return centred.groupBy("tensor_id").agg(F.sum("val").alias("total"), F.avg("val").alias("mean"), F.count_if(F.col("val") > F.col("_m")).alias("above_mean"))


# Kernels of tensors held as one array<double> a row: nothing is exploded or shuffled.


def dense_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dense_permute(values: Column, shape: list[int], dims: list[int]) -> Column:
    steps = [_product(shape[i + 1 :]) for i in range(len(shape))]
    out_shape = [shape[d] for d in dims]
    out_steps = [_product(out_shape[i + 1 :]) for i in range(len(out_shape))]
    return F.transform(
        F.sequence(F.lit(0), F.lit(_product(shape) - 1)), lambda p: F.element_at(values, (1 + reduce(lambda a, k: a + (F.floor(p / out_steps[k]) % out_shape[k]) * steps[dims[k]], range(len(dims)), F.lit(0))).cast("int"))
    )


def dense_linear(values: Column, weight: list[list[float]], rows: int) -> Column:
    """x of shape (rows, len(weight[0])) to (rows, len(weight))."""
    k, o = len(weight[0]), len(weight)
    w = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in weight])
    dot = lambda r, j: F.aggregate(F.zip_with(F.slice(values, (r * k + 1).cast("int"), k), F.element_at(w, (j + 1).cast("int")), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(o - 1)), lambda j: dot(r, j))))
