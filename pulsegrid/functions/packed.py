"""Cross products of vectors as packed upper triangles in one array column, and small matrix algebra on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.frames import dot


def products(z: Column, weight: Column | None = None) -> Column:
    """Products z_i z_j for i <= j, row by row; each pair is formed once."""
    scaled = z if weight is None else F.transform(z, lambda a: a * weight)
    return F.flatten(F.transform(z, lambda a, i: F.transform(F.slice(scaled, i + 1, F.size(z)), lambda b: a * b)))


def summed(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """(keys, array): arrays added place by place. Sums are built where the rows are, so a group's rows never meet."""
    places = rows.select(*keys, F.posexplode(array).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return places.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda e: e["_v"]).alias(array))


def weighted(rows: DataFrame, keys: list[str], array: str, weight: Column, width: int) -> DataFrame:
    """(keys, array, n_rows): weighted sums of short arrays of up to ``width`` places, summed side by side in one aggregate."""
    sums = rows.groupBy(*keys).agg(
        *[F.sum(F.get(array, F.lit(i)) * weight).alias(f"_s{i}") for i in range(width)],
        F.max(F.size(array)).alias("_size"), F.count(F.lit(1)).alias("n_rows"))
    return sums.select(*keys, F.slice(F.array(*[f"_s{i}" for i in range(width)]), F.lit(1), F.col("_size")).alias(array), "n_rows")


def drawn(weights: DataFrame, rows: DataFrame, day: str, keys: list[str], array: str, per_task: int = 64) -> DataFrame:
    """(draw, keys, array, total): sums of the arrays of ``rows`` weighted by the weights (draw, day, w) of their dates.

    Dates meet year by year and draws ``per_task`` at a time, as one product of two small matrices, weights by date and arrays by
    date; the years' sums are added after that. No row is copied per draw.
    """
    left = weights.select("draw", F.floor(F.col("draw") / per_task).cast("int").alias("_block"), F.year(day).alias("_year"), F.col(day).alias("_day"), F.col("w").cast("double").alias("_w"))
    last = weights.agg(F.max("draw")).first()[0] or 0
    right = rows.select(*keys, F.col(day).alias("_day"), F.year(day).alias("_of"), array, F.explode(F.sequence(F.lit(0), F.lit(last // per_task))).alias("_for"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "draw int, " + ", ".join(f"{k} {fields[k]}" for k in keys) + f", {array} array<double>, total double"

    def each(w: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        days, at = np.unique(own["_day"].to_numpy().astype("datetime64[D]"), return_inverse=True)
        draws, row = np.unique(w["draw"].to_numpy(), return_inverse=True)
        drawn_day = w["_day"].to_numpy().astype("datetime64[D]")
        place = np.searchsorted(days, drawn_day)
        known = np.isin(drawn_day, days)
        matrix = np.zeros((len(draws), len(days)))
        matrix[row[known], place[known]] = w["_w"].to_numpy()[known]
        out = []
        for key, g in own.assign(_at=at).groupby(keys):
            share = matrix[:, g["_at"].to_numpy()]
            sums, total = share @ np.vstack(g[array]), share.sum(axis=1)
            out += [(int(d), *key, s.tolist(), float(t)) for d, s, t in zip(draws, sums, total)]
        return pd.DataFrame(out, columns=["draw", *keys, array, "total"])

    years = left.groupBy("_block", "_year").cogroup(right.groupBy("_for", "_of")).applyInPandas(each, schema)
    total = years.groupBy("draw", *keys).agg(F.sum("total").alias("total"))
    return summed(years, ["draw", *keys], array).join(total, ["draw", *keys])


def triangle(m: int) -> int:
    return m * (m + 1) // 2


def side(packed: Column) -> Column:
    """Rows of the triangle's square: m (m + 1) / 2 numbers are packed."""
    return F.floor((F.sqrt(8 * F.size(packed) + 1) - 1) / 2).cast("int")


def whole(packed: Column, m: Column) -> Column:
    """The m x m matrix of a packed triangle, row by row."""

    def at(p: Column) -> Column:
        i, j = F.least(F.floor(p / m), p % m), F.greatest(F.floor(p / m), p % m)
        return F.get(packed, (i * m - F.floor(i * (i - 1) / 2) + (j - i)).cast("int"))

    return F.transform(F.sequence(F.lit(0), m * m - 1), at)


def block(matrix: Column, m: Column, k: Column) -> Column:
    """The leading k x k block of an m x m matrix."""
    return F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(matrix, i * m + 1, k)))


def column(matrix: Column, m: Column, k: Column, j: Column) -> Column:
    """The first k numbers of column j."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get(matrix, i * m + j))


def times(matrix: Column, v: Column, k: Column) -> Column:
    """A k x k matrix times a vector."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: dot(F.slice(matrix, i * k + 1, k), v))


_SOLVED = "beta array<double>, rank int"


def solved(sums: DataFrame, keys: list[str], array: str) -> DataFrame:
    """(keys, beta, rank): least squares from packed cross products of (x, y), solved a batch at a time."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema) + ", " + _SOLVED

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for size, own in pdf.groupby(pdf[array].map(len)):
                beta, rank = least_squares(unpacked(np.vstack(own[array])))
                yield own[keys].assign(beta=list(beta), rank=rank)

    return sums.select(*keys, array).mapInPandas(each, schema)


def least_squares(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-norm coefficients in scaled columns, and rank, from a stack of cross products of (x, y)."""
    xx, xy = g[:, :-1, :-1], g[:, :-1, -1]
    diagonal = np.einsum("nii->ni", xx)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    values, vectors = np.linalg.eigh(xx / (scale[:, :, None] * scale[:, None, :]))
    keep = values > np.maximum(values.max(axis=1, keepdims=True), 0.0) * 1e-11
    inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    inner = np.einsum("nij,nj->ni", vectors, inverse * np.einsum("nji,nj->ni", vectors, xy / scale))
    return inner / scale, keep.sum(axis=1)


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Square matrices of packed triangles, one per row of ``packed``."""
    packed = np.atleast_2d(packed)
    m = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
    out = np.zeros((len(packed), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = out[:, j, i] = packed
    return out
