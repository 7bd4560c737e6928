"""Embedding near-dedup by a subspace pigeonhole join.

Equal vectors are taken together first. Unit vectors are rotated at random and split into blocks of few dimensions.
If two vectors are within squared distance D, then in some block of b of the d dimensions they are within D * b / d;
and of the blocks in a ring, some block is within its share and so is the sum of it and the next within theirs (else
shares that are exceeded would add up to more than D all round). Each block is therefore range-joined under its
share: cells on its first dimensions bring together what can be that near, and the distances in it and in the next
filter. The union of the blocks' candidates is verified on whole vectors; groups are connected components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import batch_of, connected, cut, mix64, pick

MIN_COSINE = 0.95
BLOCK_DIMS = 8
SEED = 7
CELL_VECTORS = 50_000
SLACK = 1e-5  # for the rounding of single precision within blocks


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, dim, unit vector as float64 bytes), without vectors that have no direction."""
    for b in batches:
        ids, dims, out = [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1)):
            if i is None or not v.is_valid:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:  # nulls come as NaN
                continue
            x = x / top
            ids.append(i)
            dims.append(len(x))
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield batch_of({"vec_id": (ids, pa.int64()), "dim": (dims, pa.int32()), "unit": (out, pa.binary())})


def _cells(max_sq: float, block_dims: int, grid_dims: int, seed: int):
    """(u, dim, unit) -> (dim, block, cell, probe, u, coords in the block and the next): each vector in its own cell of every block, and as a probe in
    those cells before it (in lexicographic order) that a vector near it in the block can be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            all_ids, all_dims, units = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for dim in np.unique(all_dims):
                at = np.flatnonzero(all_dims == dim)
                ids = all_ids[at]
                x = np.frombuffer(b"".join(units[k] for k in at), dtype=np.float64).reshape(-1, dim)
                if dim not in turned:
                    turned[dim] = rotation(int(dim), seed)
                x = x @ turned[dim]
                for block, s in enumerate(range(0, dim, block_dims)):
                    y = x[:, s : s + block_dims]
                    r = math.sqrt(max_sq * y.shape[1] / dim) * (1 + SLACK) + SLACK
                    g = min(grid_dims, y.shape[1])
                    home = np.floor(y[:, :g] / r).astype(np.int64)
                    after = (s + block_dims) % (-(-dim // block_dims) * block_dims)
                    both = [y, x[:, after : after + block_dims]] if dim > block_dims else [y]
                    coords = np.ascontiguousarray(np.concatenate(both, axis=1), dtype=np.float32)
                    blobs = [c.tobytes() for c in coords]
                    for step in itertools.product((-1, 0, 1), repeat=g):
                        if step > (0,) * g:
                            continue
                        probe = any(step)
                        # distance to the neighbouring cell, by dimension
                        gap = np.zeros(len(y))
                        for k, d in enumerate(step):
                            edge = y[:, k] - home[:, k] * r
                            gap += np.square(edge if d < 0 else r - edge) if d else 0
                        ok = np.flatnonzero(gap <= r * r)
                        cell = np.zeros(len(ok), dtype=np.uint64)
                        for k, d in enumerate(step):
                            cell = mix64(cell + (home[ok, k] + d).astype(np.uint64) + np.uint64(k + 1))
                        n = len(ok)
                        yield batch_of({"dim": (np.full(n, dim), pa.int32()), "block": (np.full(n, block), pa.int32()), "cell": (cell.view(np.int64), pa.int64()), "probe": (np.full(n, probe), pa.bool_()), "u": (ids[ok], pa.int64()), "coords": ([blobs[k] for k in ok], pa.binary())})

    return run


def _near(max_sq: float, block_dims: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block = key[0].as_py(), key[1].as_py()
        ids = table.column("u").to_numpy()
        whole = np.frombuffer(b"".join(table.column("coords").to_pylist()), dtype=np.float32).reshape(len(ids), -1)
        width = min(block_dims, dim - block * block_dims)
        x = whole[:, :width]
        probe = table.column("probe").to_numpy()
        most = np.float32(max_sq * width / dim * (1 + SLACK) + SLACK)
        most_both = np.float32(max_sq * whole.shape[1] / dim * (1 + SLACK) + SLACK)
        home = np.flatnonzero(~probe)
        h, hid = x[home], ids[home]
        hh = (h * h).sum(1)
        order = np.concatenate([home, np.flatnonzero(probe)])
        found = [np.empty((0, 2), dtype=np.int64)]
        step = max(1, 4_000_000 // max(1, len(home)))
        for s in range(0, len(order), step):
            rows = order[s : s + step]
            p = x[rows]
            d = hh - 2 * (p @ h.T) + (p * p).sum(1)[:, None]
            i, j = np.nonzero(d <= most)
            a, b = ids[rows[i]], hid[j]
            ok = np.where(probe[rows[i]], a != b, a < b)
            if whole.shape[1] > width:
                ok &= np.square(whole[rows[i]] - whole[home[j]]).sum(1) <= most_both
            a, b = a[ok], b[ok]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


@F.pandas_udf(DoubleType())
def _sq_dist(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.square(np.frombuffer(x) - np.frombuffer(y)).sum()) for x, y in zip(a, b)], dtype=float)


def _distinct(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(distinct unit vectors: u, rep, dim, unit; their members: u, vec_id). ``rep`` is the least id, ``u`` a number."""
    own = pick(vectors, vec_id=id_col, embedding=vector_col).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    unit = own.mapInArrow(_unit, "vec_id bigint, dim int, unit binary")
    same = cut(unit.groupBy("dim", "unit").agg(F.min("vec_id").alias("rep")).withColumn("u", F.monotonically_increasing_id()))
    return same, unit.join(same.select("u", "dim", "unit"), ["dim", "unit"]).select("u", "vec_id").distinct()


def _near_units(same: DataFrame, min_cosine: float, block_dims: int, seed: int) -> DataFrame:
    """(a, b, sq_dist) of all pairs of distinct unit vectors, by their numbers, that are near."""
    max_sq = 2 * (1 - min_cosine)
    # as many grid dimensions as bring the cells down to a size that a task compares at once
    grid = min(block_dims, max(1, math.ceil(math.log(max(1, same.count()) / CELL_VECTORS, 3)) + 1))
    cells = same.select("u", "dim", "unit").mapInArrow(_cells(max_sq, block_dims, grid, seed), "dim int, block int, cell bigint, probe boolean, u bigint, coords binary")
    pairs = cells.groupBy("dim", "block", "cell").applyInArrow(_near(max_sq, block_dims), "a bigint, b bigint").distinct()
    side = lambda x: same.select(F.col("u").alias(x), F.col("unit").alias(f"unit_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", _sq_dist("unit_a", "unit_b").alias("sq_dist")).where(F.col("sq_dist") <= max_sq)


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, block_dims: int = BLOCK_DIMS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """All pairs of cosine at least ``min_cosine``: vec_id_a < vec_id_b, sq_dist (of the unit vectors, 6 digits).

    The search is exact: every vector is a query, and equally near ones are all returned. Vectors that are null,
    empty, all zero, or have a null, NaN or infinite element, and those without id, are in no pair; vectors of
    different length neither, however long. Rows with the same id are versions of one vector: they make no pair with
    each other, and a pair of ids counts with its least distance. Other columns are ignored, whatever their names;
    an empty table gives no pairs.
    """
    same, members = _distinct(vectors, id_col, vector_col)
    near = _near_units(same, min_cosine, block_dims, seed)
    near = near.unionByName(same.select(F.col("u").alias("a"), F.col("u").alias("b"), F.lit(0.0).alias("sq_dist")))
    side = lambda x, n: members.select(F.col("u").alias(x), F.col("vec_id").alias(n))
    both = near.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y")
    return both.groupBy(F.least("x", "y").alias("vec_id_a"), F.greatest("x", "y").alias("vec_id_b")).agg(F.round(F.min("sq_dist"), 6).alias("sq_dist"))


def vector_groups(vectors: DataFrame, min_cosine: float = MIN_COSINE, block_dims: int = BLOCK_DIMS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, root, group_size) of each id that has a vector with a direction: its group, and whom to keep of it.

    Groups are connected components of the pairs that ``near_vectors`` returns; ``root`` is the least id, which a
    near-dedup keeps, so there are no ties; who is alone is its own root. Rows with the same id are versions of one
    vector, whose groups are one. The same vectors count, and an empty table has no groups.
    """
    same, members = _distinct(vectors, id_col, vector_col)
    near = _near_units(same, min_cosine, block_dims, seed)
    side = lambda x: same.select(F.col("u").alias(x), F.col("rep").alias(f"rep_{x}"))
    links = near.join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    alike = members.join(same.select("u", "rep"), "u").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    grouped = connected(links.unionByName(alike))
    ids = members.select("vec_id").distinct()
    out = ids.join(grouped, ids.vec_id == grouped.node, "left").select("vec_id", F.coalesce("root", "vec_id").alias("root"))
    sizes = out.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("group_size"))
    return out.join(sizes, out.root == sizes.r).select("vec_id", "root", "group_size")


def op4(spark, sf_dir: str) -> DataFrame:
    """The group of every vector of ``embeddings``: vec_id, root (whom to keep of it), group_size."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
p AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE power(list_distance(a.e, b.e), 2) <= {2 * (1 - MIN_COSINE):.6f}
),
r AS (
  SELECT vec_id, vec_id AS other FROM u
  UNION
  SELECT r.vec_id, p.y AS other FROM r JOIN p ON p.x = r.other
),
g AS (SELECT vec_id, CAST(min(other) AS BIGINT) AS root, count(*) AS group_size FROM r GROUP BY vec_id)
SELECT CAST(vec_id AS BIGINT) AS vec_id, root, group_size FROM g
"""
