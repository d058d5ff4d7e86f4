"""Vectors in metric cells: validity, pivots, chunks and samples, shared by two operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 256
LEAST_CHUNK, MOST_CHUNK = 256, 4096


def valid(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or empty and has finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Each list as the bytes of its doubles."""
    return [np.asarray(x, np.float64).tobytes() for x in column.to_pylist()]


def stack(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; the error is far below SLACK times the largest norm."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


#: Relative slack of bounds that come out of rounded distances (a squared distance loses half the digits near 0).
SLACK = 1e-6


def deal(points: DataFrame, place, pivots: np.ndarray) -> DataFrame:
    """points (id, v binary) with cell (nearest pivot, by ``place`` of the raw vectors) and dist (to it)."""
    dim = pivots.shape[1]
    shared = points.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors at most
    id_type = points.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = b.column(1)
            if not len(v):
                continue
            at = place(np.stack([np.frombuffer(x, np.float64) for x in v.to_pylist()]))
            d = distances(at, shared.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), v, pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "dist"]
            )

    assert dim
    return points.select("id", "v").mapInArrow(run, f"id {id_type}, v binary, cell long, dist double")


def chunk_rows(n: int) -> int:
    """Rows of a chunk: about 32 chunks for small inputs, then more chunks of bounded size."""
    return max(LEAST_CHUNK, min(MOST_CHUNK, n // 32))


def sample(points: DataFrame, n: int) -> list[bytes]:
    """Distinct vectors of at most MAX_PIVOTS rows with the smallest hashes."""
    k = max(1, min(MAX_PIVOTS, n // (2 * chunk_rows(n))))
    rows = points.select("v").orderBy(F.xxhash64("id", "v"), "v").limit(k).collect()
    return sorted({bytes(r["v"]) for r in rows})
