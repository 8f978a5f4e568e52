"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.sinks import drop_staged, stage  # noqa: F401

__all__ = ["prepare", "stage", "stage_and_free", "drop_staged", "checksum", "key_runs", "mix64", "window_hashes"]


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of at most 1,000 rows: a batch of long documents stays far
    below an executor's memory (the default of 10,000 rows would not)."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def stage_and_free(df: DataFrame, name: str) -> DataFrame:
    """``stage``, and the shuffle files that made the table are deleted once it is written
    (they are not read again; by default they stay until the driver's collector finds them)."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(key, before)


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free hash) of a table: two equal values mean that a loop has settled."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def key_runs(frames: Iterator, keys: list[str]) -> Iterator:
    """Cut a stream of frames, sorted by ``keys``, into one frame per key; a run that
    crosses Arrow batches is joined, so only one group is held at a time."""
    import pandas as pd

    held: list = []
    for f in frames:
        if not len(f):
            continue
        change = np.zeros(len(f), dtype=bool)
        for k in keys:
            a = f[k].to_numpy()
            change[1:] |= a[1:] != a[:-1]
        if held and any(held[-1][k].iloc[-1] != f[k].iloc[0] for k in keys):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), len(f)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if i:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(f.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply), on a uint64 array."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


MULT = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
INV = pow(MULT, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and INV**i modulo 2**64 for i < n (kept and grown between calls)."""
    if len(_POW.get("m", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("m", MULT), ("i", INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["m"][:n], _POW["i"][:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """P with P[j] = sum of (b[i] + 1) * MULT**i for i < j, modulo 2**64."""
    m, _ = _powers(len(b) + 1)
    p = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * m[:-1], out=p[1:])
    return p


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end) of one byte array.
    Equal contents have equal hashes; the length is mixed in."""
    _, inv = _powers(len(prefix))
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(32)))


def window_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` bytes (none if the array is shorter)."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, inv = _powers(len(prefix))
    return mix64((prefix[k:] - prefix[:-k]) * inv[:n])
