"""Small solvers: linear systems and root finding, one per row, as Arrow maps over numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bisect(f: Callable[[Column], Column], lo: Column, hi: Column, steps: int = 60) -> Column:
    """A root of f between lo and hi by bisection, all in one expression; null if f has one sign at both ends."""
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        left = F.signum(f(s["lo"])) * F.signum(f(mid)) <= 0
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(F.signum(f(lo)) * F.signum(f(hi)) <= 0, got)


def solve_rows(df: DataFrame, id_col: str, matrix: str, rhs: str) -> DataFrame:
    """(id, x array, det): n equations a row, matrix row by row; x is null where a pivot is below 1e-12."""

    def run(batches):
        for b in batches:
            xs, dets = [], []
            for m, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, n = np.array(m, dtype=float), len(r)
                a = a.reshape(n, n)
                det = float(np.linalg.det(a))
                dets.append(det)
                xs.append(np.linalg.solve(a, np.array(r, dtype=float)) if np.linalg.matrix_rank(a, tol=1e-12) == n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.list_(pa.float64())), pa.array(dets)], names=[id_col, "x", "det"])

    return df.select(F.col(id_col).cast("long"), matrix, rhs).mapInArrow(run, f"{id_col} long, x array<double>, det double")


def inverse_rows(df: DataFrame, id_col: str, matrix: str) -> DataFrame:
    """(id, inverse array, row by row) of a square matrix a row; null where it is singular."""

    def run(batches):
        for b in batches:
            out = []
            for m in b.column(1).to_pylist():
                n = int(round(len(m) ** 0.5))
                a = np.array(m, dtype=float).reshape(n, n)
                out.append(np.linalg.inv(a).ravel() if np.linalg.matrix_rank(a, tol=1e-12) == n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "inverse"])

    return df.select(F.col(id_col).cast("long"), matrix).mapInArrow(run, f"{id_col} long, inverse array<double>")


def hmac_verify(key: str, message: Column, signature: Column) -> Column:
    """Whether a signature, in either case, is that of the message; false for null."""
    return F.coalesce(hmac_sha256(key, message) == F.lower(signature), F.lit(False))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hexadecimal: two nested digests over padded keys, JVM-side."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ p for x in raw)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
