"""Replicated sequences, version history and line diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_replicas(*logs: DataFrame) -> DataFrame:
    """(id, lamport, tomb, value): the union of op-logs by id. Merging is commutative, associative and idempotent.

    An id keeps its first position (least lamport); a tombstone on any side wins; the value is the latest's.
    """
    every = logs[0]
    for x in logs[1:]:
        every = every.unionByName(x)
    latest = F.max_by("value", F.struct("lamport", "value")).alias("value")
    return every.groupBy("id").agg(F.min("lamport").alias("lamport"), F.max("tomb").alias("tomb"), latest)


def live(state: DataFrame) -> DataFrame:
    return state.where(~F.col("tomb"))


def insert_op(site: str, clock: Column, value: Column) -> list[Column]:
    """The op-log columns (id, lamport, tomb, value) of an insertion; an id is clock:site."""
    return [F.concat_ws(":", clock.cast("string"), F.lit(site)).alias("id"), clock.cast("long").alias("lamport"), F.lit(False).alias("tomb"), value.alias("value")]


def delete_op(op_id: Column, clock: Column, value: Column) -> list[Column]:
    """A deletion: the same id again with a tombstone."""
    return [op_id.alias("id"), clock.cast("long").alias("lamport"), F.lit(True).alias("tomb"), value.alias("value")]


def moved(state: DataFrame, ids: DataFrame, lamport: Column) -> DataFrame:
    """state with the rows of ids (column id) at a later place."""
    out = state.join(ids.select("id", F.lit(True).alias("_moved")), "id", "left")
    return out.withColumn("lamport", F.when(F.col("_moved"), lamport).otherwise(F.col("lamport"))).drop("_moved")


def serialise(state: DataFrame) -> DataFrame:
    """(line): id, lamport, tombstone and value of each row, a tab between; the value may be empty."""
    return state.select(F.concat_ws("\t", "id", F.col("lamport").cast("string"), F.col("tomb").cast("int").cast("string"), F.coalesce("value", F.lit(""))).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The rows of serialise()'s lines."""
    f = F.split("line", "\t", 4)
    return lines.select(f[0].alias("id"), f[1].cast("long").alias("lamport"), (f[2] == "1").alias("tomb"), f[3].alias("value"))


def version_list(history: DataFrame, key: str, order: str) -> DataFrame:
    """history with the number of each version of its key, from 1."""
    return history.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def latest_versions(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last version of each key and how many there are; no sort of the history."""
    return history.groupBy(key).agg(F.max(order).alias("version"), F.max_by(value, order).alias("value"), F.count("*").alias("versions"))


def line_diff(pairs: DataFrame, id_col: str, old: str, new: str, prefer_insert: bool = True) -> DataFrame:
    """(id, idx, op, line): the shortest script from old to new; = kept, - deleted, + inserted.

    Ties prefer insertion (or deletion). One final line end is dropped. Longest common subsequences
    have no expression in SQL, so this is an Arrow map; a pair's cost is the product of its lines
    outside the common beginning and end.
    """
    import pyarrow as pa

    def script(a: list[str], b: list[str]):
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [("=", s) for s in a[:head]], 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                out.append(("=", x[i]))
                i, j = i + 1, j + 1
                continue
            can = [(best[i][j + 1], prefer_insert, "+") if j < len(y) else None, (best[i + 1][j], not prefer_insert, "-") if i < len(x) else None]
            op = max(c for c in can if c)[2]
            out.append((op, y[j] if op == "+" else x[i]))
            i, j = i + (op == "-"), j + (op == "+")
        return out + [("=", s) for s in a[len(a) - tail :]]

    def lines(s: str | None) -> list[str]:
        s = (s or "").removesuffix("\n")
        return s.split("\n") if s else []

    def run(batches):
        for b in batches:
            rows = [(i, k, op, line) for i, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) for k, (op, line) in enumerate(script(lines(x), lines(y)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=[id_col, "idx", "op", "line"])

    return pairs.select(F.col(id_col).cast("long"), old, new).mapInArrow(run, f"{id_col} long, idx int, op string, line string")
