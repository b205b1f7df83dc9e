"""Exact top-k inner products by elimination with a table of pivots.

Components become integers, floor(scale * x), so scores are exact. For every vector the table
holds its angles to PIVOTS vectors of the collection. Angles obey the triangle inequality: a
query and a candidate are at least |a - b| apart if their angles to a pivot are a and b. The
greatest of these bounds over all pivots gives a least angle, and |q| |x| cos(least angle) is
at least the score. Candidates are evaluated in the order of that bound; once it falls below
the k-th best score so far, no candidate left can count, and the search stops exactly.

The bounds eliminate twice. Candidates are dealt out in parts and queries in groups, both by
their nearest pivot; from the ranges of the angles and the greatest norms in each, a part that
cannot hold a result for any query of a group never meets it. What is left meets in tasks of
one part and one group, where each query goes through the part in bound order. Every query
starts from the k-th best score among the sample rows that pivots are drawn from, so even its first
part is cut short.

Scale: vectors are shuffled by their part and go to the groups that their part may serve. A
part has about PART_ROWS rows and a group about QUERY_ROWS, however many vectors lie nearest
one pivot. Only k rows of a query leave a task. Of vectors equal in all components the k + 1
smallest ids suffice and are kept before anything else. The driver sees SAMPLE_ROWS vectors
and one count for each pivot.

Defined results: rows without id, with a null vector or with null or non-finite components
take no part; rows of equal id and vector are one; rows of equal id and different vectors are
queries and candidates of their own; a candidate with the query's id is the query itself; only
vectors of one length are compared; vectors without components score 0; ties go to the smaller
id; a query without candidates has no rows; other input columns are ignored. A score beyond
64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, ship, stored

K = 5
SCALE = 256
PIVOTS = 32
#: Bound on the rows that pivots are chosen from.
SAMPLE_ROWS = 1024
PART_ROWS = 8192
QUERY_ROWS = 4096
#: Ranges of parts meet ranges of groups in DEAL x DEAL blocks.
DEAL = 16
#: Radians and share by which bounds are widened against rounding.
ANGLE_SLACK, SHARE_SLACK = 1e-6, 1e-9
EXACT = 2**53


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integral vectors; (queries, rows) -> int64."""
    largest = max(1, queries.shape[-1]) * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)
    if largest < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows] for q in queries], object).reshape(len(queries), len(rows))
    return exact.astype(np.int64)  # OverflowError beyond 64 bits


def angles(rows: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots, 0 where a norm is 0."""
    if not len(pivots) or not len(rows):
        return np.zeros((len(rows), len(pivots)))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = (rows / norms[:, None]) @ (pivots / np.linalg.norm(pivots, axis=1)[:, None]).T
    return np.arccos(np.clip(np.where(np.isfinite(cosines), cosines, 1.0), -1, 1))


def farthest_first(rows: np.ndarray, pivots: int) -> np.ndarray:
    """Up to `pivots` of the rows, each as far as can be from those before it; none of norm 0."""
    norms = np.linalg.norm(rows, axis=1)
    rows, norms = rows[norms > 0], norms[norms > 0]
    if not len(rows) or not rows.shape[1]:
        return rows[:0]
    chosen, nearest = [0], angles(rows, norms, rows[:1])[:, 0]
    while len(chosen) < pivots and nearest.max() > ANGLE_SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(rows, norms, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


class Table:
    """Pivots and sample of each length of vector."""

    def __init__(self, sample: list[tuple[int, list[float]]], pivots: int):
        self.width = pivots
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v in sample}:
            ids, rows = zip(*((i, v) for i, v in sample if len(v) == dim), strict=True)
            rows = np.array(rows, np.float64).reshape(len(ids), dim)
            self.of[dim] = (farthest_first(rows, pivots), np.array(ids, np.int64), rows)

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(norms, angles, nearest pivot) of rows of one length; without pivots all angles are 0."""
        pivots = self.of[rows.shape[1]][0] if rows.shape[1] in self.of else rows[:0]
        norms = np.linalg.norm(rows, axis=1)
        found = np.zeros((len(rows), self.width))
        found[:, : len(pivots)] = angles(rows, norms, pivots)
        return norms, found, found[:, : max(1, len(pivots))].argmin(axis=1)

    def floors(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query among the sample's rows of other ids."""
        if rows.shape[1] not in self.of:
            return np.full(len(rows), -np.inf)
        _, others, sample = self.of[rows.shape[1]]
        found = np.where(ids[:, None] == others[None, :], -np.inf, scores(rows, sample).astype(np.float64))
        found = found if found.shape[1] >= k else np.full((len(rows), k), -np.inf)
        return np.nextafter(np.partition(found, -k, axis=1)[:, -k], -np.inf)  # scores beyond 2^53 are rounded here


def best_of(query: np.ndarray, norm: float, near: np.ndarray, floor: float, own: int, k: int, rows: np.ndarray, norms: np.ndarray, table: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows evaluated) of one query's k best in a part; table: angles by pivot.

    floor: a score that k rows are known to reach; rows below it are left out."""
    least = np.zeros(len(rows))
    alive = np.flatnonzero(ids != own)
    for s in range(0, len(near), 8):  # a few pivots at a time, each for the rows that those before have left
        least[alive] = np.maximum(least[alive], np.abs(table[s : s + 8, alive] - near[s : s + 8, None]).max(axis=0, initial=0))
        bound = norm * norms[alive] * np.cos(np.maximum(least[alive] - ANGLE_SLACK, 0)) + SHARE_SLACK * norm * norms[alive] + 1
        alive, bound = alive[bound >= floor], bound[bound >= floor]
    if not len(near):
        bound = norm * norms[alive] * (1 + SHARE_SLACK) + 1
    order = np.argsort(-bound, kind="stable")
    alive, bound = alive[order], bound[order]
    best_ids, best, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 256
    while at < len(alive) and not (len(best) == k and bound[at] < best[-1]):
        part = alive[at : at + step]
        best_ids, best = np.concatenate((best_ids, ids[part])), np.concatenate((best, scores(query[None, :], rows[part])[0]))
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best, at, step = best_ids[top], best[top], at + step, step * 2
    return best_ids, best, min(at, len(alive))


def packed(sizes: dict[tuple[int, int], int], room: int, together: bool) -> dict[tuple[int, int], tuple[int, int]]:
    """(length, pivot) -> (first part, number of parts) of at most about `room` rows each; together: neighbours share a part that has room."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    part, left, before = -1, 0, None
    for (dim, home), n in sorted(sizes.items()):
        cut = -(-n // room)
        if not together or cut > 1 or n > left or dim != before:
            part, left = part + 1, room
        out[dim, home] = (part, cut)
        part, left, before = part + cut - 1, left - n if cut == 1 else 0, dim
    return out


def exact_top_k(df: DataFrame, asked: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query; asked: SQL condition on the id column that holds for queries."""
    spark = df.sparkSession
    ship(spark)
    vectors = F.col(vector_col).cast("array<double>")
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vectors.alias("v"), F.expr(asked).alias("asked")).where(usable).groupBy("id", "v").agg(F.first("asked").alias("asked"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = stored(rows, "vectors")
    candidates = kept.select("id", "v", nth.alias("nth")).where(F.col("nth") <= k + 1).drop("nth")
    queries = kept.where("asked").select("id", "v")
    whole = lambda v: np.floor(scale * np.asarray(v, np.float64))
    drawn = kept.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).collect()  # at most sample_rows vectors
    table = Table([(r["id"], whole(r["v"]).tolist()) for r in drawn], pivots)
    held = spark.sparkContext.broadcast(table)

    def placed(frame: DataFrame, as_query: bool) -> DataFrame:
        def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            lists, ids, out = b.column(1), b.column(0).to_numpy(), []
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for dim in np.unique(np.diff(offsets)):
                at = np.flatnonzero(np.diff(offsets) == dim)
                own = whole(np.array([flat[s : s + dim] for s in offsets[at]]).reshape(len(at), dim))
                norms, near, home = held.value.placed(own)
                floors = held.value.floors(ids[at], own, k) if as_query else np.full(len(at), -np.inf)
                lists_of = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * pivots, near.ravel())
                out.append(pa.table({"id": ids[at], "twin": b.column(2).take(pa.array(at)), "dim": pa.array(np.full(len(at), dim), pa.int32()), "home": pa.array(home, pa.int32()), "norm": norms, "floor": floors, "near": lists_of, "raw": pa.array([v.tobytes() for v in own], pa.binary())}))
            return pa.concat_tables(out).combine_chunks().to_batches()[0]

        made = stored(map_batches(frame.withColumn("twin", F.xxhash64("v")), per_batch, "id bigint, twin bigint, dim int, home int, norm double, floor double, near array<double>, raw binary"), "pivot-table")
        sizes = {(r["dim"], r["home"]): r["count"] for r in made.groupBy("dim", "home").count().collect()}  # a row for each pivot
        shares = packed(sizes, query_rows, True) if as_query else packed(sizes, part_rows, False)
        dealt = spark.createDataFrame([(*key, *share) for key, share in shares.items()], "dim int, home int, first int, cut int")
        return made.join(F.broadcast(dealt), ["dim", "home"]).withColumn("part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cut"))).cast("int")).drop("first", "cut")

    def ranges(frame: DataFrame) -> DataFrame:
        ends = [f(F.col("near")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(pivots)]
        made = frame.groupBy("dim", "part").agg(F.max("norm").alias("norm"), F.min("floor").alias("floor"), *ends)
        return made.select("dim", "part", "norm", "floor", F.array(*(f"min{i}" for i in range(pivots))).alias("low"), F.array(*(f"max{i}" for i in range(pivots))).alias("high"))

    left, right = placed(queries, True), placed(candidates, False)
    deal = F.sequence(F.lit(0), F.lit(DEAL - 1))
    groups = ranges(left).select("dim", F.col("part").alias("g"), F.col("norm").alias("g_norm"), "floor", F.col("low").alias("g_low"), F.col("high").alias("g_high"), F.pmod("part", F.lit(DEAL)).alias("x"), F.explode(deal).alias("y"))
    blocks = ranges(right).select("dim", "part", "norm", "low", "high", F.pmod("part", F.lit(DEAL)).alias("y"), F.explode(deal).alias("x"))
    apart = F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), F.lit(0.0), lambda most, i: F.greatest(most, F.col("g_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("g_high")[i]))
    reach = F.col("g_norm") * F.col("norm") * (F.greatest(F.cos(F.greatest(apart - ANGLE_SLACK, F.lit(0.0))), F.lit(0.0)) + SHARE_SLACK) + 1
    meeting = stored(groups.join(blocks, ["dim", "x", "y"]).where(reach >= F.col("floor")).select("dim", "g", "part"), "meetings")
    body = ["id", "twin", "norm", "floor", "near", "raw"]
    sent = left.withColumnRenamed("part", "g").join(meeting, ["dim", "g"]).select("dim", "g", "part", F.lit(True).alias("query"), *body)
    sent = sent.unionByName(right.join(meeting, ["dim", "part"]).select("dim", "g", "part", F.lit(False).alias("query"), *body))

    def per_part(t: pa.Table) -> pa.Table:
        dim, t = t.column("dim")[0].as_py(), t.combine_chunks()
        is_query = t.column("query").to_numpy()
        ids, twins, norms, floors = (t.column(c).to_numpy() for c in ("id", "twin", "norm", "floor"))
        raw = np.frombuffer(b"".join(t.column("raw").to_pylist()), np.float64).reshape(len(ids), dim)
        near = pa.concat_arrays(t.column("near").chunks).flatten().to_numpy().reshape(len(ids), pivots)
        rest = ~is_query
        c_ids, c_rows, c_norms, by_pivot = ids[rest], raw[rest], norms[rest], np.ascontiguousarray(near[rest].T)
        out = [np.zeros((4, 0), np.int64)]
        for i in np.flatnonzero(is_query):
            found, values, _ = best_of(raw[i], norms[i], near[i], floors[i], ids[i], k, c_rows, c_norms, by_pivot, c_ids)
            out.append(np.vstack((np.full(len(found), ids[i]), np.full(len(found), twins[i]), found, values)))
        return pa.table(dict(zip(("query_id", "twin", "vec_id", "score"), np.hstack(out), strict=True)))

    found = sent.groupBy("dim", "g", "part").applyInArrow(per_part, "query_id bigint, twin bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_five(df: DataFrame) -> DataFrame:
    """The 5 best of the vectors whose id is divisible by 50."""
    return exact_top_k(df, "vec_id % 50 = 0")
