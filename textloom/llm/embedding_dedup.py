"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine c lie 2 - 2c apart in squared distance. A fixed rotation spreads that
over all coordinates; cut into blocks, two vectors within the budget are within the block's
proportional share of it in at least one block. Each block is range-joined by a grid over
its two leading coordinates: a vector stands in its own cell and in those that its radius
reaches. In a cell the block distance rejects most pairs, the rest are verified by the
cosine in double precision, and a pair counts only in the first block that admits it and in
the home cell of its larger id, so exactly once.

Scale: equal vectors are one class from the start. Cells hold vectors of one label; a cell
of more than CELL_ROWS rows is dealt out as pairs of parts, so no task gets a whole hot
cell. What leaves a cell is a count per vector and a spanning forest, never its pairs.

Defined results: vectors without label, null, empty, zero, or with null or non-finite
elements link with nothing; vectors of different length never link; rows of equal id, label
and vector count as one vector and share results; rows without id link with nothing and
have a null component; other input columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, ship, stored
from textloom.llm.components import components

COSINE = 0.98
BLOCKS = 8
CELL_ROWS = 4096
TOLERANCE = 1e-9


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of(dim: int) -> np.ndarray:
    """The blocks' borders: BLOCKS nearly equal runs of coordinates, fewer for short vectors."""
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def budgets(dim: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(edges_of(dim)) / dim


def cells_of(vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, cell x, cell y, home) of every cell that a vector stands in."""
    dim = vectors.shape[1]
    x, edges, radius = unit(vectors) @ rotation(dim), edges_of(dim), np.sqrt(budgets(dim, cosine)) * (1 + 1e-6) + TOLERANCE
    out: list[tuple] = []
    for k in range(len(edges) - 1):
        side = 2 * radius[k] if radius[k] > 1e-6 else 1e-5
        lead = x[:, edges[k] : edges[k + 1]][:, :2]
        if lead.shape[1] == 1:
            lead = np.hstack((lead, np.zeros((len(lead), 1))))
        low, own, high = (np.floor((lead + d) / side).astype(np.int64) for d in (-radius[k], 0, radius[k]))
        seen = np.zeros((0, 3), np.int64)
        for cx in (low[:, 0], high[:, 0], own[:, 0]):
            for cy in (low[:, 1], high[:, 1], own[:, 1]):
                seen = np.vstack((seen, np.column_stack((np.arange(len(x)), cx, cy))))
        seen = np.unique(seen, axis=0)
        rows = seen[:, 0]
        out.append((rows, np.full(len(seen), k), seen[:, 1], seen[:, 2], (seen[:, 1:] == own[rows]).all(1)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def linked_pairs(homes: np.ndarray, others: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked pairs with home id > other id that `block` is the first to admit."""
    dim = homes.shape[1]
    edges, budget, turn = edges_of(dim), budgets(dim, cosine) * (1 + 1e-6) + TOLERANCE, rotation(dim)
    h, o = unit(homes), unit(others)
    hr, orr = h @ turn, o @ turn
    lo, hi = edges[block], edges[block + 1]
    found_i, found_j = [], []
    near = (orr[:, lo:hi] ** 2).sum(1)
    for s in range(0, len(h), 256):
        part = hr[s : s + 256, lo:hi]
        d = (part**2).sum(1)[:, None] + near[None, :] - 2 * part @ orr[:, lo:hi].T
        i, j = np.nonzero((d <= budget[block] + 1e-9) & (home_ids[s : s + 256, None] > other_ids[None, :]))
        for t in range(0, len(i), 1 << 16):
            a, b = i[t : t + (1 << 16)] + s, j[t : t + (1 << 16)]
            good = np.einsum("ij,ij->i", h[a], o[b]) >= cosine
            a, b = a[good], b[good]
            shares = np.add.reduceat((hr[a] - orr[b]) ** 2, edges[:-1], axis=1) if len(a) else np.zeros((0, len(budget)))
            first = (shares <= budget).argmax(1) == block
            found_i.append(a[first])
            found_j.append(b[first])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] = parent.setdefault(p, p)
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            kept.append((x, y))
    return kept


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per input row: (id, n_links, component_id)."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).withColumns(
        {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    key = ["label", "k1", "k2"]
    classes = stored(
        rows.where(usable).dropDuplicates(["id", *key]).groupBy(*key).agg(F.min("id").alias("vid"), F.count("*").alias("copies"), F.first("v").alias("v")),
        "vectors",
    )
    kind = df.schema[label_col].dataType.simpleString()

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        lists, parts = b.column(3), []
        lengths = np.diff(lists.offsets.to_numpy())
        flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            vectors = np.stack([flat[s : s + dim] for s in starts[at]])
            row, block, cx, cy, home = cells_of(vectors, cosine)
            raw = [v.tobytes() for v in vectors]
            take = pa.array(at[row])
            parts.append(
                pa.table(
                    {
                        "label": b.column(0).take(take), "dim": pa.array(np.full(len(row), dim), pa.int32()), "block": pa.array(block, pa.int32()), "cx": pa.array(cx), "cy": pa.array(cy),
                        "home": pa.array(home), "vid": b.column(1).take(take), "copies": b.column(2).take(take), "raw": pa.array([raw[r] for r in row], pa.binary()),
                    }
                )
            )
        return pa.concat_tables(parts).combine_chunks().to_batches()[0]

    cell = ["label", "dim", "block", "cx", "cy"]
    placed = map_batches(classes.select("label", "vid", "copies", "v"), per_batch, f"label {kind}, dim int, block int, cx bigint, cy bigint, home boolean, vid bigint, copies bigint, raw binary")
    big = placed.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS).select(*cell, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    dealt = placed.join(big, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    as_home = dealt.where("home").select(*cell, "vid", "copies", "raw", F.lit(True).alias("as_home"), F.col("own").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    as_other = dealt.select(*cell, "vid", "copies", "raw", F.lit(False).alias("as_home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("own").alias("q"))

    def per_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        homes, others = pdf[pdf.as_home], pdf[~pdf.as_home]
        none = pd.DataFrame({"vid": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(homes) or len(others) < 2:
            return none
        h, o = (np.frombuffer(b"".join(x.raw), np.float64).reshape(len(x), -1) for x in (homes, others))
        hid, oid = homes.vid.to_numpy(), others.vid.to_numpy()
        i, j = linked_pairs(h, o, hid, oid, int(pdf.block.iloc[0]), cosine)
        if not len(i):
            return none
        n_h = np.bincount(i, others.copies.to_numpy()[j], len(hid)).astype(np.int64)
        n_o = np.bincount(j, homes.copies.to_numpy()[i], len(oid)).astype(np.int64)
        tree = np.array(forest(hid[i], oid[j]), np.int64).reshape(-1, 2)
        return pd.DataFrame({"vid": np.concatenate((hid, oid, tree[:, 0])), "n": np.concatenate((n_h, n_o, np.zeros(len(tree), np.int64))), "other": np.concatenate((hid, oid, tree[:, 1]))}).query("n > 0 or vid != other")

    found = stored(as_home.unionByName(as_other).groupBy(*cell, "p", "q").applyInPandas(per_cell, "vid bigint, n bigint, other bigint"), "links")
    counted = found.groupBy("vid").agg(F.sum("n").alias("n"))
    joined = components(found.where("vid <> other").select(F.col("vid").alias("a"), F.col("other").alias("b")))
    of = classes.select(*key, "vid", "copies").join(counted, "vid", "left").join(joined.withColumnRenamed("v", "vid"), "vid", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "vid").alias("c"))
    matched = F.when(usable, F.col("k1"))  # rows that cannot link find no class
    return (
        rows.withColumn("k1", matched)
        .join(of, key, "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    )


def embedding_classes(df: DataFrame) -> DataFrame:
    """embedding_links() with kept: the vectors that represent their component."""
    return embedding_links(df).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
