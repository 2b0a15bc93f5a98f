"""Exact top-k by inner product over norm buckets.

Vectors are packed, within the partitions that hold them, into blocks of similar length. A query's k-th score against a
bounded probe of the longest vectors is a lower bound for its threshold. A block is skipped by a query if the product of
lengths stays below that; else the local cosine threshold (threshold over the product of lengths) chooses length pruning (the
block's prefix that is long enough) or, if it is high, coordinate pruning (the range that the query's heaviest coordinate
leaves to the vectors' own). Products of what remains are verified exactly in integers.

Queries meet rows in a grid. Blocks, of bounded size, go to cells of blocks of like length; a block of queries is sent only to
cells that can hold a result for it, by the lengths alone, before any vector moves; and where there are many query blocks, each
cell is repeated for groups of them. A grid point has its own key, so neither a dimension that all vectors share nor repeated
vectors crowd a task. Each pair of blocks sends at most k rows a query to the final ranking, a window by query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an
id. A query is compared with vectors of its own dimension only, and never with rows of its own id. Rows that repeat an id
are candidates each; as queries they count once, with the least vector. Fewer than k candidates give fewer rows.
Components above 2**40 after scaling are computed in Python's integers; scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

_BLOCK = "dim int, n int, longest double, ids binary, data binary"
#: Kinds of blocks by dimension and length, at most; blocks of a cell and queries' blocks of a group that are aimed at.
KINDS = 512
CELLS = 2048
GROUP = 32
_BIG = 2.0**40
_EXACT = 2.0**53


def vectors(rows: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, norm, data): components floor(scale * x) as little-endian doubles, which hold them exactly."""
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter("id is not null and x is not null and size(x) > 0")

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
            ends = np.cumsum(np.concatenate([[0], np.asarray(column.value_lengths())]))
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            ids, dims, norms, data = [], [], [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                x = flat[ends[i] : ends[i + 1]]
                if np.isfinite(x).all():
                    top = np.abs(x).max()
                    ids.append(key)
                    dims.append(len(x))
                    norms.append(float(np.sqrt(np.sum((x / top) ** 2)) * top) if top else 0.0)
                    data.append(x.astype("<f8").tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(data, pa.binary())], ["id", "dim", "norm", "data"])

    return source.mapInArrow(run, "id long, dim int, norm double, data binary")


def blocks(found: DataFrame, most: int, by_length: bool) -> DataFrame:
    """Packs the vectors of each partition into blocks of at most `most` rows and about 8 MB, longest first in each."""

    def pack(dim: int, rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: -r[1])
        ids = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([rows[0][1]]), pa.array([ids.tobytes()]), pa.array([b"".join(r[2] for r in rows)])], ["dim", "n", "longest", "ids", "data"])

    def run(batches):
        open_: dict[tuple[int, int], list] = {}
        held = 0
        for batch in batches:
            for key, dim, norm, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                cell = (dim, int(np.floor(2 * np.log2(norm))) if by_length and norm > 0 else -9999)
                rows = open_.setdefault(cell, [])
                rows.append((key, norm, data))
                held += len(data)
                if len(rows) >= most or len(rows) * len(data) >= 8 << 20:
                    held -= sum(len(r[2]) for r in rows)
                    yield pack(dim, open_.pop(cell))
                elif held > 64 << 20:  # many kinds of vectors: close the fullest
                    cell = max(open_, key=lambda c: len(open_[c]))
                    held -= sum(len(r[2]) for r in open_[cell])
                    yield pack(cell[0], open_.pop(cell))
        for (dim, _), rows in open_.items():
            yield pack(dim, rows)

    return found.mapInArrow(run, _BLOCK)


def _unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<f8").reshape(-1, dim)
    top = np.abs(x).max(axis=1, initial=0)
    safe = np.where(top > 0, top, 1)[:, None]
    return np.frombuffer(ids, np.int64), x, np.sqrt(((x / safe) ** 2).sum(axis=1)) * top


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles where all sums stay below 2**53, else Python integers."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if bound < _EXACT:
        return q @ v.T
    whole = [[int(x) for x in row] for row in v.tolist()]
    out = np.empty((len(q), len(v)), object)
    for i, row in enumerate(q.tolist()):
        a = [int(x) for x in row]
        for j, b in enumerate(whole):
            out[i, j] = sum(map(int.__mul__, a, b))
    return out


#: Local cosine threshold from which a coordinate is looked at before products are made.
COORDINATE_FROM = 0.8
_SLACK = 1e-9


def search(q_ids, q, q_norm, least, v_ids, v, v_norm, k: int) -> list[tuple[int, int, int]]:
    """(query, vec, score): at least those of each query's k best in this block that reach its lower bound."""
    out = []
    longest = v_norm.max(initial=0)
    reach = q_norm * longest * (1 + _SLACK)
    alive = np.flatnonzero(reach >= least)
    if not len(alive):
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach[alive] > 0, least[alive] / reach[alive], -1.0)
        need = np.where(q_norm[alive] > 0, least[alive] / (q_norm[alive] * (1 + _SLACK)), -np.inf)
    order = np.argsort(-v_norm, kind="stable")
    v_ids, v, v_norm = v_ids[order], v[order], v_norm[order]
    prefix = np.searchsorted(-v_norm, -need, "right")
    steep = local >= COORDINATE_FROM

    def best(i: int, where: np.ndarray, scores: np.ndarray) -> None:
        ids = v_ids[where]
        fit = ids != q_ids[i]
        ids, scores = ids[fit], scores[fit]
        if len(scores) > k and scores.dtype != object:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            top = scores >= max(cut, least[i])
            ids, scores = ids[top], scores[top]
        for j in np.lexsort((ids, [-s for s in scores.tolist()]))[:k] if len(ids) else ():
            out.append((int(q_ids[i]), int(ids[j]), int(scores[j])))

    dense = np.flatnonzero(~steep)
    for at in range(0, len(dense), 256):
        part = dense[at : at + 256]
        upto = int(prefix[part].max(initial=0))
        scores = products(q[alive[part]], v[:upto])
        for row, p in zip(scores, part):
            n = int(prefix[p])
            best(alive[p], np.arange(n), row[:n])
    unit = v / np.where(v_norm > 0, v_norm, 1)[:, None] if steep.any() else None
    for p in np.flatnonzero(steep):
        i, n, t = alive[p], int(prefix[p]), min(local[p], 1.0)
        f = int(np.abs(q[i]).argmax())
        c = q[i, f] / q_norm[i]
        middle, width = c * t, np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - t * t))
        # a cosine of t or more leaves the coordinate between cos(a + b) and cos(a - b), or up to 1 beyond c > t
        low = middle - width - 1e-7 if c > -t else -1.0 - 1e-7
        high = middle + width + 1e-7 if c < t else 1.0 + 1e-7
        where = np.flatnonzero((unit[:n, f] >= low) & (unit[:n, f] <= high))
        if len(where):
            best(i, where, products(q[i : i + 1], v[where])[0])
    return out


def grid(v: DataFrame, q: DataFrame) -> DataFrame:
    """Each block of rows beside each block of queries that it can hold a result for: a stated query set against all rows, in blocks.

    v: the blocks; q: the queries' blocks with `need`, the length from which a vector can be a result for one of them.
    """
    octave = F.when(F.col("longest") > 0, F.floor(2 * F.log2("longest"))).otherwise(-9999)
    v = v.withColumn("kind", F.pmod(F.xxhash64("dim", octave), F.lit(KINDS)).cast("int")).withColumn("h", F.xxhash64("ids"))
    kinds = v.groupBy("kind").agg(F.count("*").alias("c"), F.max("longest").alias("longest"), F.min("dim").alias("low"), F.max("dim").alias("high")).collect()  # KINDS rows at most
    blocks_, groups = sum(r["c"] for r in kinds), max(1, -(-q.count() // GROUP))
    size = max(1, blocks_ // CELLS)
    first, cells, known = 0, {}, []
    for r in sorted(kinds, key=lambda r: r["kind"]):
        n = -(-r["c"] // size)
        cells[r["kind"]] = (first, n)
        known.append((first, n, r["longest"] * (1 + _SLACK), r["low"], r["high"]))
        first += n
    spark = v.sparkSession
    place = F.broadcast(spark.createDataFrame([(k, *c) for k, c in cells.items()], "kind int, first int, cells int"))
    reach = F.broadcast(spark.createDataFrame(known, "first int, cells int, reach double, low int, high int"))
    v = v.join(place, "kind").withColumn("cell", F.col("first") + F.pmod("h", "cells").cast("int"))
    v = v.select("dim", "ids", "data", "cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    q = q.join(reach, (F.col("q_dim") >= F.col("low")) & (F.col("q_dim") <= F.col("high")) & (F.col("reach") >= F.col("need")))
    q = q.withColumn("group", F.pmod(F.xxhash64("q_ids"), F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence("first", F.col("first") + F.col("cells") - 1)))
    parts = max(1, min(first * groups, 8192))
    v, q = v.repartition(parts, "cell", "group"), q.select("q_dim", "q_ids", "q_data", "least", "cell", "group").repartition(parts, "cell", "group")
    return v.hint("merge").join(q, ["cell", "group"]).select("dim", "ids", "data", "q_dim", "q_ids", "q_data", "least")


def top_k(rows: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, block: int = 4096, probe: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by `every`."""
    scratch = Scratch(rows.sparkSession, "topk", rows)
    found = scratch.put(vectors(rows, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    v = scratch.put(blocks(found.select("id", "dim", "norm", "data"), block, True), "blocks")
    wanted = found.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "data", "norm")).alias("r")).select("id", "r.dim", "r.norm", "r.data")
    wanted = scratch.put(wanted, "wanted")
    q = scratch.put(blocks(wanted.repartition(max(1, -(-wanted.count() // block))), block, False), "queries")
    longest = blocks(found.orderBy(F.desc("norm"), "id").limit(probe).coalesce(1), probe, False)
    longest = scratch.put(longest, "probe").select(*(F.col(c).alias(f"p_{c}") for c in ("dim", "ids", "data")))

    def bounds(batches):
        """Each query block with its k-th scores against the probe."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, x, norm = _unpack(r["dim"], r["ids"], r["data"])
                least = np.full(len(ids), -np.inf)
                if r["p_data"] is not None:
                    p_ids, p, _ = _unpack(r["dim"], r["p_ids"], r["p_data"])
                    for at in range(0, len(ids), 512):
                        s = np.asarray(products(x[at : at + 512], p), np.float64)
                        s[ids[at : at + 512, None] == p_ids[None, :]] = -np.inf
                        if s.shape[1] >= k:
                            least[at : at + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                least -= np.abs(least) * 1e-12
                least[~np.isfinite(least)] = -1e300
                need = float(np.min(np.where(norm > 0, least / np.where(norm > 0, norm, 1), -1e300)))
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["ids"]]), pa.array([r["data"]]), pa.array([least.tobytes()]), pa.array([need])], ["q_dim", "q_ids", "q_data", "least", "need"])

    first = longest.groupBy("p_dim").agg(F.min(F.struct("p_ids", "p_data")).alias("p")).select("p_dim", "p.*")
    q = scratch.put(q.join(first, F.col("dim") == F.col("p_dim"), "left").select("dim", "ids", "data", "p_ids", "p_data").mapInArrow(bounds, "q_dim int, q_ids binary, q_data binary, least binary, need double"), "bounds")

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] != r["q_dim"]:
                    continue
                q_ids, x, q_norm = _unpack(r["dim"], r["q_ids"], r["q_data"])
                v_ids, y, v_norm = _unpack(r["dim"], r["ids"], r["data"])
                hits = search(q_ids, x, q_norm, np.frombuffer(r["least"], np.float64), v_ids, y, v_norm, k)
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], ["query_id", "vec_id", "score"])

    near = grid(v, q).mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
