"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

A shard's graph is a few flat arrays: vectors by insertion order (higher levels first, so that level l is the first
n_l vectors) and, for each level, an int32 neighbour array [n_l, m] filled up with -1. Vectors go in by batches; a
batch and the queries of a batch search in step, one numpy operation for all of them. Every shard answers every query,
and the shards' nearest k are merged. The bound on a shard keeps the recall of a search of fixed width.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm.common import checkpoint, pick

K = 10
M = 16
EF_BUILD = 64
EF_SEARCH = 64
SHARD_VECTORS = 16_384


class Graph:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, levels: list[np.ndarray]):
        self.vectors, self.ids, self.levels = vectors, ids, levels

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, **{f"level{i}": a for i, a in enumerate(self.levels)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return Graph(z["vectors"], z["ids"], [z[f"level{i}"] for i in range(len(z.files) - 2)])

    def search(self, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows [query, k], similarities), the nearest first; -1 where there are fewer."""
        n = len(self.vectors)
        rows, sims = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf, np.float32)
        for at in range(0, len(queries) if n else 0, 256):
            q = queries[at : at + 256]
            entry = np.zeros(len(q), np.int64)
            for level in range(len(self.levels) - 1, 0, -1):
                entry = _beam(self.vectors, self.levels[level], q, entry, 4)[0][:, 0]
            found, sim = _beam(self.vectors, self.levels[0], q, entry, max(ef, k))
            rows[at : at + 256], sims[at : at + 256] = found[:, :k], sim[:, :k]
        return rows, sims


def _beam(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef best rows that each query meets walking the graph from its entry, -1 where there are fewer."""
    b = np.arange(len(q))
    ids = np.full((len(q), ef), -1, np.int64)
    sim = np.full((len(q), ef), -np.inf, np.float32)
    fresh = np.zeros((len(q), ef), bool)
    seen = np.zeros((len(q), len(nbr) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids[:, 0], sim[:, 0], fresh[:, 0] = entry, np.einsum("bd,bd->b", q, x[entry]), True
    seen[b, entry] = True
    live = b
    while len(live):
        order = np.argsort(~fresh[live], axis=1, kind="stable")[:, :width]  # the best that aren't expanded
        open_ = fresh[live[:, None], order]
        fresh[live[:, None], order] = False
        new = np.where(open_[:, :, None], nbr[ids[live[:, None], order]], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        s = np.einsum("bd,bmd->bm", q[live], x[new])
        s[new < 0] = -np.inf
        s[s <= sim[live, -1:]] = -np.inf
        keep = np.flatnonzero((s > -np.inf).any(axis=1))
        if len(keep):
            rows = live[keep]
            all_ids = np.concatenate([ids[rows], new[keep]], axis=1)
            all_sim = np.concatenate([sim[rows], s[keep]], axis=1)
            all_fresh = np.concatenate([fresh[rows], s[keep] > -np.inf], axis=1)
            top = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
            r = np.arange(len(rows))[:, None]
            ids[rows], sim[rows], fresh[rows] = all_ids[r, top], all_sim[r, top], all_fresh[r, top]
        live = live[fresh[live].any(axis=1)]
    ids[sim == -np.inf] = -1
    return ids, sim


def _select(x: np.ndarray, base: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """m of each row's candidates (-1: none), spread out: one that is nearer to a chosen one than to the base waits,
    and only fills a place that is left. Nearest first."""
    sim = np.einsum("bd,bcd->bc", x[base], x[cand])
    sim[cand < 0] = -np.inf
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    between = np.einsum("bcd,bed->bce", x[cand], x[cand])
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        near = (between[:, j] > sim[:, j, None]) & chosen
        chosen[:, j] = ~near.any(axis=1) & (cand[:, j] >= 0) & (chosen.sum(axis=1) < m)
    order = np.argsort(np.where(chosen, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(cand, order, 1)


def build(vectors: np.ndarray, ids: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 0) -> Graph:
    """The graph over the rows of unit vectors; equal for equal input."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(m)).astype(int) if n else np.zeros(0, int)
    order = np.argsort(-level, kind="stable")
    x, level = np.ascontiguousarray(vectors[order], np.float32), level[order]
    count = [int((level >= lv).sum()) for lv in range(int(level[0]) + 1 if n else 1)]
    levels: list[np.ndarray] = [np.full((c, 2 * m if lv == 0 else m), -1, np.int32) for lv, c in enumerate(count)]
    for lv in range(len(levels) - 1, -1, -1):
        nbr, most, done = levels[lv], levels[lv].shape[1], 1
        while done < count[lv]:
            new = np.arange(done, min(count[lv], 2 * done, done + 256))
            entry = np.zeros(len(new), np.int64)
            for up in range(len(levels) - 1, lv, -1):
                entry = _beam(x, levels[up], x[new], entry, 4)[0][:, 0]
            entry = np.where(entry < done, entry, 0)
            cand, _ = _beam(x, nbr[:done], x[new], entry, ef)
            # the batch's own rows see each other: the nearest 8 of them are candidates, too
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1, kind="stable")[:, : min(8, len(new) - 1)]
            mine = _select(x, new, np.concatenate([cand, new[near]], axis=1), m)
            nbr[new, : mine.shape[1]] = mine
            _back(x, nbr, np.repeat(new, mine.shape[1]), mine.ravel(), most)
            done = int(new[-1]) + 1
    return Graph(x, np.asarray(ids)[order], levels)


def _back(x: np.ndarray, nbr: np.ndarray, source: np.ndarray, target: np.ndarray, most: int) -> None:
    """Adds source to the neighbours of each target; a full list is chosen anew from old and new ones."""
    ok = target >= 0
    source, target = source[ok], target[ok]
    sim = np.einsum("ed,ed->e", x[source], x[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    to, first, size = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, size)
    room = np.minimum(size, most).max()
    extra = np.full((len(to), room), -1, np.int64)
    fits = rank < room
    extra[np.repeat(np.arange(len(to)), size)[fits], rank[fits]] = source[fits]
    old = nbr[to].astype(np.int64)
    extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
    both = np.concatenate([old, extra], axis=1)
    used = (both >= 0).sum(axis=1)
    few = used <= most
    left = np.argsort(both < 0, axis=1, kind="stable")
    nbr[to[few]] = np.take_along_axis(both, left, 1)[few, :most]
    full = np.flatnonzero(~few)
    for at in range(0, len(full), 256):
        rows = full[at : at + 256]
        nbr[to[rows]] = _select(x, to[rows], both[rows], most)


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, ef: int = EF_SEARCH, m: int = M, ef_build: int = EF_BUILD, shard_vectors: int = SHARD_VECTORS, every: int = 1) -> DataFrame:
    """(id, rank, neighbour, similarity): for each vector whose id is divisible by `every` its k nearest others of all
    vectors by cosine, rank 1 the nearest; equal similarities go by the lesser id. Similarities are rounded to 6 decimals.

    Vectors that are null, empty, all zero, or have a null or non-finite entry have no direction: they neither ask nor
    answer. Neither do rows with a null id; of repeated ids the least vector counts. Vectors of different lengths are
    never compared. An empty table gives an empty result.

    One shuffle brings a shard's vectors to its task, and behind them the queries, of which each shard gets a copy. The
    task builds the graph and answers the queries as they stream by, so it holds one shard and a batch of queries,
    however many there are. Building grows with the vectors, answering with queries times shards."""
    v = pick(vectors, id=id_col, v=vector_col).where("id is not null and v is not null").select(F.col("id").cast("bigint"), F.col("v").cast("array<float>"))
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    v = v.where(good).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    v = checkpoint(v)
    shards = max(1, -(-v.count() // shard_vectors))
    own = v.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = v.where(F.col("id") % every == 0).select("dim", each.alias("shard"), F.lit(True).alias("asks"), "id", "v")
    met = own.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph, of = [], None, None
        for b in batches:
            for rows in _runs(b):
                key, asks = (rows.column("shard")[0].as_py(), rows.column("dim")[0].as_py()), rows.column("asks")[0].as_py()
                if key != of:
                    held, graph, of = [], None, key
                ids, x = rows.column("id").to_numpy(), _unit(rows.column("v"), key[1])
                if not asks:
                    held.append((x, ids))
                    continue
                if not held:
                    continue
                graph = graph or build(np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held]), m, ef_build)
                found, sims = graph.search(x, k + 1, ef)
                who, whom = np.repeat(ids, k + 1), graph.ids[found].ravel()
                some = (found.ravel() >= 0) & (who != whom)
                yield pa.record_batch([pa.array(who[some]), pa.array(whom[some]), pa.array(sims.ravel()[some].astype(np.float64))], names=["id", "neighbour", "similarity"])

    found = met.mapInArrow(run, "id bigint, neighbour bigint, similarity double").withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("id").alias(id_col), "rank", "neighbour", "similarity")


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's runs of rows of one shard and dimension that all ask or all answer."""
    if not b.num_rows:
        return
    key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "dim", "asks")])
    cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, b.num_rows]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield b.slice(a, z - a)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
