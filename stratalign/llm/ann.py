"""Approximate nearest neighbours by inner product.

Distinct vectors are dealt over shards.  A shard's index is a hierarchical
navigable small-world graph: levels drawn geometrically, on each level a fixed
number of diverse neighbours, all as flat arrays.  It is built by insertion, from
the top level down and on each level block by block: the vectors of a block are
searched in what the level holds already, as queries are later, and linked with what
they find and with one another; a vector whose list is full chooses anew.  Each
shard is read by one task, past which all blocks of queries are streamed; the shards'
results are merged.

Vectors that are null, zero, or hold null or non-finite components take no
part, and only vectors of the query's dimension are compared.  Of equal vectors
one stands in the graph with the ``k + 1`` smallest ids: with the query itself
left out, no other copy can be among its k nearest.  Null ids take no part;
repeated rows (one id, one vector) count once.  Ties in the score go to the
smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import Scratch, keep_columns

_VECTORS = pa.schema([("dim", pa.int32()), ("key", pa.binary()), ("ids", pa.list_(pa.int64()))])
_VECTORS_DDL = "dim int, key binary, ids array<long>"
#: Rows of a shard: parts of its arrays by name, then blocks of queries (ids in place of the name's part).
_PARTS = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("place", pa.int64()), ("name", pa.string()), ("data", pa.binary()), ("query_ids", pa.binary())])
_PARTS_DDL = "dim int, shard int, place long, name string, data binary, query_ids binary"
_PART_BYTES = 4 << 20
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


def valid(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, or None where it takes no part."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    out = np.array(vector, np.float64)
    return out if np.isfinite(out).all() and out.any() else None


def _local(most: int):
    """Equal vectors of a partition become one row with their smallest ids."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list[int]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            keys = list(groups)
            for start in range(0, len(keys), 4096):
                part = keys[start : start + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([len(k) // 8 for k in part], pa.int32()), pa.array(part, pa.binary()), pa.array([sorted(set(groups[k]))[:most] for k in part], pa.list_(pa.int64()))], schema=_VECTORS)
            groups.clear()

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = valid(vector)
                if value is None or vec_id is None:
                    continue
                ids = groups.setdefault((value + 0.0).tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 4 * most:
                    ids[:] = sorted(set(ids))[:most]
            if len(groups) > 50_000:
                yield from rows()
        yield from rows()

    return local


def distinct_vectors(df: DataFrame, most: int, id_col: str = "vec_id", vector_col: str = "embedding", salts: int = 16) -> DataFrame:
    """dim, key (the vector's doubles), ids (its smallest ids).  Copies meet first within partitions, then within
    salts, so that no task gets more than a few rows of any vector."""
    rows = keep_columns(df, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    local = rows.mapInArrow(_local(most), _VECTORS_DDL)
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    salted = local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.groupBy("dim", "key", "salt").agg(merged).groupBy("dim", "key").agg(merged)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, breadth: int, per_round: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best nodes found and their scores, from its entry nodes (-1 for none) on.  All queries of a
    block step together: in each round every query opens its best unopened nodes, until none of those is left
    in its beam."""
    q, n = len(queries), len(vectors)
    breadth = min(breadth, n)
    seen = np.zeros((q, n + 1), bool)  # the last column takes what is no node
    seen[:, n] = True
    every = np.arange(q)[:, None]

    def scored(nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Nodes without those that their query has seen; they count as seen from now on."""
        nodes = np.sort(np.where(nodes >= 0, nodes, n), axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = n
        nodes = np.where(seen[of, nodes], n, nodes)
        seen[of, nodes] = True
        return nodes

    def scores_of(nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.full(nodes.shape, -np.inf, np.float32)
        rows, columns = np.nonzero(nodes < n)
        out[rows, columns] = np.einsum("ij,ij->i", np.take(vectors, nodes[rows, columns], axis=0), np.take(queries, of[rows, 0], axis=0))
        return out

    def best_of(nodes: np.ndarray, score: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if nodes.shape[1] > breadth:
            best = np.argpartition(-score, breadth - 1, axis=1)[:, :breadth]
            return tuple(np.take_along_axis(x, best, 1) for x in (nodes, score, opened))
        wide = ((0, 0), (0, breadth - nodes.shape[1]))
        return np.pad(nodes, wide, constant_values=n), np.pad(score, wide, constant_values=-np.inf), np.pad(opened, wide, constant_values=True)

    first = scored(entry, every)
    beam, score, opened = best_of(first, scores_of(first, every), first == n)
    active = np.arange(q)
    few = min(per_round, breadth)
    while len(active):
        masked = np.where(opened[active], -np.inf, score[active])
        pick = np.argpartition(-masked, few - 1, axis=1)[:, :few]
        good = np.isfinite(np.take_along_axis(masked, pick, 1))
        some = good.any(1)
        active, pick, good = active[some], pick[some], good[some]
        if not len(active):
            break
        opened[active[:, None], pick] = True
        nodes = beam[active[:, None], pick]
        fresh = np.where(good[:, :, None], links[np.where(good, nodes, 0)], -1).reshape(len(active), -1)
        fresh = scored(fresh, active[:, None])
        values = scores_of(fresh, active[:, None])
        beam[active], score[active], opened[active] = best_of(np.c_[beam[active], fresh], np.c_[score[active], values], np.c_[opened[active], fresh == n])
    return np.where(np.isfinite(score), beam, -1), score


def choose_diverse(vectors: np.ndarray, nodes: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each line's nodes (-1 for none), best first, those closer to the line's own vector than to any node
    chosen before; then the best others while there is room."""
    order = np.argsort(-score, axis=1, kind="stable")
    nodes, score = np.take_along_axis(nodes, order, 1), np.take_along_axis(score, order, 1)
    held = vectors[np.maximum(nodes, 0)]
    near = held @ held.transpose(0, 2, 1)
    chosen = np.zeros(nodes.shape, bool)
    count = np.zeros(len(nodes), np.int64)
    for k in range(nodes.shape[1]):
        takes = (nodes[:, k] >= 0) & (count < most) & ~((near[:, k] >= score[:, k, None]) & chosen).any(1)
        chosen[:, k] = takes
        count += takes
    first = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(nodes, first, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(vectors: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Adds the links target - source; a target whose list would be too long chooses anew."""
    most = links.shape[1]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nodes, first, times = np.unique(targets, return_index=True, return_counts=True)
    filled = (links[nodes] >= 0).sum(1)
    within = np.arange(len(targets)) - np.repeat(first, times)
    fits = filled + times <= most
    plain = np.repeat(fits, times)
    links[targets[plain], np.repeat(filled, times)[plain] + within[plain]] = sources[plain]
    over = np.flatnonzero(~fits)
    for start in range(0, len(over), 64):
        part = over[start : start + 64]
        wide = np.full((len(part), most + int(times[part].max())), -1)
        wide[:, :most] = links[nodes[part]]
        for row, k in enumerate(part.tolist()):
            wide[row, most : most + times[k]] = sources[first[k] : first[k] + times[k]]
        score = np.where(wide >= 0, np.einsum("ijk,ik->ij", vectors[np.maximum(wide, 0)], vectors[nodes[part]]), -np.inf)
        links[nodes[part]] = choose_diverse(vectors, wide, score, most)


def _entries(vectors: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, breadth: int = 8) -> np.ndarray:
    """Where to enter the level below graph, the upper levels from the top on: what a narrow search finds on each."""
    found = np.zeros((len(queries), 1), np.int64)
    for links in graph:
        found, _ = beam_search(vectors[: len(links)], links, queries, np.c_[found, np.broadcast_to(np.arange(min(4, len(links))), (len(queries), min(4, len(links))))], breadth)
    return found


def build_graph(vectors: np.ndarray, width: int = 24, breadth: int = 96, block: int = 256, seed: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the vectors in which each level has the first so many, and the levels' links, the top one first.

    Vectors are lengthened to equal norms, so that inner product and distance agree and no long vector draws
    every link.
    """
    n, random = len(vectors), np.random.default_rng(seed)
    level_of = np.minimum(np.floor(-np.log(1 - random.random(n)) / np.log(width)).astype(np.int64), 8)
    order = np.lexsort((random.random(n), -level_of))
    norms = (vectors**2).sum(1)
    even = np.c_[vectors, np.sqrt(np.maximum(norms.max() - norms, 0))].astype(np.float32)[order]
    graph: list[np.ndarray] = []
    for level in range(int(level_of.max()), -1, -1):
        size = int((level_of >= level).sum())
        links = np.full((size, width if level else 2 * width), -1, np.int32)
        done = 0
        while done < size:
            end = min(size, done + min(max(done, 32), block))
            new = np.arange(done, end)
            inner = even[new] @ even[new].T
            np.fill_diagonal(inner, -np.inf)
            close = np.argsort(-inner, axis=1, kind="stable")[:, : min(16, len(new) - 1)]
            nodes, score = new[close], np.take_along_axis(inner, close, 1)
            if done:
                entry = _entries(even, graph, even[new])
                entry = np.c_[np.where(entry < done, entry, -1), np.broadcast_to(np.arange(min(8, done)), (len(new), min(8, done)))]
                found, its_score = beam_search(even[:done], links[:done], even[new], entry, breadth)
                nodes, score = np.c_[nodes, found], np.c_[score, its_score]
            if nodes.shape[1]:
                links[new, :width] = choose_diverse(even, nodes, score, width)
                rows, columns = np.nonzero(links[new] >= 0)
                # Members of the block may have chosen one another: their lists hold each other already.
                target, source = links[new[rows], columns].astype(np.int64), new[rows]
                known = target >= done
                known[known] = (links[target[known]] == source[known, None]).any(1)
                _link_back(even, links, source[~known], target[~known])
            done = end
        graph.append(links)
    return order, graph


def _index(width: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dim, key, ids, shard) sorted by shard and dimension."""
        held: list[tuple[bytes, list[int]]] = []
        current: tuple[int, int] | None = None  # shard, dim

        def built() -> Iterator[pa.RecordBatch]:
            shard, dim = current
            rows = sorted(held)
            vectors = np.frombuffer(b"".join(k for k, _ in rows), np.float64).reshape(len(rows), dim)
            order, graph = build_graph(vectors, width)
            ids = [np.array(rows[k][1], np.int64) for k in order.tolist()]
            arrays = {"vectors": vectors[order], "ids": np.concatenate(ids), "counts": np.array([len(i) for i in ids], np.int64)}
            place = 0
            for name, array in [*arrays.items(), *((f"links {x.shape[1]}", x) for x in graph)]:
                raw = np.ascontiguousarray(array).tobytes()
                for start in range(0, len(raw), _PART_BYTES):
                    label = name if start == 0 else ""  # what follows belongs to the array before
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((dim, shard, place, label, raw[start : start + _PART_BYTES], None), _PARTS, strict=True)], schema=_PARTS)
                    place += 1

        for batch in batches:
            for dim, key, ids, shard in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (shard, dim) != current:
                    if held:
                        yield from built()
                    held, current = [], (shard, dim)
                held.append((key, ids))
        if held:
            yield from built()

    return index


class Shard:
    """One shard's graph, ready for searches, from its arrays by name in order."""

    def __init__(self, dim: int, arrays: list[tuple[str, bytes]]):
        named = dict(arrays[:3])
        self.vectors = np.frombuffer(named["vectors"], np.float64).reshape(-1, dim)
        self.quick = self.vectors.astype(np.float32)
        self.ids, self.begin = np.frombuffer(named["ids"], np.int64), np.r_[0, np.cumsum(np.frombuffer(named["counts"], np.int64))]
        self.graph = [np.frombuffer(raw, np.int32).reshape(-1, int(name.split()[1])) for name, raw in arrays[3:]]

    def search(self, queries: np.ndarray, breadth: int) -> list[np.ndarray]:
        """For each query the nodes of its final beam."""
        quick = queries.astype(np.float32)
        entry = _entries(self.quick, self.graph[:-1], quick)
        first = min(len(self.graph[0]), breadth // 2)  # the top level's members enter too: separate parts are reached
        entry = np.c_[entry, np.broadcast_to(np.arange(first), (len(queries), first))]
        found, _ = beam_search(self.quick, self.graph[-1], quick, entry, breadth)
        return [f[f >= 0] for f in found]


def _search(k: int, breadth: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by dimension, shard and place: a shard's arrays, then blocks of queries."""
        current, arrays, shard = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["shard"]) != current:
                    current, arrays, shard = (row["dim"], row["shard"]), [], None
                if row["query_ids"] is None:
                    if row["name"]:
                        arrays.append((row["name"], row["data"]))
                    else:
                        arrays[-1] = (arrays[-1][0], arrays[-1][1] + row["data"])
                    continue
                if shard is None:
                    if not arrays:
                        continue  # no vector of this dimension in this shard
                    shard, arrays = Shard(row["dim"], arrays), []
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                queries = np.frombuffer(row["data"], np.float64).reshape(len(query_ids), -1)
                for start in range(0, len(queries), 256):
                    out = []
                    for q, nodes in enumerate(shard.search(queries[start : start + 256], breadth), start):
                        exact = shard.vectors[nodes] @ queries[q]
                        pairs = [(-s, int(i)) for s, node in zip(exact.tolist(), nodes.tolist(), strict=True) for i in shard.ids[shard.begin[node] : shard.begin[node + 1]] if i != query_ids[q]]
                        out += [(int(query_ids[q]), i, -s) for s, i in sorted(pairs)[:k]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return search


def _blocks(rows_a_block: int):
    schema = pa.schema([("dim", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in rows], np.int64).tobytes()], pa.binary()), pa.array([b"".join(v for _, v in rows)], pa.binary())], schema=schema)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = valid(vector)
                if value is None:
                    continue
                held.setdefault(len(value), []).append((vec_id, value.tobytes()))
                if len(held[len(value)]) >= rows_a_block:
                    yield block(len(value))
        for dim in sorted(held):
            yield block(dim)

    return blocks


def build_index(df: DataFrame, scratch: Scratch, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, width: int = 24) -> tuple[DataFrame, int]:
    """The shards' vectors, ids and flat neighbour arrays in parts, and the number of shards."""
    distinct = scratch.save(distinct_vectors(df, k + 1, id_col, vector_col), "distinct")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.select("dim", "key", "ids", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartition(2 * shards, "shard").sortWithinPartitions("shard", "dim")
    index = scratch.save(dealt.mapInArrow(_index(width), _PARTS_DDL), "index")
    scratch.drop("distinct")
    return index, shards


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, width: int = 24, breadth: int = 192, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df found for each row of queries, itself left out."""
    scratch = Scratch(df.sparkSession, "ann")
    index, shards = build_index(df, scratch, k, id_col, vector_col, shard_rows, width)
    asked = keep_columns(queries, vec_id=id_col, vector=vector_col).filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>")).distinct()
    blocks = asked.mapInArrow(_blocks(block_rows), "dim int, query_ids binary, queries binary")
    # Every shard gets every block once, after its own parts; a shard itself is moved once, whatever the blocks.
    to_all = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit((1 << 63) - 1).cast("long").alias("place"), F.lit("").alias("name"), F.col("queries").alias("data"), "query_ids")
    dealt = index.unionByName(to_all).repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "place")
    found = dealt.mapInArrow(_search(k, breadth), _FOUND_DDL)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
