"""Approximate nearest neighbours by inner product with vantage-point trees.

Vectors are dealt to shards by a hash of their id, and each shard is indexed by a tree of its own. Inner
products become distances by one more component: with M the largest norm, x is placed at (x, sqrt(M^2 -
|x|^2)) and a query at (q, 0), so that the squared distance is |q|^2 + M^2 - 2 q.x. A node of the tree has a
vantage point and splits its vectors at the median distance to it. By the triangle inequality a side can't
hold anything nearer than the gap between the query's distance and that side's range of distances. A side is
left out if the gap times `factor` exceeds the distance of the worst neighbour kept: with factor 1 the search
is exact, larger factors leave out more.

A shard's queries walk its tree together, in blocks; each visits its nearer side first. Scores are computed
in double precision on the original vectors, and the best of all shards are merged by query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, ship
from lodgetier.runtime import materialise

#: Vectors of a shard and queries of a block, about; vectors of a leaf.
SHARD_ROWS = 8_192
QUERY_ROWS = 2_048
LEAF_ROWS = 256
FACTOR = 1.0


def valid(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, every component finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(F.col(vector), lambda x: x != 0)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components: equal vectors get equal scores."""
    out = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        out += queries[:, k] * rows[:, k]
    return out


def build(rows: np.ndarray, top: float, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, list[dict]]:
    """(order, nodes): the rows in tree order, and nodes that name ranges of it.

    A node has its vantage point, the range of distances of either side, and its two children; a leaf has
    a range of rows. Distances are those of the lifted vectors.
    """
    lifted = np.column_stack([rows, np.sqrt(np.maximum(top * top - (rows * rows).sum(axis=1), 0.0))])
    order = np.arange(len(rows))
    nodes: list[dict] = []
    todo = [(0, len(rows), -1, 0)]
    while todo:
        low, high, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent]["child"][side] = at
        if high - low <= leaf:
            nodes.append({"low": low, "high": high})
            continue
        mine = order[low:high]
        probe = lifted[mine[:: max(1, len(mine) // 32)]]
        spread = [np.linalg.norm(lifted[mine[:512]] - p, axis=1).std() for p in probe]  # a far-off point divides best
        point = probe[int(np.argmax(spread))]
        away = np.linalg.norm(lifted[mine] - point, axis=1)
        rank = np.argsort(away, kind="stable")
        order[low:high], away = mine[rank], away[rank]
        mid = len(away) // 2
        nodes.append({
            "point": point.tolist(), "child": [-1, -1],
            "range": [[float(away[0]), float(away[mid - 1])], [float(away[mid]), float(away[-1])]],
        })
        todo += [(low, low + mid, at, 0), (low + mid, high, at, 1)]
    return order, nodes


class Search:
    """The best k of one shard's rows for a block of queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: list[dict], top: float, k: int, factor: float):
        self.ids, self.rows, self.nodes, self.top, self.k, self.factor = ids, rows, nodes, top, k, factor

    def run(self, names: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), a row per query, best first, ties by id; missing ones have score -inf."""
        n = len(queries)
        self.names, self.queries = names, queries
        self.lifted = np.column_stack([queries, np.zeros(n)])
        self.square = (queries * queries).sum(axis=1) + self.top * self.top
        self.best = np.full((n, self.k), -np.inf)
        self.found = np.full((n, self.k), np.iinfo(np.int64).max)
        if self.nodes:
            self._visit(0, np.arange(n))
        return self.found, self.best

    def _visit(self, at: int, some: np.ndarray) -> None:
        node = self.nodes[at]
        if not len(some):
            return
        if "low" in node:
            self._leaf(node["low"], node["high"], some)
            return
        away = np.linalg.norm(self.lifted[some] - np.array(node["point"]), axis=1)
        gaps = [np.maximum(np.maximum(low - away, away - high), 0.0) for low, high in node["range"]]
        first = gaps[1] < gaps[0]
        for side in (0, 1):  # the nearer side of every query, then the other
            self._enter(node["child"][side], some[first == side], gaps[side][first == side])
        for side in (0, 1):
            self._enter(node["child"][side], some[first != side], gaps[side][first != side])

    def _enter(self, child: int, some: np.ndarray, gap: np.ndarray) -> None:
        worst = self.best[some, -1]
        reach = np.sqrt(np.maximum(self.square[some] - 2 * worst, 0.0))  # infinite until k are found
        self._visit(child, some[gap * self.factor <= reach * (1 + 1e-9) + 1e-9])

    def _leaf(self, low: int, high: int, some: np.ndarray) -> None:
        ids = self.ids[low:high]
        rough = self.queries[some] @ self.rows[low:high].T
        slack = 1e-9 * (1 + self.square[some])
        hit = rough >= (self.best[some, -1] - slack)[:, None]
        hit &= self.names[some][:, None] != ids  # not itself
        better = hit.any(axis=1)
        some, hit = some[better], hit[better]
        if not len(some):
            return
        at, row = np.nonzero(hit)
        near = np.full(hit.shape, -np.inf)
        near[at, row] = exact(self.queries[some[at]], self.rows[low + row])
        value = np.concatenate([self.best[some], near], axis=1)
        name = np.concatenate([self.found[some], np.broadcast_to(ids, near.shape)], axis=1)
        name[value == -np.inf] = np.iinfo(np.int64).max
        rank = np.lexsort((name, -value), axis=1)[:, : self.k]
        self.best[some] = np.take_along_axis(value, rank, axis=1)
        self.found[some] = np.take_along_axis(name, rank, axis=1)


def _blocks(vectors: DataFrame, per_block: int, n: int) -> DataFrame:
    """(dim, block, ids, data): vectors of one length gathered in blocks of about `per_block`, by a hash of their id."""
    count = max(1, -(-n // per_block))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(count)).cast("int"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        data = np.array(frame["vector"].tolist(), dtype=np.float64).tobytes()
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "data": [data]})

    return placed.groupBy("dim", "block").applyInPandas(run, "dim int, block int, ids binary, data binary")


def index(vectors: DataFrame, top: float, n: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its vectors in tree order and its tree. Every vector is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = np.frombuffer(row["data"]).reshape(-1, row["dim"])
                order, nodes = build(rows, top)
                ids = np.frombuffer(row["ids"], np.int64)[order]
                out.append((row["dim"], row["block"], ids.tobytes(), rows[order].tobytes(), json.dumps(nodes)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "shard", "ids", "data", "tree"])

    return map_batches(_blocks(vectors, shard_rows, n), run, "dim int, shard int, ids binary, data binary, tree string")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of `vectors` for each of `queries`, both (vec_id, embedding).

    Nearest is the largest inner product; ties go to the smaller vec_id, a query's own vec_id is left out, and
    fewer than k candidates give as many rows. Vectors that are null, zero, or hold null, NaN or infinite
    components take no part, nor do rows without vec_id; only vectors of one length meet. Repeated vectors are
    candidates each. Rows repeated under one vec_id are taken once. Without a valid query the result is empty.
    """
    ship(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        cast = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        some = cast.where(valid("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        return some.withColumn("dim", F.size("vector"))

    rows = materialise(clean(vectors), "vectors")
    asked = materialise(clean(queries), "queries")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, square = rows.agg(F.count("*"), F.max(norm)).first()
    asked_n = asked.count()
    top = float(square or 0.0) ** 0.5 * (1 + 1e-12)
    shards = materialise(index(rows, top, n, shard_rows), "index")
    blocks = materialise(_blocks(asked, query_rows, asked_n).withColumnsRenamed({"block": "_q", "ids": "q_ids", "data": "q_data"}), "blocks")
    count, asked_count = max(1, -(-n // shard_rows)), max(1, -(-asked_n // query_rows))
    everywhere = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    meeting = shards.join(everywhere.hint("merge"), ["dim", "shard"]).repartition(min(20_000, count * asked_count), "shard", "_q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                names = np.frombuffer(row["q_ids"], np.int64)
                search = Search(
                    np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"]).reshape(-1, row["dim"]),
                    json.loads(row["tree"]), top, k, factor,
                )
                found, best = search.run(names, np.frombuffer(row["q_data"]).reshape(-1, row["dim"]))
                ok = best > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(found[ok]), pa.array(best[ok])],
                    ["query_id", "vec_id", "score"],
                )

    found = map_batches(meeting, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbour_table(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of all rows of `embeddings` for those whose vec_id `every` divides."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % every == 0), k)
