"""Approximate nearest neighbours with a navigable small-world graph per shard.

Equal vectors are merged first (each keeps the few smallest ids that an answer can need), so a
vector that a third of all rows share is one node.  Distinct vectors are dealt to shards by hash.
A shard inserts its vectors one by one into a hierarchical small-world graph: levels by a hash of the
vector, a greedy descent to the vector's level, a beam search in each level below, and neighbours
chosen so that none is nearer to another chosen one than to the new vector.  The graph is stored as
flat neighbour arrays, one row per level.  Every query is searched in every shard, in blocks of
bounded size, and the shards' answers are merged and scored again in double precision.

Defined results: rows without a vec_id and vectors that are null, empty, zero, or hold a null or non-finite component take no
part, neither as queries nor as candidates; vectors of other lengths than the query's are no
candidates of it; ties go to the smaller id; rows with one id and different vectors are separate
candidates; a table with no valid rows gives no rows.  Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

SHARD_ROWS = 4000
QUERY_ROWS = 10_000
LINKS = 12
BEAM_BUILD = 64
BEAM_SEARCH = 128
SALTS = 64


def usable(vector: Column) -> Column:
    """True for a vector of finite components that are not all zero."""
    inf = F.lit(float("inf"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, sound) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


class Graph:
    """A small-world graph over unit vectors: per level an array of neighbour lists."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, flat: list[np.ndarray] | None = None):
        self.unit = unit
        self.levels = levels
        self.entry = int(levels.argmax()) if len(levels) else -1
        self.flat = flat or []

    @classmethod
    def build(cls, unit: np.ndarray, levels: np.ndarray) -> Graph:
        self = cls(unit, levels)
        n, top = len(unit), int(levels.max()) if len(levels) else 0
        self.flat = [
            np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(top + 1)
        ]
        self.entry = 0
        for node in range(1, n):
            self._insert(node)
        return self

    def _nearest(self, query: np.ndarray, entry: list[int], level: int, beam: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest that a best-first search of one level finds, nearest first."""
        unit, flat = self.unit, self.flat[level]
        seen = np.zeros(len(unit), bool)
        seen[entry] = True
        start = [(-float(s), e) for s, e in zip(unit[entry] @ query, entry)]
        open_ = list(start)
        heapq.heapify(open_)
        best = [(-d, e) for d, e in start]
        heapq.heapify(best)
        while open_:
            distance, node = heapq.heappop(open_)
            if len(best) >= beam and -distance < best[0][0]:
                break
            around = flat[node]
            around = around[around >= 0]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            scores = unit[around] @ query
            if len(best) >= beam:
                better = scores > best[0][0]
                around, scores = around[better], scores[better]
            for score, other in zip(scores.tolist(), around.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (score, other))
                elif score > best[0][0]:
                    heapq.heapreplace(best, (score, other))
                else:
                    continue
                heapq.heappush(open_, (-score, other))
        return sorted(best, reverse=True)

    def _choose(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates, nearest first, that are nearer to the new vector than to any chosen one."""
        nodes = [c[1] for c in candidates]
        between = self.unit[nodes] @ self.unit[nodes].T
        chosen: list[int] = []
        for i, (score, _) in enumerate(candidates):
            if len(chosen) == most:
                break
            if not chosen or between[i, chosen].max() < score:
                chosen.append(i)
        left = [i for i in range(len(nodes)) if i not in chosen]
        chosen += left[: most - len(chosen)]
        return [nodes[i] for i in chosen]

    def _link(self, level: int, node: int, others: list[int]) -> None:
        flat = self.flat[level]
        most = flat.shape[1]
        flat[node, : len(others)] = others
        for other in others:
            row = flat[other]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                continue
            around = [*row.tolist(), node]
            scores = self.unit[around] @ self.unit[other]
            order = np.argsort(-scores, kind="stable")
            ranked = [(float(scores[i]), around[i]) for i in order]
            row[:] = self._choose(ranked, most)

    def _insert(self, node: int) -> None:
        query, level = self.unit[node], int(self.levels[node])
        at, top = [self.entry], int(self.levels[self.entry])
        for upper in range(top, level, -1):
            at = [self._nearest(query, at, upper, 1)[0][1]]
        for lower in range(min(top, level), -1, -1):
            found = self._nearest(query, at, lower, BEAM_BUILD)
            self._link(lower, node, self._choose(found, LINKS))
            at = [f[1] for f in found]
        if level > top:
            self.entry = node

    def search(self, query: np.ndarray, count: int, beam: int = BEAM_SEARCH) -> list[int]:
        if not len(self.unit):
            return []
        at = [self.entry]
        for upper in range(int(self.levels[self.entry]), 0, -1):
            at = [self._nearest(query, at, upper, 1)[0][1]]
        return [node for _, node in self._nearest(query, at, 0, max(beam, count))[:count]]


def _units(vectors) -> np.ndarray:
    matrix = np.array([np.asarray(v, np.float64) for v in vectors])
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    matrix /= largest  # keeps the squares of huge components finite
    matrix /= np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix.astype(np.float32)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph, one row per level; nodes are the vectors in the order of their keys."""
    group = group.sort_values(["key", "first_id"], kind="stable").reset_index(drop=True)
    random = (group["key"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64)
    draw = (random + 1.0) / float(1 << 53)
    levels = np.minimum(12, (-np.log(draw) / np.log(LINKS)).astype(np.int64))
    graph = Graph.build(_units(group["vector"]), levels)
    shard, width = group["shard"].iloc[0], group["width"].iloc[0]
    rows = [
        (width, shard, level, levels.tolist(), list(group["key"]), list(group["vector"]), flat.shape[1], flat.ravel())
        if level == 0
        else (width, shard, level, None, None, None, flat.shape[1], flat.ravel())
        for level, flat in enumerate(graph.flat)
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in GRAPH_COLUMNS.split(", ")])


GRAPH_COLUMNS = (
    "width int, shard long, level int, levels array<long>, keys array<long>, "
    "vectors array<array<double>>, links int, flat array<int>"
)
FOUND_COLUMNS = "query_id long, query_key long, query_vector array<double>, key long, vector array<double>"


def _search(count: int):
    def work(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in FOUND_COLUMNS.split(", ")]
        if not len(graphs) or not len(queries):
            return pd.DataFrame(columns=columns, dtype=object)
        graphs = graphs.sort_values("level")
        base = graphs.iloc[0]
        levels = np.asarray(base["levels"], np.int64)
        flat = [np.asarray(f, np.int32).reshape(len(levels), w) for f, w in zip(graphs["flat"], graphs["links"])]
        graph = Graph(_units(base["vectors"]), levels, flat)
        graph.entry = int(levels.argmax())
        rows = []
        for row, unit in zip(queries.itertuples(), _units(queries["vector"])):
            for node in graph.search(unit, count):
                rows.append((row.query_id, row.key, row.vector, base["keys"][node], base["vectors"][node]))
        return pd.DataFrame(rows, columns=columns)

    return work


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return dot / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def index(rows: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(graphs, members): the shards' graphs, and per distinct vector its smallest ids.

    ``rows`` has vec_id and vector (double array).  An answer of ``count`` can need ``count + 1``
    ids of one vector, as the query's own is left out.
    """
    keyed = rows.withColumn("key", F.xxhash64("vector")).withColumn(
        "_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    )
    few = keyed.select("key", "vector", "vec_id", "_salt")
    for part in (["key", "vector", "_salt"], ["key", "vector"]):
        nth = F.row_number().over(W.partitionBy(*part).orderBy(F.col("vec_id").asc_nulls_last()))
        few = few.withColumn("_nth", nth).where(F.col("_nth") <= count + 1).drop("_nth")
    members = settle(few.drop("_salt"))
    distinct = members.groupBy("key", "vector").agg(F.min("vec_id").alias("first_id"))
    distinct = distinct.withColumn("width", F.size("vector"))
    shards = max(1, -(-distinct.count() // SHARD_ROWS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.lit(shards)))
    graphs = settle(dealt.groupBy("width", "shard").applyInPandas(_build, GRAPH_COLUMNS))
    return graphs, members


def nearest(vectors: DataFrame, queries: Column, count: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``count`` nearest found for each row of ``queries``."""
    sound = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        queries.alias("_asks"),
    )
    graphs, members = index(sound.select("vec_id", "vector"), count)
    asked = settle(
        sound.where("_asks").select(
            F.col("vec_id").alias("query_id"),
            F.xxhash64("vector").alias("key"),
            "vector",
            F.size("vector").alias("width"),
        )
    )
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    places = graphs.select(
        F.col("width").alias("in_width"), F.col("shard").alias("in_shard")
    ).distinct()
    spread = asked.withColumn("in_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(
        places, F.col("width") == F.col("in_width")
    )
    copies = graphs.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    shards = copies.groupBy("width", "shard", "block")
    searches = spread.groupBy("in_width", "in_shard", "in_block")
    found = settle(shards.cogroup(searches).applyInPandas(_search(count + 1), FOUND_COLUMNS))
    scored = found.select(
        "query_id", "query_key", "key", "vector", cosine(F.col("query_vector"), F.col("vector")).alias("score")
    )
    named = scored.join(members, ["key", "vector"]).where(F.col("vec_id") != F.col("query_id"))
    order = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= count)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
