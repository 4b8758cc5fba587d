"""Approximate nearest neighbours by inner product: stable projections, kd-trees, and a chi-square stopping test.

Largest inner product becomes least distance: a vector gets one more component that brings its norm up to the greatest
one, a query is scaled to that norm. ``WIDTH`` Gaussian projections of such a vector are the index: the squared distance
of two projections is the squared distance of the vectors times a chi-square variable of ``WIDTH`` degrees. So a vector
nearer than the k-th found so far, at distance d, has its projection within ``bound(CHANCE) * d * d`` of the query's with
probability ``CHANCE`` at least, and a search stops when no projection is left within that: every true neighbour is found
with that probability, whatever the data. Where distances hardly differ, as in noise, much of the table is verified.

A kd-tree over a bounded sample of projections (about ``SAMPLE`` rows, at most ``CELLS`` leaves; the only thing that is
fitted) deals all rows into cells. A cell's rows stand in blocks of about ``BLOCK``, each with a kd-tree of its own, whose
leaves are boxes around their projections. A query searches the first block of its nearest cell, which gives its k-th
distance a first bound, and then every block of the cells whose boxes pass the test. In a block, leaves are taken by
rising distance of their boxes and their projections that pass are verified, and the bound falls, until no leaf passes.
Queries meet a block in groups of about ``GROUP``, so a task holds a block and a group whatever the sizes are.

Scores are exactly rounded sums of the products on the original vectors, so equal vectors score alike.

Defined cases: vectors that are null, empty or zero or have null or non-finite components take no part; of vectors of
different lengths the shorter counts as filled with zeros; equal vectors of a block are verified once, and the k least ids
of them count; equal scores go by vec_id, a null one last; repeated rows are candidates of each other; with fewer
candidates than k all are found; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from siftstone.llm.common import checkpointed, snapshot, unit_hash

K, EVERY = 20, 20
WIDTH, CHANCE, SEED = 12, 0.98, 11
SAMPLE, CELLS, BLOCK, LEAF, GROUP = 20_000, 4_096, 1_024, 64, 1_024
#: Products on unit vectors that differ by less may be equal ones.
SLACK = 1e-9
#: Of a leaf's pairs of which more than one in this many pass, all are multiplied as matrices and those that don't pass are left out.
DENSE = 16

POINTS = "row long, vec_id long, v binary, p binary, cell int"
BLOCKS = "block long, cell int, low array<double>, high array<double>, dim int, vectors binary, projections binary, edges binary, boxes binary, members binary, ids binary, named binary, rows binary"
VISITS = "block long, part int, query long, query_id long, bar double, v binary"
FOUND = "query long, query_id long, vec_id long, row long, score double"


def bound(chance: float, width: int) -> float:
    """The chi-square quantile of an even number of degrees, by bisection of the closed form."""

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for j in range(width // 2):
            total += term
            term *= x / 2 / (j + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * width
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < chance else (low, middle)
    return high


@dataclass(frozen=True)
class Space:
    """What all projections share: the greatest norm and number of components."""

    norm: float
    dim: int
    width: int = WIDTH
    seed: int = SEED

    def gaussian(self) -> np.ndarray:
        """Row 0 is the added component's."""
        return np.random.default_rng(self.seed).standard_normal((self.dim + 1, self.width))

    def of_points(self, x: np.ndarray) -> np.ndarray:
        g = self.gaussian()
        x = x / self.norm
        added = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return x @ g[1 : x.shape[1] + 1] + added[:, None] * g[0]

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.gaussian()[1 : x.shape[1] + 1]


def unit(x: np.ndarray) -> np.ndarray:
    large = x / np.abs(x).max(axis=1, keepdims=True)
    return large / np.sqrt((large * large).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array, kind: str, dim: int = 0) -> np.ndarray:
    """Packed vectors as rows of doubles, filled up with zeros."""
    rows = [np.frombuffer(x.as_buffer(), kind) for x in column]
    out = np.zeros((len(rows), max([dim, *map(len, rows)])))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _packed(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors that take part, packed, with their norms and lengths."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms, lengths = [], [], [], []
            for i, v in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if len(x) and np.isfinite(x).all() and x.any():
                        ids.append(i.as_py())
                        packed.append(x.astype(kind).tobytes())
                        largest = float(np.abs(x).max())
                        norms.append(largest * math.sqrt(float(np.square(x.astype('f8') / largest).sum())))
                        lengths.append(len(x))
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(packed, pa.binary()), "norm": pa.array(norms, pa.float64()), "dim": pa.array(lengths, pa.int32())})

    return pack


@dataclass
class Tree:
    """A kd-tree's cuts: for each node the axis, where it is cut, and its children, or its leaf's number below zero."""

    axis: np.ndarray
    at: np.ndarray
    below: np.ndarray
    above: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int) -> Tree:
        axis, at, below, above = [0], [0.0], [0], [0]
        todo, n_leaves = [(0, points, leaves)], 0
        while todo:
            node, inside, share = todo.pop()
            spread = np.ptp(inside, axis=0) if len(inside) else np.zeros(1)
            if share < 2 or not spread.any():
                below[node] = above[node] = ~n_leaves
                n_leaves += 1
                continue
            axis[node] = int(spread.argmax())
            values = np.sort(inside[:, axis[node]])
            at[node] = float(values[len(values) * (share // 2) // share])
            if at[node] == values[0]:
                at[node] = float(values[values > values[0]][0])
            left = inside[:, axis[node]] < at[node]
            for side, part, some in ((below, inside[left], share // 2), (above, inside[~left], share - share // 2)):
                side[node] = len(axis)
                todo.append((len(axis), part, some))
                for x, empty in ((axis, 0), (at, 0.0), (below, 0), (above, 0)):
                    x.append(empty)
        return cls(*(np.array(x) for x in (axis, at, below, above)))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        going = np.arange(len(points))
        while len(going):
            here = node[going]
            left = points[going, self.axis[here]] < self.at[here]
            node[going] = np.where(left, self.below[here], self.above[here])
            going = going[node[going] >= 0]
        return ~node


def _dealer(space: Space, kind: str, tree: Tree | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their projections and cells."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = space.of_points(matrix(batch.column("v"), kind))
            cell = tree.leaf_of(p) if tree else np.zeros(len(p), np.int64)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "vec_id": batch.column("vec_id"), "v": batch.column("v"), "p": pa.array([x.tobytes() for x in p], pa.binary()), "cell": pa.array(cell, pa.int32())})

    return deal


def leaves_of(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the edges of a kd-tree's leaves in it."""
    order, edges, todo = [], [0], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            order.append(part)
            edges.append(edges[-1] + len(part))
            continue
        axis = int(np.ptp(points[part], axis=0).argmax())
        by = part[np.argsort(points[part, axis], kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return np.concatenate(order), np.array(edges)


def _builder(kind: str, leaf: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows as one: its different vectors by the leaves of a kd-tree, and the rows that have each."""

    def build(rows: pa.Table) -> pa.Table:
        x, p = matrix(rows["v"], kind), matrix(rows["p"], "f8")
        _, first, of = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order, edges = leaves_of(p[first], leaf)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        of = number[of.ravel()]
        x, p = x[first[order]], p[first[order]]
        row, ids = rows["row"].to_numpy(), rows["vec_id"].fill_null(0).to_numpy()
        named = rows["vec_id"].is_valid().to_numpy()
        by = np.lexsort((row, ids, ~named, of))
        boxes = np.stack([np.stack([p[a:b].min(axis=0), p[a:b].max(axis=0)]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        held = {"vectors": x, "projections": p, "edges": edges, "boxes": boxes, "members": np.searchsorted(of[by], np.arange(len(order) + 1)), "ids": ids[by], "named": named[by], "rows": row[by]}
        whole = {"block": rows["block"][0], "cell": rows["cell"][0], "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(), "dim": x.shape[1]}
        schema = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("dim", pa.int32()), *((name, pa.binary()) for name in held)])
        return pa.Table.from_pydict({name: [value] for name, value in (whole | {name: a.tobytes() for name, a in held.items()}).items()}, schema)

    return build


def _away(boxes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(p), len(boxes)))
    for axis in range(p.shape[1]):
        x = p[:, axis, None]
        out += np.maximum(0, np.maximum(boxes[:, 0, axis] - x, x - boxes[:, 1, axis])) ** 2
    return out


def verified(q: np.ndarray, pq: np.ndarray, own: np.ndarray, bar: np.ndarray, x: np.ndarray, p: np.ndarray, edges: np.ndarray, boxes: np.ndarray, k: int, within: float) -> np.ndarray:
    """Inner products of unit queries with the vectors that the search verifies, -inf for all others.

    own is the vector that a query must not count (or -1), bar its k-th largest product so far. Vectors are of norm 1 at
    most, filled up to 1, so a product s is a squared distance of 2 - 2 s.
    """
    out = np.full((len(q), len(x)), -np.inf)
    best = np.full((len(q), k), -np.inf)
    away = _away(boxes, pq)
    by_distance = np.argsort(away, axis=1, kind="stable")
    q_norms, p_norms = (pq**2).sum(axis=1), (p**2).sum(axis=1)
    active = np.arange(len(q))
    for step in range(len(boxes)):
        leaf = by_distance[active, step]
        reach = within * (2 - 2 * np.maximum(bar, best[:, 0])[active])
        going = away[active, leaf] <= reach
        active, leaf, reach = active[going], leaf[going], reach[going]
        if not len(active):
            break
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for part in np.split(order, cuts):
            who, here = active[part], slice(edges[leaf[part[0]]], edges[leaf[part[0]] + 1])
            passed = q_norms[who, None] + p_norms[here] - 2 * (pq[who] @ p[here].T) <= reach[part][:, None]
            at = own[who] - here.start
            mine = np.flatnonzero((at >= 0) & (at < here.stop - here.start))
            passed[mine, at[mine]] = False
            if DENSE * np.count_nonzero(passed) > passed.size:
                score = np.where(passed, q[who] @ x[here].T, -np.inf)
            else:
                i, j = np.nonzero(passed)
                score = np.full(passed.shape, -np.inf)
                score[i, j] = np.einsum("nd,nd->n", q[who[i]], x[here][j])
            out[who, here] = score
            # only a product above the k-th so far changes the k best; the k-th is the first of them
            risen = np.flatnonzero(score.max(axis=1) > best[who, 0])
            if len(risen):
                up = who[risen]
                best[up] = np.partition(np.concatenate([best[up], score[risen]], axis=1), -k, axis=1)[:, -k:]
    return out


def _searcher(space: Space, kind: str, k: int, chance: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A group of queries in one block: each one's k best of what is verified and may be among its k best of all."""
    within = bound(chance, space.width)

    def search(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        if len(queries) and len(blocks):
            block = {name: blocks[name][0] for name in blocks.schema.names}
            of = lambda name, t: np.frombuffer(block[name].as_buffer(), t)
            q = matrix(queries["v"], kind, block["dim"].as_py())
            x = np.zeros((len(of("vectors", "f8")) // block["dim"].as_py(), q.shape[1]))
            x[:, : block["dim"].as_py()] = of("vectors", "f8").reshape(len(x), -1)
            p, boxes, edges = of("projections", "f8").reshape(len(x), -1), of("boxes", "f8").reshape(-1, 2, space.width), of("edges", "i8")
            members, ids, named, held = of("members", "i8"), of("ids", "i8"), of("named", "?"), of("rows", "i8")
            asked = queries["query"].to_numpy()
            # a vector that only the query's own row has must not count
            by_row = np.argsort(held, kind="stable")
            at = np.minimum(np.searchsorted(held[by_row], asked), len(held) - 1)
            vector = np.searchsorted(members, by_row[at], side="right") - 1
            own = np.where((held[by_row[at]] == asked) & (np.diff(members)[vector] == 1), vector, -1)
            size = np.sqrt((q * q).sum(axis=1)) * space.norm
            bar = queries["bar"].to_numpy() / size
            scores = verified(unit(q), space.of_queries(q), own, bar, x / space.norm, p, edges, boxes, k, within)
            kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
            members, ids, named, held, vectors = members.tolist(), ids.tolist(), named.tolist(), held.tolist(), x.tolist()
            for i, (query, query_id) in enumerate(zip(asked.tolist(), queries["query_id"].to_pylist(), strict=True)):
                found, factors = [], q[i].tolist()
                for j in np.flatnonzero((scores[i] >= max(kth[i], bar[i]) - SLACK) & (scores[i] > -np.inf)).tolist():
                    score = math.fsum(map(mul, factors, vectors[j]))
                    which = [m for m in range(members[j], min(members[j + 1], members[j] + k + 1)) if held[m] != query]
                    found += [(-score, not named[m], ids[m], held[m]) for m in which]
                rows += [(query, query_id, None if unnamed else vec_id, row, -score) for score, unnamed, vec_id, row in sorted(found)[:k]]
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    return search


def _met(visits: DataFrame, index: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    pairs = visits.select(F.col("block").alias("met"), F.col("part").alias("by")).distinct()
    return visits.groupBy("block", "part").cogroup(index.join(pairs, F.col("block") == F.col("met")).groupBy("met", "by")).applyInArrow(search, FOUND)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, chance: float = CHANCE, sample: int = SAMPLE, block: int = BLOCK, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding"))
    rows = checkpointed(given.mapInArrow(_packed(kind), "vec_id long, v binary, norm double, dim int").withColumn("row", F.monotonically_increasing_id()))
    all_ = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("dim").alias("dim"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("queries")).first()
    if not all_["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(all_["norm"], all_["dim"])
    drawn = rows.where(unit_hash(F.col("row")) < F.lit(sample / all_["n"])).mapInArrow(_dealer(space, kind, None), POINTS).select("p").collect()
    tree = Tree.fit(np.array([np.frombuffer(r["p"]) for r in drawn]).reshape(-1, space.width), min(CELLS, -(-all_["n"] // block)))
    dealt = rows.mapInArrow(_dealer(space, kind, tree), POINTS)
    # a row for each cell, CELLS at most
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    cells = sorted(sizes)
    blocks = np.array([-(-sizes[c] // (2 * block)) for c in cells])
    firsts = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    placing = spark.createDataFrame([(c, int(f), int(b)) for c, f, b in zip(cells, firsts, blocks, strict=True)], "in_cell int, first_block long, blocks long")
    placed = dealt.join(F.broadcast(placing), F.col("cell") == F.col("in_cell")).withColumn("block", F.col("first_block") + F.pmod(F.xxhash64("row"), F.col("blocks")))
    index = snapshot(placed.select("block", "row", "vec_id", "v", "p", "cell").groupBy("block").applyInArrow(_builder(kind, leaf), BLOCKS))
    sides = index.groupBy("cell").agg(*(f(F.col(side)[i]).alias(f"{side}{i}") for side, f in (("low", F.min), ("high", F.max)) for i in range(space.width)))
    around = {r["cell"]: [[r[f"{side}{i}"] for i in range(space.width)] for side in ("low", "high")] for r in sides.collect()}
    boxes = np.array([around[c] for c in cells])
    parts, within = -(-all_["queries"] // group), bound(chance, space.width)

    def visiting(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """To the first block of the nearest cell, or to all blocks else of the cells that the test doesn't rule out."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("v"), kind)
                if not len(q):
                    continue
                away = _away(boxes, space.of_queries(q))
                home = firsts[away.argmin(axis=1)]
                reach = within * (2 - 2 * batch.column("bar").to_numpy() / (np.sqrt((q * q).sum(axis=1)) * space.norm))
                for i in range(len(q)):
                    near = home[i : i + 1]
                    if not first:
                        passed = np.flatnonzero(away[i] <= reach[i])
                        near = np.repeat(firsts[passed], blocks[passed])
                        near = near + np.arange(len(near)) - np.repeat(np.cumsum(blocks[passed]) - blocks[passed], blocks[passed])
                        near = near[near != home[i]]
                    same = pa.array(np.full(len(near), i))
                    taken = {name: batch.column(name).take(same) for name in ("part", "query", "query_id", "bar", "v")}
                    yield pa.RecordBatch.from_pydict({"block": pa.array(near, pa.int64())} | taken)

        return visit

    search = _searcher(space, kind, k, chance)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v")
    nowhere = asked.withColumn("bar", F.lit(float("-inf")))
    at_home = checkpointed(_met(checkpointed(nowhere.mapInArrow(visiting(True), VISITS)), index, search))
    bars = at_home.groupBy(F.col("query").alias("of")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = asked.join(bars, F.col("query") == F.col("of"), "left").withColumn("bar", F.coalesce("kth", F.lit(float("-inf"))))
    beyond = _met(checkpointed(known.select("part", "query", "query_id", "bar", "v").mapInArrow(visiting(False), VISITS)), index, search)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    best = at_home.unionByName(beyond).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
