"""Exact nearest neighbours under leave-one-fold-out, with cells that bounds rule out.

Rows fall into cells of a tree that halves a bounded sample; each cell knows the box that holds all its rows. A point
first looks through its own cell, which bounds the distance of its k-th neighbour from above; the distance to a cell's
box bounds those of the cell's rows from below, whatever the scale of each feature. So a point visits only the cells
that can hold a nearer row. Rows with equal features in one fold are one point: they have the same neighbours, and of
their ids only the k smallest can be anybody's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

CELL_POINTS, MOST_CELLS = 2048, 1 << 14
SAMPLE = 1 << 17  # points that the tree is made from
AT_ONCE = 1 << 22  # distances


class Tree:
    """Medians of a sample, halved ``depth`` times: cell numbers of points by comparisons."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        dims = max(1, sample.shape[1] if sample.ndim == 2 else 1)
        spread = sample.std(axis=0) if len(sample) else np.ones(dims)
        spread[spread <= 0] = 1.0
        self.depth, self.dim, self.cut = depth, np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            own = parts.pop(node, sample[:0])
            if len(own):
                d = int(np.argmax((own.max(axis=0) - own.min(axis=0)) / spread))
                self.dim[node], self.cut[node] = d, np.median(own[:, d])
            right = own[:, self.dim[node]] > self.cut[node]
            parts[2 * node], parts[2 * node + 1] = own[~right], own[right]

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.dim[node]] > self.cut[node])
        return node - (1 << self.depth)


_POINT = "point long, cell int, held string, x array<double>, scale array<double>, ids array<string>, labels array<string>"
_FOUND = pa.schema([("point", pa.int64()), ("best", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string()), ("label", pa.string())])))])
_SENT = pa.schema([*_FOUND, ("to", pa.int32()), ("held", pa.string()), ("x", pa.list_(pa.float64())), ("scale", pa.list_(pa.float64())), ("limit", pa.float64())])


class _Cell:
    """A cell's points: the nearest of other folds, in order of distance and id."""

    def __init__(self, rows: list[dict], k: int) -> None:
        self.k, self.x = k, np.array([r["x"] for r in rows])
        self.held, self.own = np.array([r["held"] for r in rows], dtype=object), [list(zip(r["ids"], r["labels"], strict=True)) for r in rows]
        self.count = np.array([len(o) for o in self.own])

    def nearest(self, x: np.ndarray, scale: np.ndarray, held: np.ndarray) -> Iterator[list[tuple]]:
        step = max(1, AT_ONCE // max(1, self.x.size))
        for at in range(0, len(x), step):
            away = np.sqrt((((self.x[None, :, :] - x[at : at + step, None, :]) / scale[at : at + step, None, :]) ** 2).sum(axis=2))
            away[self.held[None, :] == held[at : at + step, None]] = np.inf
            n = min(self.k, away.shape[1])
            for row, kth in zip(away, np.partition(away, n - 1, axis=1)[:, n - 1], strict=True):
                near = np.flatnonzero((row <= kth) & (row < np.inf))
                yield sorted((row[j], *entry) for j in near for entry in self.own[j])[: self.k]


def _as_best(found: list[tuple]) -> list[dict]:
    return [{"d": d, "id": i, "label": label} for d, i, label in found]


def nearest_neighbours(df: DataFrame, features: list[str], label: str, fold: str, ident: str, k: int = 5) -> DataFrame:
    """Each row's label by vote of its ``k`` nearest rows of other folds (ties: the smaller distance, then id; the smaller label): ``id, truth, held, predicted``.

    Features are scaled by their deviation over the other folds. Rows with a missing feature drop out; so do rows
    without any row in another fold.
    """
    vec = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.where(" AND ".join(f"{f} IS NOT NULL" for f in features)).select(F.col(ident).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.col(fold).cast("string").alias("held"), vec.alias("x"))
    rows = written(rows, "rows")
    sums = lambda p: [f(F.get("x", F.lit(i)) * (F.get("x", F.lit(i)) if sq else 1)).alias(f"{p}{name}{i}") for i in range(len(features)) for f, name, sq in ((F.sum, "s", False), (F.sum, "q", True))]
    own, all_ = rows.groupBy("held").agg(F.count("*").alias("on"), *sums("o")), rows.agg(F.count("*").alias("an"), *sums("a"))

    def deviation(i: int):
        n, s, q = (F.col(f"a{c}") - F.col(f"o{c}") for c in ("n", f"s{i}", f"q{i}"))
        sd = F.sqrt(F.greatest(F.try_divide(q, n) - F.try_divide(s, n) * F.try_divide(s, n), F.lit(0.0)))
        return F.when(sd > 1e-12, sd).otherwise(1.0)

    scales = own.crossJoin(F.broadcast(all_)).select("held", F.array(*[deviation(i) for i in range(len(features))]).alias("scale"))
    first = F.row_number().over(Window.partitionBy("x", "held").orderBy("id"))
    few = rows.withColumn("nth", first).where(F.col("nth") <= k)  # Spark keeps k of a group before it shuffles them
    points = few.groupBy("x", "held").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("own")).join(scales, "held")
    points = written(points.select("held", "x", "scale", F.col("own.id").alias("ids"), F.col("own.label").alias("labels"), F.monotonically_increasing_id().alias("point")), "points")

    n = points.count()
    thin = -(-n // SAMPLE)
    sample = points.where(F.pmod(F.xxhash64("x"), F.lit(max(1, thin))) == 0).select("x").toPandas()["x"]  # about SAMPLE points at most
    tree = Tree(np.array(sample.tolist(), dtype=np.float64).reshape(len(sample), len(features)), int(np.ceil(np.log2(max(1, min(MOST_CELLS, n / CELL_POINTS))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.record_batch([b.column("point"), pa.array(tree.cells(x), pa.int32()), *(b.column(c) for c in ("held", "x", "scale", "ids", "labels"))], names=["point", "cell", "held", "x", "scale", "ids", "labels"])

    placed = written(points.mapInArrow(deal, _POINT), "cells")
    edges = [f(F.get("x", F.lit(i))).alias(f"{c}{i}") for i in range(len(features)) for f, c in ((F.min, "low"), (F.max, "high"))]
    boxes = placed.groupBy("cell").agg(*edges).orderBy("cell").collect()  # MOST_CELLS rows at most
    number = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{c}{i}"] for i in range(len(features))] for r in boxes]).reshape(len(boxes), -1) for c in ("low", "high"))

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a point's own cell, and the point for every other cell that may hold a nearer row."""
        for group in _cells(batches):
            cell = _Cell(group, k)
            scale = np.array([r["scale"] for r in group])
            out = []
            for r, found in zip(group, cell.nearest(cell.x, scale, cell.held), strict=True):
                out.append({"point": r["point"], "best": _as_best(found)})
                limit = found[-1][0] if len(found) == k else np.inf
                gap = np.maximum(np.maximum(low - r["x"], np.array(r["x"]) - high), 0.0) / np.array(r["scale"])
                near = np.sqrt((gap**2).sum(axis=1)) * (1 - 1e-9) <= limit
                out += [{"point": r["point"], "to": int(c), "held": r["held"], "x": r["x"], "scale": r["scale"], "limit": limit} for c in number[near & (number != r["cell"])]]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_SENT)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=_SENT)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's points come first, then the visitors."""
        now, held, cell = None, [], None
        for b in batches:
            visitors: list[dict] = []

            def answered(visitors: list[dict], cell: _Cell) -> pa.RecordBatch:
                x, scale, folds = np.array([r["x"] for r in visitors]), np.array([r["scale"] for r in visitors]), np.array([r["held"] for r in visitors], dtype=object)
                return pa.RecordBatch.from_pylist([{"point": r["point"], "best": _as_best([f for f in found if f[0] <= r["limit"]])} for r, found in zip(visitors, cell.nearest(x, scale, folds), strict=True)], schema=_FOUND)

            for r in b.to_pylist():
                if r["cell"] != now:
                    if visitors:
                        yield answered(visitors, cell)
                    now, held, cell, visitors = r["cell"], [], None, []
                if r["ids"] is not None:
                    held.append(r)
                else:
                    cell = cell or _Cell(held, k)
                    visitors.append(r)
            if visitors:
                yield answered(visitors, cell)

    spark_best = "array<struct<d:double,id:string,label:string>>"
    met = written(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(own_cell, f"point long, best {spark_best}, to int, held string, x array<double>, scale array<double>, limit double"), "own-cells")
    none = lambda kind: F.lit(None).cast(kind)
    sent = met.where("to IS NOT NULL").select("point", F.col("to").alias("cell"), "held", "x", "scale", none("array<string>").alias("ids"), none("array<string>").alias("labels"), "limit")
    both = placed.withColumn("limit", none("double")).unionByName(sent).withColumn("last", F.col("ids").isNull())
    others = both.repartition("cell").sortWithinPartitions("cell", "last").mapInArrow(visit, f"point long, best {spark_best}")
    best = met.where("to IS NULL").select("point", "best").unionByName(others).select("point", F.explode("best").alias("b")).distinct()
    nearest = best.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy("b.d", "b.id"))).where(F.col("nth") <= k)
    votes = nearest.groupBy("point", F.col("b.label").alias("vote")).agg(F.count("*").alias("c"))
    chosen = votes.groupBy("point").agg(F.min(F.struct(-F.col("c"), "vote"))["vote"].alias("predicted"))
    named = placed.select("point", "x", "held").join(chosen, "point")
    return rows.join(named.drop("point"), ["x", "held"]).select("id", F.col("label").alias("truth"), "held", "predicted")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The points of one cell after the other."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and r["cell"] != now:
                yield held
                held = []
            now = r["cell"]
            held.append(r)
    if held:
        yield held
