"""Hard negatives by a kNN join over Voronoi cells.

Largest inner products become nearest neighbours by one more component: a vector x of norm |x| gets sqrt(M^2 - |x|^2), M the
largest norm, an anchor gets 0; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. A bounded sample of rows gives the pivots. Anchors are
grouped by their nearest pivot, and a large cell's anchors are split; a cell's radius is its anchors' largest distance from
the pivot. By the triangle inequality row x can serve an anchor of cell i only if its distance from pivot i is at most the
radius more than the farthest, and at least the radius less than the nearest distance that an anchor still takes. Only to such
groups is a row sent. Groups meet rows in slabs of bounded size, join them exactly by matrix products, and keep a few rows
an anchor; a window over those ends the join.

First each group meets the rows of its own cell, which bounds the distance of its positives; then it gets all rows within
those bounds. The scores of the positives then bound the shell in which negatives lie. Scores are whole numbers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bounded, stored

#: Anchors per pivot, and the most pivots.
PER_PIVOT, MOST_PIVOTS = 64, 256
#: Anchors that a group holds, rows that a slab of a group holds, about; rows of a slab that are scored at once.
GROUP, SLAB, STEP = 2048, 16_384, 1024
#: Products below this are exact in double precision.
_EXACT = 2.0**52

_ROW = pa.schema([("vec_id", pa.int64()), ("h", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("v", pa.binary()), ("norm2", pa.float64())])
_ROW_DDL = "vec_id long, h long, label long, anchor boolean, v binary, norm2 double"


def _pack(v: np.ndarray) -> bytes:
    """Components as 16-bit integers if they fit, else as doubles."""
    small = not len(v) or np.abs(v).max() < 2**15
    return (b"\x02" + v.astype("<i2").tobytes()) if small else (b"\x08" + v.astype("<f8").tobytes())


def _unpack(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    for i, blob in enumerate(column.to_pylist()):
        v = np.frombuffer(blob, "<i2" if blob[0] == 2 else "<f8", offset=1)
        out[i, : len(v)] = v
    return out


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.floor(scale * np.array(x, dtype=np.float64)) for x in batch["v"].to_pylist()]
            norms = pa.array([float(np.dot(x, x)) for x in vectors], pa.float64())
            packed = pa.array([_pack(x) for x in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec_id", "h", "label", "anchor")), packed, norms], schema=_ROW)

    return run


class _Cells:
    """Pivots, and for each pivot the radius, the bounds and the first group of its anchors; goes to every task."""

    def __init__(self, pivots: np.ndarray, top: float) -> None:
        self.pivots, self.top, n = pivots, top, len(pivots)
        self.radius, self.far, self.near = np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)
        self.first, self.groups = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.slack = 1e-6 * (1.0 + math.sqrt(top))

    def distances(self, x: np.ndarray, norm2: np.ndarray, anchors: bool) -> np.ndarray:
        """From each augmented row to each pivot."""
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - norm2, 0.0))
        x = np.concatenate([x, last[:, None]], axis=1)
        d2 = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0.0))


def _assign(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            d = cells.distances(_unpack(batch["v"], width), batch["norm2"].to_numpy(), True)
            cell = d.argmin(axis=1)
            names = [*batch.schema.names, "cell", "distance"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names)

    return run


def _route(shared, width: int, own: bool):
    """Rows with the groups that they may serve; own: those of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            d = cells.distances(_unpack(batch["v"], width), batch["norm2"].to_numpy(), False)
            if own:
                serves = np.zeros(d.shape, dtype=bool)
                serves[np.arange(len(d)), np.where(cells.groups > 0, d, np.inf).argmin(axis=1)] = True
            else:
                reach = cells.radius + cells.slack
                serves = (d - reach <= cells.far) & (d + reach >= cells.near)
            serves &= cells.groups > 0
            row, cell = np.nonzero(serves)
            each = cells.groups[cell]
            group = np.repeat(cells.first[cell], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            count = np.bincount(np.repeat(row, each), minlength=len(d))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(group))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec_id", "h", "label", "v")), lists], ["vec_id", "h", "label", "v", "groups"])

    return run


def _best(scores: np.ndarray, keep: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per line the columns of its k largest kept scores; columns stand in order of ids, the first of equals wins."""
    n = scores.shape[1]
    if scores.size and scores.dtype == np.float64 and np.abs(scores).max() * n < _EXACT:
        key = np.where(keep, scores * n - np.arange(n), -np.inf)
        top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            own = top[i][keep[i][top[i]]]
            yield i, own[np.argsort(-key[i][own])]
    else:
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            own = np.flatnonzero(keep[i])
            yield i, np.array(sorted(own.tolist(), key=lambda j: (-scores[i, j], j))[:k])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: of doubles while they stay small, else of Python's integers."""
    limit = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(1, a.shape[1])
    if 128 * limit < _EXACT:  # hundredfold ones are compared
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object) @ whole(b).astype(object).T


def _first(found: list[tuple], k: int) -> list[tuple]:
    """The first k of (score, id, hash)."""
    return sorted(found, key=lambda x: (-x[0], *x[1:]))[:k]


def _clip(x: object) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


_POSITIVE = pa.schema([("vec_id", pa.int64()), ("h", pa.int64()), ("other", pa.int64()), ("other_h", pa.int64()), ("score", pa.int64())])
_POSITIVE_DDL = "vec_id long, h long, other long, other_h long, score long"


def _join_positives(width: int, k: int):
    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("h", "ascending")])
            q, label, ids, hs = _unpack(anchors["v"], width), anchors["label"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["h"].to_numpy()
            found: dict[int, list] = {}
            for at in range(0, rows.num_rows, STEP):
                part = rows.slice(at, STEP)
                other, other_h = part["vec_id"].to_numpy(), part["h"].to_numpy()
                keep = (label[:, None] == part["label"].to_numpy()) & ((ids[:, None] != other) | (hs[:, None] != other_h))
                scores = _products(q, _unpack(part["v"], width))
                for i, top in _best(scores, keep, k):
                    found[i] = _first(found.get(i, []) + [(_clip(scores[i, j]), int(other[j]), int(other_h[j])) for j in top.tolist()], k)
            out = [(int(ids[i]), int(hs[i]), other, h, score) for i, best in found.items() for score, other, h in best]
        return pa.table([list(c) for c in zip(*out)] if out else [[]] * 5, schema=_POSITIVE)

    return run


_PAIR = pa.schema([("vec_id", pa.int64()), ("h", pa.int64()), ("positive_id", pa.int64()), ("positive_h", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_h", pa.int64()), ("negative_score", pa.int64())])
_PAIR_DDL = "vec_id long, h long, positive_id long, positive_h long, positive_score long, negative_id long, negative_h long, negative_score long"


def _join_negatives(width: int, k: int, low: int, high: int):
    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("h", "ascending")])
            q, label, ids, hs = _unpack(anchors["v"], width), anchors["label"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["h"].to_numpy()
            found: dict[tuple, list] = {}
            positives = [x or [] for x in anchors["positives"].to_pylist()]
            for at in range(0, rows.num_rows, STEP):
                part = rows.slice(at, STEP)
                other, other_h = part["vec_id"].to_numpy(), part["h"].to_numpy()
                differ = label[:, None] != part["label"].to_numpy()
                scores = _products(q, _unpack(part["v"], width))
                for n in range(max(map(len, positives), default=0)):
                    p = np.array([x[n]["score"] if n < len(x) else -1 for x in positives], dtype=scores.dtype)[:, None]  # below 0: no row fits
                    keep = differ & (100 * scores <= high * p) & (100 * scores >= low * p)
                    for i, top in _best(scores, keep.astype(bool), k):
                        found[i, n] = _first(found.get((i, n), []) + [(_clip(scores[i, j]), int(other[j]), int(other_h[j])) for j in top.tolist()], k)
            for (i, n), best in found.items():
                x = positives[i][n]
                out += [(int(ids[i]), int(hs[i]), x["other"], x["other_h"], x["score"], other, h, score) for score, other, h in best]
        return pa.table([list(c) for c in zip(*out)] if out else [[]] * 8, schema=_PAIR)

    return run


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, group: int = GROUP, slab: int = SLAB, most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    A score is the inner product of floor(scale * x) of both rows. An anchor's positives are its first rows of the same label
    by score, then id; a pair's negatives the first rows of other labels whose hundredfold score lies from low to high times
    the positive's. Rows without an id, label or vector, or with a null or non-finite component, take no part. Rows that repeat
    an id are rows of their own, except exact repeats, which count once; equal scores and ids go by a hash of the row. Vectors
    of different length end in zeros, empty ones score 0. Scores beyond a long are given as the nearest long. Pairs without a
    negative, and tables without anchors, give no rows.
    """
    spark = rows.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    base = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    base = base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    base = bounded(base).distinct().withColumn("h", F.xxhash64("label", "v"))
    base = stored(base.select("vec_id", "h", "label", "anchor", "v").mapInArrow(_quantise(scale), _ROW_DDL), "vectors")
    width = F.when(F.substring("v", 1, 1) == F.lit(b"\x02"), (F.octet_length("v") - 1) / 2).otherwise((F.octet_length("v") - 1) / 8)
    n, n_anchors, top, width = base.agg(F.count("*"), F.count_if("anchor"), F.max("norm2"), F.max(width)).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, slabs = int(width), math.ceil(n / slab)
    sample = base.orderBy(F.xxhash64("vec_id", "h"), "vec_id", "h").limit(max(2, min(most_pivots, n_anchors // PER_PIVOT))).select("v", "norm2").toArrow()
    last = np.sqrt(np.maximum(top - sample["norm2"].to_numpy(), 0.0))
    cells = _Cells(np.concatenate([_unpack(sample["v"], width), last[:, None]], axis=1), top)
    share = spark.sparkContext.broadcast

    anchors = base.where("anchor").mapInArrow(_assign(share(cells), width), _ROW_DDL + ", cell int, distance double")
    anchors = stored(anchors, "anchors")
    for r in anchors.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect():
        cells.radius[r["cell"]], cells.groups[r["cell"]] = r["radius"], math.ceil(r["n"] / group)
    cells.first = np.cumsum(cells.groups) - cells.groups
    per_cell = lambda a: F.get(F.array(*[F.lit(int(x)) for x in a]), F.col("cell"))  # noqa: E731  one number a pivot
    at = per_cell(cells.first) + F.pmod(F.xxhash64("vec_id", "h"), per_cell(cells.groups))
    anchors = anchors.withColumn("group", at)

    def met(who: DataFrame, own: bool) -> object:
        """Groups of anchors beside the rows that may serve them, in slabs."""
        sent = base.mapInArrow(_route(share(cells), width, own), "vec_id long, h long, label long, v binary, groups array<long>")
        sent = sent.withColumn("slab", F.pmod(F.xxhash64("h", "vec_id"), F.lit(slabs))).withColumn("group", F.explode("groups")).drop("groups")
        who = who.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)).cast("array<long>")))
        return who.groupBy("group", "slab").cogroup(sent.groupBy("group", "slab"))

    first = Window.partitionBy("vec_id", "h").orderBy(F.desc("score"), "other", "other_h")

    def nearest(own: bool) -> DataFrame:
        found = met(anchors.select("vec_id", "h", "label", "v", "group"), own).applyInArrow(_join_positives(width, positives), _POSITIVE_DDL)
        found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
        found = found.groupBy("vec_id", "h").agg(F.sort_array(F.collect_list(F.struct("n", "other", "other_h", "score"))).alias("positives"))
        return stored(anchors.join(found, ["vec_id", "h"], "left"), "positives")

    def far(score: Column) -> Column:
        return F.sqrt(F.greatest(F.col("norm2") + F.lit(top) - 2 * score, F.lit(0.0)))

    def bound(who: DataFrame, farthest: Column, closest: Column) -> None:
        cells.far, cells.near = np.full(len(cells.far), -np.inf), np.full(len(cells.near), np.inf)
        for r in who.groupBy("cell").agg(F.max(farthest).alias("far"), F.min(closest).alias("near")).collect():
            if r["far"] is not None:
                cells.far[r["cell"]], cells.near[r["cell"]] = r["far"] + cells.slack, r["near"] - cells.slack

    last_of = F.when(F.size("positives") == positives, F.element_at("positives", -1)["score"].cast("double"))
    bound(nearest(own=True), F.when(last_of.isNull(), float("inf")).otherwise(far(last_of)), F.lit(0.0))
    anchors_done = nearest(own=False).where("positives is not null")
    of = lambda f, share: f(F.transform(F.filter("positives", lambda p: p["score"] >= 0), lambda p: far(p["score"] * (share / 100))))
    bound(anchors_done, of(F.array_max, low), of(F.array_min, high))
    pairs = met(anchors_done.select("vec_id", "h", "label", "v", "positives", "group"), False).applyInArrow(_join_negatives(width, negatives, low, high), _PAIR_DDL)
    order = Window.partitionBy("vec_id", "h", "positive_id", "positive_h").orderBy(F.desc("negative_score"), "negative_id", "negative_h")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return pairs.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
