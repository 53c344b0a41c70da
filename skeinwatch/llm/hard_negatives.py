"""Hard negatives for anchors, by slot-decomposed selection.

The negatives of a (anchor, positive) pair are the best rows of another label whose score lies in a window below the
positive's score. The windows of one anchor overlap; only their upper ends differ in what they let through at the top. So
the upper ends of an anchor's positives, in descending order, cut its scores into disjoint slots. Each task keeps the
first `negatives` rows of every slot (a combiner: one matrix product for a portion of rows and a chunk of anchors, then
only what beats the rows held so far); the tasks' rows are merged per slot; and merging slots from the lowest upwards,
never more than `negatives` rows at a time, answers every window: what a window holds is the beginning of the suffix of
slots that starts at its own, down to its lower end.

The anchors are a stated query set, scored against all rows in blocks of `block` anchors: a block's vectors and limits are
broadcast (their size is bounded by `block`), every row is read once for positives and once for negatives, and each
block's result is a table in the shared folder. Only positives of one block come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import materialize, new_path

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ROWS, _ANCHORS = 4096, 512
_FOUND = "anchor int, slot int, score long, id long"


@dataclass(frozen=True)
class Selection:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # hundredths of the positive's score
    high: int = 90
    block: int = 8192


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, vec (doubles) of rows whose id, label, vector and components are all there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )


def _matrix(vectors: pa.Array, width: int | None, scale: int) -> np.ndarray:
    """One row a vector, floor(scale * x); shorter vectors end in zeros, what exceeds `width` would meet zeros only."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return np.floor(scale * values).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, n in enumerate(np.minimum(sizes, width)):
        out[i, :n] = np.floor(scale * values[offsets[i] : offsets[i] + n])
    return out


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt(np.square(m).sum(axis=1).max(initial=0.0)))


class Scorer:
    """Exact integer inner products: in floats as long as no sum can leave their exact range, else in Python's integers (saturating)."""

    def __init__(self, anchors: np.ndarray):
        self.exact, self.norm = anchors, _norm(anchors)
        self.single = anchors.astype(np.float32)

    def __call__(self, part: slice, rows: np.ndarray) -> np.ndarray:
        bound = self.norm * _norm(rows)
        if bound < 1 << 23:
            return self.single[part] @ rows.astype(np.float32).T
        if bound < 1 << 52:
            return self.exact[part] @ rows.T
        whole = np.frompyfunc(int, 1, 1)
        scores = whole(self.exact[part]).dot(whole(rows).T) if rows.shape[1] else np.zeros((len(self.exact[part]), len(rows)), object)
        return np.clip(scores, _LEAST + 1, _MOST).astype(np.int64)


class Best:
    """The first k rows (score descending, id ascending, each (score, id) once) of every slot of every anchor."""

    def __init__(self, uppers: np.ndarray, floor: np.ndarray, k: int):
        self.uppers, self.floor, self.k = uppers, floor, k
        self.score = np.full((*uppers.shape, k), _LEAST)
        self.id = np.full((*uppers.shape, k), _MOST)

    def offer(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """`scores` and `allowed` of the anchors from `first` on (rows) and of the vectors `ids` (columns)."""
        end = first + len(scores)
        kind = np.int64 if scores.dtype == np.int64 else np.float64

        def bound(values: np.ndarray) -> np.ndarray:  # whole numbers beyond the floats' exact range meet no score
            values = np.clip(values, -(1 << 52), 1 << 52) if kind is np.float64 else values
            return values.astype(scores.dtype)[:, None]

        for j in range(self.uppers.shape[1]):
            below = self.uppers[first:end, j + 1] + 1 if j + 1 < self.uppers.shape[1] else self.floor[first:end]
            held = self.score[first:end, j, -1]
            some = allowed & (scores <= bound(self.uppers[first:end, j])) & (scores >= bound(np.maximum(below, held)))
            a, r = np.nonzero(some)
            if not len(a):
                continue
            s, i = scores[a, r].astype(np.int64), ids[r]
            new = (s > held[a]) | (i < self.id[first + a, j, -1])
            if new.any():
                self._merge(first + a[new], j, s[new], i[new])

    def _merge(self, anchors: np.ndarray, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(anchors)
        a = np.concatenate([anchors, np.repeat(touched, self.k)])
        s = np.concatenate([scores, self.score[touched, j].reshape(-1)])
        i = np.concatenate([ids, self.id[touched, j].reshape(-1)])
        order = np.lexsort((i, ~s, a))
        a, s, i = a[order], s[order], i[order]
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1]) & (s[1:] != _LEAST)
        a, s, i = a[~again], s[~again], i[~again]
        starts = np.searchsorted(a, touched)
        rank = np.arange(len(a)) - starts[np.searchsorted(touched, a)]
        keep = rank < self.k
        self.score[touched, j], self.id[touched, j] = _LEAST, _MOST
        self.score[a[keep], j, rank[keep]], self.id[a[keep], j, rank[keep]] = s[keep], i[keep]

    def found(self) -> pa.RecordBatch:
        a, j, r = np.nonzero(self.score > _LEAST)
        columns = (pa.array(a, pa.int32()), pa.array(j, pa.int32()), pa.array(self.score[a, j, r]), pa.array(self.id[a, j, r]))
        return pa.RecordBatch.from_arrays(list(columns), ["anchor", "slot", "score", "id"])


def _search(shared, scale: int, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Combiner of one task: all its rows against one block of anchors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        scorer, best = Scorer(block["vec"]), Best(block["uppers"], block["floor"], k)
        size = 64  # small portions first: what they leave keeps most of the later rows out
        for batch in batches:
            all_ids, all_labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < batch.num_rows:
                upto = min(batch.num_rows, at + size)
                rows = _matrix(batch.column(2).slice(at, upto - at), block["vec"].shape[1], scale)
                ids, labels = all_ids[at:upto], all_labels[at:upto]
                for first in range(0, len(block["id"]), _ANCHORS):
                    part = slice(first, first + _ANCHORS)
                    agree = block["label"][part, None] == labels
                    allowed = agree & (block["id"][part, None] != ids) if same else ~agree
                    best.offer(first, scorer(part, rows), allowed, ids)
                at, size = upto, min(_ROWS, size * 2)
        yield best.found()

    return search


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each slot over all tasks, numbered from 0. One exchange, by anchor."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.repartition("anchor").distinct().withColumn("at", F.row_number().over(order) - 1).filter(F.col("at") < k)


def _blocks(anchors: DataFrame, size: int) -> Iterator[list]:
    held = []
    for r in anchors.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def mine(rows: DataFrame, is_anchor: Column, scale: int = 256, selection: Selection = Selection()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score over `rows` (id, label, vec; see `usable`).

    A score is the inner product of floor(scale * x). An anchor's positives are its first rows of the same label under another id;
    negatives have another label and a score between `low` and `high` hundredths of the positive's. Higher scores come first, ties by
    smaller id. Rows that repeat an id with the same score count once; equal anchor rows are one anchor. Vectors of different length
    are compared as if the shorter ended in zeros. Scores beyond 64 bits saturate. Windows below a negative positive score are empty.
    An empty table, or one without anchors, gives no rows. Columns other than the three are not read.
    """
    spark, s = rows.sparkSession, selection
    anchors = materialize(rows.filter(is_anchor).distinct(), "anchors")
    out = new_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for held in _blocks(anchors, s.block):
        vectors = pa.array([r["vec"] for r in held], pa.list_(pa.float64()))
        block = {
            "id": np.array([r["id"] for r in held], np.int64), "label": np.array([r["label"] for r in held], np.int64), "vec": _matrix(vectors, None, scale),
            "uppers": np.full((len(held), 1), _MOST), "floor": np.full(len(held), _LEAST + 1),
        }
        shared = spark.sparkContext.broadcast(block)
        near = rows.mapInArrow(_search(shared, scale, s.positives, True), _FOUND)
        part, whole, rest = F.col("score"), F.expr("score div 100"), F.expr("score % 100")
        limits = materialize(
            _first(near, s.positives).filter(part >= 0).select(
                "anchor", F.col("at").alias("slot"), F.col("id").alias("positive_id"), part.alias("positive_score"),
                (whole * s.low + F.ceil(rest * s.low / 100)).cast("long").alias("lowest"), (whole * s.high + F.floor(rest * s.high / 100)).cast("long").alias("upper"),
            ), "positives",
        )
        uppers, floor = np.full((len(held), s.positives), _LEAST + 1), np.full(len(held), _MOST)
        for r in limits.select("anchor", "slot", "upper", "lowest").collect():  # at most `positives` a held anchor
            uppers[r["anchor"], r["slot"]] = r["upper"]
            floor[r["anchor"]] = min(floor[r["anchor"]], r["lowest"])
        bounds = spark.sparkContext.broadcast(block | {"uppers": uppers, "floor": floor})
        far = rows.mapInArrow(_search(bounds, scale, s.negatives, False), _FOUND)
        ids = spark.createDataFrame(pa.table({"anchor": pa.array(range(len(held)), pa.int32()), "anchor_id": block["id"]}))
        paths.append(f"{out}/block-{len(paths)}")
        _windows(_first(far, s.negatives), limits, s).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(paths[-1])
        shared.unpersist()
        bounds.unpersist()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _windows(best: DataFrame, limits: DataFrame, s: Selection) -> DataFrame:
    """Suffix merges: from the lowest slot upwards, the first `negatives` rows of a slot and all below it; each window is a beginning of one."""
    entries = best.groupBy("anchor").agg(F.collect_list(F.struct("slot", "at", "score", "id")).alias("e"))

    def slot(j: int) -> Column:
        return F.filter(F.array_sort("e"), lambda x: x["slot"] == j)

    merged = [slot(s.positives - 1)]
    for j in reversed(range(s.positives - 1)):
        merged.insert(0, F.slice(F.concat(slot(j), merged[0]), 1, s.negatives))
    suffixes = entries.select("anchor", F.posexplode(F.array(*merged)).alias("slot", "s"))
    within = F.filter("s", lambda x: x["score"] >= F.col("lowest"))
    placed = limits.join(suffixes, ["anchor", "slot"]).select("anchor", "positive_id", "positive_score", F.posexplode(within).alias("i", "x"))
    return placed.select("anchor", "positive_id", "positive_score", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), F.col("x.score").alias("negative_score"))
