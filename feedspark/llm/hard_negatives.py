"""Hard negatives by exact inner products, with bounds carried along spanning trees of the anchors.

Anchors that lie close together form a tree of shortest edges. At the root every candidate is scored. A child's score
of a candidate differs from its parent's by at most the edge's length times the candidate's norm, so the parent's
score, or the bounds known there, give bounds at the child; only candidates whose bounds overlap a window that the
child looks for are scored again. The first search looks for the positives (the largest scores of the anchor's label),
the second for the candidates of other labels inside the score windows that the positives set.

Candidates lie in chunks, anchors in trees, both of bounded size. Every tree meets every chunk once (a stated query
set against all rows, in blocks): trees are copied to lanes over which the chunks are dealt, as many as there are
chunks. Labels play no part in the dealing, so a frequent label makes no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

ANCHOR_STEP, MOVED_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these parts (of 100) of the positive's.
LEAST, MOST = 50, 95
#: Components are multiplied by this before they are rounded down.
SCALE = 256
CHUNK_ROWS, TREE_ROWS = 4096, 512
#: Random directions whose signs put anchors beside close ones.
DIRECTIONS = 16

_CHUNK = "chunk long, ids array<long>, labels array<long>, dims int, matrix binary"
_ANCHOR = "cell long, row long, id long, label long, dims int, vector binary"
_TREE = "tree long, rows array<long>, ids array<long>, labels array<long>, parents array<int>, edges array<double>, dims int, matrix binary"
_FOUND = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, id long, score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """id, label and whole-number vector of the rows that take part."""
    x = F.col("embedding")
    fit = F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (label + 1) % LABELS).otherwise(label)
    return embeddings.filter(fit).select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"),
                                         F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector"))


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _widened(matrix: np.ndarray, dims: int) -> np.ndarray:
    return matrix if matrix.shape[1] == dims else np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _chunker(schema: pa.Schema, chunk_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 20, [], 0

        def cut(n: int) -> tuple:
            """The first ``n`` held rows as a chunk, by label."""
            nonlocal held, count, number
            ids = [i for h in held for i in h[0]]
            labels = np.concatenate([h[1] for h in held])
            dims = max(h[2].shape[1] for h in held)
            matrix = np.concatenate([_widened(h[2], dims) for h in held])
            order = np.argsort(labels[:n], kind="stable")
            row = (number, [ids[k] for k in order], labels[order].tolist(), dims, matrix[order].tobytes())
            held, count, number = [(ids[n:], labels[n:], matrix[n:])] if len(ids) > n else [], len(ids) - n, number + 1
            return row

        for batch in batches:
            held.append((batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))))
            count += batch.num_rows
            while count >= chunk_rows:
                yield _record([cut(chunk_rows)], schema)
        if count:
            yield _record([cut(count)], schema)
    return run


def _anchors(schema: pa.Schema, step: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, labels, dims, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matrix, out = np.frombuffer(data, np.int64).reshape(len(ids), dims), []
                signs = matrix @ np.random.default_rng(0).normal(size=(dims, DIRECTIONS)) > 0
                cells = signs @ (1 << np.arange(DIRECTIONS))
                for k, i in enumerate(ids):
                    if i is not None and i % step == 0:
                        out.append((labels[k] << DIRECTIONS | int(cells[k]), chunk << 13 | k, i, labels[k], dims, matrix[k].tobytes()))
                if out:
                    yield _record(out, schema)
    return run


def spanning_tree(matrix: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Rows in an order where parents come before children, each one's parent as a place in that order, and the lengths
    of the edges (root: -1, 0). Edges are those of a shortest spanning tree (Prim), the root is closest to the mean."""
    points = matrix.astype(np.float64)
    n = len(points)
    root = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    near, parent = np.full(n, np.inf), np.full(n, -1)
    children: list[list[int]] = [[] for _ in range(n)]
    new, left = root, np.ones(n, bool)
    for _ in range(n - 1):
        left[new] = False
        gaps = ((points - points[new]) ** 2).sum(1)
        closer = left & (gaps < near)
        near[closer], parent[closer] = gaps[closer], new
        new = int(np.argmin(np.where(left, near, np.inf)))
        children[parent[new]].append(new)
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo += children[order[-1]][::-1]
    place = {k: at for at, k in enumerate(order)}
    edges = [float(np.sqrt(((points[k] - points[parent[k]]) ** 2).sum())) if k != root else 0.0 for k in order]
    return order, [place[int(parent[k])] if k != root else -1 for k in order], edges


def _planter(schema: pa.Schema, tree_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 40, []

        def plant(rows: list[tuple]) -> tuple:
            nonlocal number
            dims = max(r[4] for r in rows)
            matrix = np.stack([np.pad(np.frombuffer(r[5], np.int64), (0, dims - r[4])) for r in rows])
            order, parents, edges = spanning_tree(matrix)
            number += 1
            return (number, *([rows[k][c] for k in order] for c in (1, 2, 3)), parents, edges, dims, matrix[order].tobytes())

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= tree_rows:
                yield _record([plant(held[:tree_rows])], schema)
                held = held[tree_rows:]
        if held:
            yield _record([plant(held)], schema)
    return run


class Walk:
    """The anchors of a tree, each with bounds of its scores of the candidates of a chunk."""

    def __init__(self, chunk: dict, tree: dict):
        dims = max(chunk["dims"], tree["dims"])
        self.candidates = _widened(np.frombuffer(chunk["matrix"], np.int64).reshape(len(chunk["ids"]), chunk["dims"]), dims)
        self.anchors = _widened(np.frombuffer(tree["matrix"], np.int64).reshape(len(tree["ids"]), tree["dims"]), dims)
        self.norms = np.sqrt((self.candidates.astype(np.float64) ** 2).sum(1))
        peak = float(np.abs(self.candidates.astype(np.float64)).max(initial=0)) * float(np.abs(self.anchors.astype(np.float64)).max(initial=0)) * dims
        if peak < 2 ** 53:  # exact in floating point
            self.candidates, self.anchors = self.candidates.astype(np.float64), self.anchors.astype(np.float64)
        elif peak >= 2 ** 63:
            self.candidates, self.anchors = self.candidates.astype(object), self.anchors.astype(object)
        self.parents, self.edges = tree["parents"], tree["edges"]

    def scores(self, rows: np.ndarray, anchor: int) -> np.ndarray:
        """Exact scores as whole numbers, at the ends of 64 bits if they lie beyond."""
        some = self.candidates if len(rows) == len(self.candidates) else self.candidates[rows]
        found = some @ self.anchors[anchor]
        if found.dtype == object:
            found = np.clip(found, -(1 << 63), (1 << 63) - 1)
        return found.astype(np.int64)

    def visit(self, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], take: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """For every anchor: ``wanted(anchor, low, high)`` names the rows whose bounds leave them open, ``take`` gets
        those rows with their exact scores. At the root all rows are scored."""
        last = {p: k for k, p in enumerate(self.parents)}
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parent in enumerate(self.parents):
            if parent < 0:
                exact = self.scores(np.arange(len(self.norms)), k)
                low, high = exact.astype(np.float64), exact.astype(np.float64)
                rows = wanted(k, low, high)
                scores = exact[rows]
            else:
                low, high = bounds[parent]
                reach = self.edges[k] * self.norms
                reach += 1 + 1e-9 * (reach + np.maximum(np.abs(low), np.abs(high)))  # for rounding
                low, high = low - reach, high + reach
                rows = wanted(k, low, high)
                scores = self.scores(rows, k)
                low[rows] = high[rows] = scores
            take(k, rows, scores)
            if k in last:
                bounds[k] = low, high
            if parent >= 0 and last[parent] == k:
                del bounds[parent]


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores, ties by id (unknown ones last), then by row."""
    if len(scores) > 4 * most:
        floor = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((rows[some], ids[some], -scores[some]))[:most]]
    return np.lexsort((rows, ids, -scores))[:most]


class _Pair:
    """A chunk and a tree as they meet."""

    def __init__(self, x: dict):
        self.chunk = {"ids": x["c_ids"], "dims": x["c_dims"], "matrix": x["c_matrix"]}
        self.tree, self.base = x, x["chunk"] << 13
        self.walk = Walk(self.chunk, x)
        self.labels = np.array(x["c_labels"], np.int64)
        self.ids = np.array([(1 << 63) - 1 if i is None else i for i in x["c_ids"]], np.int64)

    def same(self, anchor: int) -> tuple[int, int]:
        """The candidates of the anchor's label are those from the first place to before the second."""
        label = self.tree["labels"][anchor]
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def row(self, k: int) -> tuple[int, int | None]:
        return self.base | int(k), self.chunk["ids"][k]


def _positive_search(schema: pa.Schema, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                pair, out = _Pair(x), []

                def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    start, end = pair.same(k)
                    rows = np.arange(start, end)
                    own = x["rows"][k] - pair.base
                    if start <= own < end:
                        rows = np.delete(rows, own - start)
                    if len(rows) > most:
                        floor = np.partition(low[rows], len(rows) - most)[len(rows) - most]
                        rows = rows[high[rows] >= floor]
                    return rows

                def take(k: int, rows: np.ndarray, scores: np.ndarray) -> None:
                    for at in _best(scores, pair.ids[rows], rows, most):
                        out.append((x["rows"][k], x["ids"][k], None, None, None, *pair.row(rows[at]), int(scores[at])))

                pair.walk.visit(wanted, take)
                if out:
                    yield _record(out, schema)
    return run


def _negative_search(schema: pa.Schema, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                pair, out = _Pair(x), []
                windows: dict[int, list[tuple]] = {w["at"]: [
                    (p["place"], p["id"], p["score"], -(-LEAST * p["score"] // 100), MOST * p["score"] // 100)
                    for p in w["positives"]] for w in x["windows"]}

                def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    open_ = np.zeros(len(low), bool)
                    for *_, least, greatest in windows.get(k, ()):
                        if least <= greatest:
                            open_ |= (high >= least) & (low <= greatest)
                    start, end = pair.same(k)
                    open_[start:end] = False
                    return np.flatnonzero(open_)

                def take(k: int, rows: np.ndarray, scores: np.ndarray) -> None:
                    for place, positive, score, least, greatest in windows.get(k, ()):
                        inside = np.flatnonzero((scores >= least) & (scores <= greatest))
                        for at in inside[_best(scores[inside], pair.ids[rows[inside]], rows[inside], most)]:
                            out.append((x["rows"][k], x["ids"][k], place, positive, score, *pair.row(rows[at]), int(scores[at])))

                pair.walk.visit(wanted, take)
                if out:
                    yield _record(out, schema)
    return run


def _meetings(chunks: DataFrame, trees: DataFrame, lanes: int) -> DataFrame:
    """Every tree with every chunk, through a join on lanes."""
    dealt = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(lanes)).alias("lane"), "chunk",
                          *(F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "dims", "matrix")))
    copied = trees.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("lane", F.col("lane").cast("long"))
    return dealt.hint("merge").join(copied, "lane")


def hard_negatives(embeddings: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   chunk_rows: int = CHUNK_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; one row per negative of an anchor's positive.

    ``embeddings``: vec_id, embedding, label. Rows with a NULL label, a NULL vector or a NULL or non-finite component take
    no part. Ids may repeat: every row is an anchor, a positive or a negative of its own, and of equal scores and ids the
    one read first comes first. A NULL id is no anchor and comes last among ties. Shorter vectors end in zeros, empty
    ones score 0. Components and scores lie within 64 bits; larger ones count as the ends of that range. An empty
    table gives no rows; other columns are not read.
    """
    if chunk_rows > 1 << 13:
        raise ValueError("a chunk holds at most 8192 rows")
    chunks = stored(usable(embeddings).mapInArrow(_chunker(_schema(_CHUNK), chunk_rows), _CHUNK), "chunks")
    lanes = max(1, chunks.count())
    anchors = stored(chunks.mapInArrow(_anchors(_schema(_ANCHOR), anchor_step), _ANCHOR), "anchors")
    groves = anchors.count() // (8 * tree_rows) + 1
    trees = stored(anchors.repartitionByRange(groves, "cell", "row").sortWithinPartitions("cell", "row")
                   .mapInArrow(_planter(_schema(_TREE), tree_rows), _TREE), "trees")

    found = _meetings(chunks, trees, lanes).mapInArrow(_positive_search(_schema(_FOUND), positives), _FOUND)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    chosen = found.select("anchor", "row", "id", "score", F.row_number().over(first).alias("place")).filter(F.col("place") <= positives)
    sets = chosen.groupBy("anchor").agg(F.collect_list(F.struct("place", "id", "score")).alias("positives"))
    members = trees.select("tree", F.posexplode("rows").alias("at", "anchor"))
    windows = members.join(sets, "anchor").groupBy("tree").agg(F.collect_list(F.struct("at", "positives")).alias("windows"))
    armed = stored(trees.join(windows, "tree"), "armed")

    found = _meetings(chunks, armed, lanes).mapInArrow(_negative_search(_schema(_FOUND), negatives), _FOUND)
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))
