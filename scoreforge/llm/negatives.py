"""Hard-negative mining (operator 12): score windows as distance annuli in vantage-point trees.

Each row gets one more component, so that all rows have the same length: the squared distance of an anchor (whose own further
component is 0) to a row is then a constant minus twice their inner product. A window of scores is an annulus around the anchor,
and its best rows are its nearest.

Rows are numbered by label and dealt to blocks of ``BLOCK_ROWS``, each with a vantage-point tree: a node splits its rows at the
median distance from its vantage point, or at a wide gap near it, and knows, for either half, the range of these distances, so
that the triangle inequality bounds the distance of an anchor to all rows of a node from both sides. Rows come out one after
another, nearest first; nodes outside the annulus, or without a fitting label, are never opened.

A first round finds each anchor's positives, in the blocks that hold its label; a second one the negatives, in all blocks. Anchors
travel in packs of ``PACK``; a block that meets more than ``TASK_PACKS`` packs is copied, so that tasks stay bounded. What each
block finds (at most k rows a window) is merged by anchor.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreforge.operators.numbering import numbered

from . import common as C

LEAF, BLOCK_ROWS, PACK, TASK_PACKS = 256, 50_000, 256, 64
#: A gap between distances is wide from so many times the mean one on.
GAP = 8
#: The largest sum of products that is sure to fit.
MOST = 1 << 62

_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


class VantageTree:
    """Rows (integers) with labels; ``nearest`` gives those of a window of scores, best first."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        norms = np.einsum("ij,ij->i", rows, rows)
        self.longest = int(norms.max())
        points = np.concatenate([rows, np.sqrt((self.longest - norms).astype(np.float64))[:, None]], axis=1)
        order = np.arange(len(ids))
        vantage, kids, spans, ranges, depth = [], [], [], [], []
        todo = [(0, len(ids), -1, 0, (0.0, math.inf), 0)]
        while todo:
            a, b, parent, side, reach, level = todo.pop()
            no = len(spans)
            spans.append((a, b))
            ranges.append(reach)
            depth.append(level)
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = no
            own = order[a:b]
            eye = points[own[0]]
            if b - a > leaf:
                far = np.linalg.norm(points[own] - eye, axis=1)
                eye = points[own[int(far.argmax())]]  # a point at the rim sees more differences
                far = np.linalg.norm(points[own] - eye, axis=1)
                by = np.argsort(far, kind="stable")
                order[a:b], far = own[by], far[by]
                mid = _cut(far)
                todo += [(a, a + mid, no, 0, (far[:mid].min(), far[:mid].max()), level + 1), (a + mid, b, no, 1, (far[mid:].min(), far[mid:].max()), level + 1)]
            vantage.append(eye)
        self.vantage, self.kids, self.spans = np.array(vantage), kids, spans
        self.low, self.high = (np.array([r[i] for r in ranges]) for i in (0, 1))
        self.parent = np.full(len(spans), -1)
        for no, (left, right) in enumerate(kids):
            if left >= 0:
                self.parent[[left, right]] = no
        depth = np.array(depth)
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        self.rid, self.ids, self.labels, self.rows = rid[order], ids[order], labels[order], rows[order]
        self.exact = self.rows.astype(np.float64)
        self.most = int(np.abs(rows).max(initial=0))
        self.least_label = np.array([self.labels[a:b].min() for a, b in spans])
        self.most_label = np.array([self.labels[a:b].max() for a, b in spans])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and least scores that rows of each node can have with each query (a row a query)."""
        q = queries.astype(np.float64)
        norms = np.einsum("ij,ij->i", q, q)
        squares = np.einsum("ij,ij->i", self.vantage, self.vantage)
        away = np.sqrt(np.maximum(norms[:, None] + squares[None, :] - 2 * (q @ self.vantage[:, :-1].T), 0))
        near, far = np.zeros_like(away), np.full_like(away, math.inf)
        for nodes in self.levels:
            up = self.parent[nodes]
            near[:, nodes] = np.maximum(near[:, up], np.maximum(self.low[nodes] - away[:, up], away[:, up] - self.high[nodes]))
            far[:, nodes] = np.minimum(far[:, up], away[:, up] + self.high[nodes])
        whole = norms + self.longest
        slack = 1 + 1e-6 * whole[:, None]  # distances are roots in floating point
        return (whole[:, None] - near * near) / 2 + slack, (whole[:, None] - far * far) / 2 - slack

    def nearest(self, query: np.ndarray, most: np.ndarray, least: np.ndarray, own: int, label: int, same: bool, low: float, high: float, seen: dict):
        """(score, id, rid) of rows of the label (or of others) but ``own``, scores from ``low`` to ``high``: best first, ties to smaller ids.
        ``most`` and ``least`` are the bounds of the query's nodes; ``seen`` keeps its scores by leaf."""
        # best first; at equal scores nodes before rows, as they may hold smaller ids
        heap = [(-math.inf, 0, 0, 0, 0, None)]
        small = self.most * int(np.abs(query).max(initial=0)) * len(query) < 1 << 52  # then products are exact in floating point
        while heap:
            score, kind, vec, rid, no, run = heapq.heappop(heap)
            if kind:
                yield -score, vec, rid
                scores, at = run
                if no + 1 < len(at):
                    i = at[no + 1]
                    heapq.heappush(heap, (-int(scores[i]), 1, int(self.ids[i]), int(self.rid[i]), no + 1, run))
                continue
            left, right = self.kids[no]
            if left >= 0:
                for kid in (left, right):
                    one, other = self.least_label[kid], self.most_label[kid]
                    fits = one <= label <= other if same else not one == label == other
                    if fits and most[kid] >= low and least[kid] <= high:
                        heapq.heappush(heap, (-most[kid], 0, 0, 0, kid, None))
                continue
            if no not in seen:
                a, b = self.spans[no]
                seen[no] = (self.exact[a:b] @ query.astype(np.float64)).astype(np.int64) if small else self.rows[a:b] @ query
            a, b = self.spans[no]
            scores = seen[no]
            fit = (scores >= low) & (scores <= high) & ((self.labels[a:b] == label) == same) & (self.rid[a:b] != own)
            at = np.flatnonzero(fit)
            if len(at):
                at = at[np.lexsort((self.rid[a:b][at], self.ids[a:b][at], -scores[at]))]
                whole = _Leaf(a, scores)
                heapq.heappush(heap, (-int(scores[at[0]]), 1, int(self.ids[a + at[0]]), int(self.rid[a + at[0]]), 0, (whole, (a + at).tolist())))


def _cut(far: np.ndarray) -> int:
    """Where ascending distances are parted: in the middle, or at a wide gap of the middle half, so that a cluster stays whole."""
    first = len(far) // 4
    gaps = np.diff(far[first : len(far) - first])
    return first + 1 + int(gaps.argmax()) if gaps.max() > GAP * gaps.mean() else len(far) // 2


class _Leaf:
    """Scores of a leaf's rows by their places in the tree."""

    def __init__(self, first: int, scores: np.ndarray):
        self.first, self.scores = first, scores

    def __getitem__(self, i: int) -> int:
        return self.scores[i - self.first]

    def __lt__(self, other) -> bool:
        return self.first < other.first


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(-1, dim)


def _pack_vectors(scale: int):
    def run(batches):
        for batch in batches:
            vecs = batch.column(2)
            lens = pa.compute.fill_null(pa.compute.list_value_length(vecs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.floor(vecs.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
            offs = np.concatenate([[0], np.cumsum(lens)])
            out = []
            for i, (vec, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = whole[offs[i] : offs[i + 1]]
                if vec is None or label is None or not len(own) or not np.isfinite(own).all():
                    continue
                if float(np.abs(own).max()) ** 2 * len(own) >= MOST:
                    raise ValueError(f"the scores of vector {vec} need more than 64 bits")
                out.append((vec, label, len(own), own.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (_L, _L, _I, _B))], ["vec_id", "label", "dim", "packed"])

    return run


#: Anchors of one length (and label, in the first round) that travel together: their numbers, labels and vectors, and for each the
#: scores of its positives (8-byte integers, ``POSITIVES`` an anchor, filled up with the least integer).
PACKS = "dim int, label long, n int, rids binary, labels binary, vectors binary, scores binary"
_PACKS = pa.schema([("dim", _I), ("label", _L), ("n", _I), ("rids", _B), ("labels", _B), ("vectors", _B), ("scores", _B)])
VOID = -(1 << 63)


def _packs(by_label: bool, width: int):
    """Rows (dim, label, rid, packed, scores) come in order of dim and, if asked, label."""

    def flush(key, held):
        rids, labels, vectors, scores = zip(*held)
        ints = lambda x: np.array(x, "<i8").tobytes()
        scores = ints([[*s, *[VOID] * (width - len(s))] for s in scores])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key[0], key[1], len(held), ints(rids), ints(labels), b"".join(vectors), scores), _PACKS)], schema=_PACKS)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for dim, label, rid, packed, scores in zip(*(batch.column(i).to_pylist() for i in range(5))):
                now = (dim, label if by_label else None)
                if held and (now != key or len(held) == PACK):
                    yield flush(key, held)
                    held = []
                key = now
                held.append((rid, label, packed, scores or []))
        if held:
            yield flush(key, held)

    return run


FOUND = "rid long, place int, score long, vec_id long, found long"
_FOUND = pa.schema([("rid", _L), ("place", _I), ("score", _L), ("vec_id", _L), ("found", _L)])


def _search(k: int, width: int, percent: tuple[int, int, int]):
    """Rows in order of (block, copy, kind, dim): a block's rows by length, then packs. Without positives a pack asks for its own label's
    best ``k``, else for the best ``k`` of each positive's window."""
    least_part, whole, most_part = percent

    def answer(tree: VantageTree, dim: int, rids: bytes, labels: bytes, vectors: bytes, scores: bytes):
        queries = _matrix([vectors], dim)
        if tree.most * int(np.abs(queries).max()) * dim >= MOST:
            raise ValueError("scores need more than 64 bits")
        most, least = tree.bounds(queries)
        wanted = np.frombuffer(scores, "<i8").reshape(len(queries), -1)
        out = []
        for i, (rid, label) in enumerate(zip(np.frombuffer(rids, "<i8").tolist(), np.frombuffer(labels, "<i8").tolist())):
            if not width:
                out += [(rid, 0, *x) for x in islice(tree.nearest(queries[i], most[i], least[i], rid, label, True, -math.inf, math.inf, {}), k)]
                continue
            seen: dict = {}
            for place, p in enumerate(wanted[i].tolist()):
                low, high = -(-least_part * p // whole), most_part * p // whole
                if p != VOID and low <= high:
                    out += [(rid, place, *x) for x in islice(tree.nearest(queries[i], most[i], least[i], rid, label, False, low, high, seen), k)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _FOUND)], schema=_FOUND)

    def run(batches):
        place, trees, held = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["block"], row["copy"])
                if now != place:
                    place, trees, held = now, {}, {}
                dim = row["dim"]
                if row["kind"] == 0:
                    held.setdefault(dim, []).append((row["rid"], row["vec_id"], row["label"], row["vectors"]))
                    continue
                if dim in held:
                    rid, ids, labels, packed = zip(*held.pop(dim))
                    trees = {dim: VantageTree(np.array(rid), np.array(ids), np.array(labels), _matrix(packed, dim))}
                if dim in trees:
                    yield answer(trees[dim], dim, row["rids"], row["labels"], row["vectors"], row["scores"])

    return run


def _met(rows: DataFrame, packs: DataFrame, k: int, width: int, percent: tuple[int, int, int], task_packs: int) -> DataFrame:
    """What each block finds for each pack that is sent to it (column block)."""
    copies = packs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(task_packs)).cast("int").alias("copies"))  # a row a block
    none = lambda kind: F.lit(None).cast(kind)
    cols = ["block", "copy", "kind", "dim", "rid", "vec_id", "label", "rids", "labels", "vectors", "scores"]
    asked = packs.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("rids"), F.col("copies")).cast("int"))
    asked = asked.select("block", "copy", F.lit(1).alias("kind"), "dim", none("long").alias("rid"), none("long").alias("vec_id"), none("long").alias("label"), "rids", "labels", "vectors", "scores")
    held = rows.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    held = held.select("block", "copy", F.lit(0).alias("kind"), "dim", "rid", "vec_id", "label", none("binary").alias("rids"), none("binary").alias("labels"), F.col("packed").alias("vectors"), none("binary").alias("scores"))
    both = held.unionByName(asked).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind", "dim").select(*cols)
    return both.mapInArrow(_search(k, width, percent), FOUND)


def _sent(packs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each pack and each block between ``first`` and ``last`` of its keys."""
    joined = packs.join(spans, keys)
    return joined.withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")


def mine(
    embeddings: DataFrame, k: int = 3, positives: int = 5, every: int = 50, scale: int = 256, percent: tuple[int, int, int] = (50, 100, 95), block_rows: int = BLOCK_ROWS, task_packs: int = TASK_PACKS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row of ``embeddings`` (vec_id,
    embedding, label) whose vec_id is divisible by ``every``) and each of its ``positives`` best rows of the same label, the
    ``k`` best rows of other labels whose score is between the first and last of ``percent`` (of the middle one) of the positive's.

    Components are floor(scale * x), a score is an inner product; ties go to smaller ids. Rows with a null id, label or vector,
    an empty vector, or a null or non-finite component take no part; only vectors of equal length meet; one whose scores need
    more than 62 bits is an error. Rows that repeat an id, or all of a row, are rows of their own. Fewer rows give fewer
    results; a positive of negative score has no window; an empty table gives no rows; further columns are ignored.
    """
    given = embeddings.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"), F.col("`embedding`").cast("array<double>").alias("embedding"))
    rows = C.checkpointed(given.mapInArrow(_pack_vectors(scale), "vec_id long, label long, dim int, packed binary").withColumn("rid", F.monotonically_increasing_id()))
    rows = numbered(rows, ["dim", "label", F.xxhash64("rid"), F.col("rid")])
    rows = C.checkpointed(rows.select("dim", "label", "rid", "vec_id", "packed", F.floor(F.col("no") / block_rows).alias("block")))
    spans = C.checkpointed(rows.groupBy("dim", "label").agg(F.min("block").alias("first"), F.max("block").alias("last")))  # a row a label
    anchors = rows.where(F.col("vec_id") % every == 0).select("dim", "label", "rid", "packed", "vec_id")
    none = F.array().cast("array<long>")
    asked = anchors.select("dim", "label", "rid", "packed", none.alias("scores")).sortWithinPartitions("dim", "label").mapInArrow(_packs(True, 0), PACKS)
    found = _met(rows, _sent(asked, spans, ["dim", "label"]).drop("label"), positives, 0, percent, task_packs)
    best = W.partitionBy("rid").orderBy(F.desc("score"), "vec_id", "found")
    near = C.checkpointed(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))
    scores = near.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    asked = anchors.join(scores, "rid").select("dim", "label", "rid", "packed", "scores")
    asked = asked.repartition("dim", F.pmod("rid", F.lit(97))).sortWithinPartitions("dim").mapInArrow(_packs(False, positives), PACKS)
    whole = spans.groupBy("dim").agg(F.min("first").alias("first"), F.max("last").alias("last"))  # a row a length
    found = _met(rows, _sent(asked.drop("label"), whole, ["dim"]), k, positives, percent, task_packs)
    best = W.partitionBy("rid", "place").orderBy(F.desc("score"), "vec_id", "found")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("rid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("rid", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(near, ["rid", "place"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows: list[tuple], k: int = 3, positives: int = 5, every: int = 50, scale: int = 256, percent: tuple[int, int, int] = (50, 100, 95)) -> list[tuple]:
    """The same by comparing all pairs of (vec_id, label, embedding): for tests."""
    least, whole, most = percent
    good = [(v, y, [math.floor(scale * x) for x in e]) for v, y, e in rows if v is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (v, y, e) in enumerate(good):
        if v % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), w, z) for j, (w, z, f) in enumerate(good) if j != i and len(f) == len(e))
        for p, pid, _ in [s for s in scored if s[2] == y][:positives]:
            fit = [(s, w) for s, w, z in scored if z != y and least * -p <= whole * -s <= most * -p]
            out += [(v, pid, rank + 1, w, -p, -s) for rank, (s, w) in enumerate(fit[:k])]
    return out
