"""Exact top-k search by inner product (operator 3): a KD-tree in each shard.

A sample of the rows gives the top of one KD-tree, cut at medians of the widest component; its leaves are the shards, to which
all rows are dealt. Shards of over ``shard_rows`` rows fall into blocks of about that many, by a hash. A block's own tree goes
on with median splits; each node keeps the tight bounding box of its rows. For a query, the sum of the larger of ``q * low``
and ``q * high`` bounds every score in a box from above; nodes are taken best bound first until the best one left is below
the k-th score found.

A first round searches each query in its own block and notes the box of each block. The k-th score found there is handed
on: in the second round a query is sent only to shards whose box reaches it, and the search starts from it there. Queries travel
in packs of ``PACK``, a row for a pack and block. Blocks that get very many queries are copied, one copy for ``asked_rows`` of
them, so no task holds more than a block and that many.

Where vectors lie evenly in many dimensions no box can be skipped, and every query meets every block; the README says how many.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

LEAF, SHARD_ROWS, ASKED_ROWS = 128, 20_000, 20_000
#: Queries that travel together.
PACK = 512
#: Bytes of all shards' boxes, which are broadcast: they bound the number of shards. Sampled rows a shard.
BOX_BYTES, SAMPLE = 1 << 25, 8
#: Blocks of which numbers are broadcast (24 bytes each).
BROADCAST_ROWS = 500_000
#: No bound yet.
NONE = -(1 << 62)


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """int64 rows of vectors packed with four or eight bytes a component."""
    if len({len(p) for p in packed}) > 1:
        return np.stack([np.frombuffer(p, f"<i{len(p) // dim}").astype(np.int64) for p in packed])
    width = len(packed[0]) // dim
    return np.frombuffer(b"".join(packed), f"<i{width}").reshape(-1, dim).astype(np.int64)


def _most(rows: np.ndarray) -> int:
    return int(max(abs(int(rows.max())), abs(int(rows.min())))) if rows.size else 0


class Splits:
    """The top of the tree: which shard a row belongs to."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.feature, self.cut, self.kids = [], [], []  # kids: a node, or less than 0 for a shard
        self.leaves = 0
        todo = [(np.arange(len(sample)), leaves, -1, 0)]
        while todo:
            at, many, parent, side = todo.pop()
            own = sample[at]
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(at) > 1 and many > 1 else -1
            values = np.unique(own[:, wide]) if wide >= 0 else []
            if len(values) < 2:
                self.leaves += 1
                no = -self.leaves
            else:
                no = len(self.feature)
                middle = np.sort(own[:, wide])[min(len(at) - 1, max(1, round(len(at) * (many // 2) / many)))]
                cut = max(int(middle), int(values[1]))
                self.feature.append(wide)
                self.cut.append(cut)
                self.kids.append([0, 0])
                low = own[:, wide] < cut
                todo += [(at[~low], many - many // 2, no, 1), (at[low], many // 2, no, 0)]
            if parent >= 0:
                self.kids[parent][side] = no
        self.feature, self.cut, self.kids = np.array(self.feature, np.int64), np.array(self.cut, np.int64), np.array(self.kids, np.int64).reshape(-1, 2)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64) if len(self.feature) else np.full(len(rows), -1)
        live = np.flatnonzero(node >= 0)
        while len(live):
            no = node[live]
            node[live] = self.kids[no, (rows[live, self.feature[no]] >= self.cut[no]).astype(np.int64)]
            live = live[node[live] >= 0]
        return -1 - node


class Tree:
    """Median splits with tight boxes; rows are kept leaf by leaf."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((rid, ids))
        spans, kids, low, high = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = rows[order[a:b]]
            no = len(spans)
            spans.append((a, b))
            kids.append([-1, -1])
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if parent >= 0:
                kids[parent][side] = no
            wide = int(np.argmax(high[no] - low[no]))
            if b - a > leaf and high[no][wide] > low[no][wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid, kind="introselect")]
                todo += [(a, a + mid, no, 0), (a + mid, b, no, 1)]
        self.spans, self.kids = spans, kids
        self.ids, self.rid = ids[order], rid[order]
        self.most = _most(rows)
        self.exact = rows[order], np.array(low), np.array(high)
        self.fast = tuple(x.astype(np.float64) for x in self.exact)

    def search(self, own: int, q: np.ndarray, k: int, least: int) -> list[tuple[int, int, int]]:
        """The k best (score, id, rid) of rows but ``own``, ties to smaller ids; scores under ``least`` may be left out."""
        whole = self.most * _most(q) * len(q) < 1 << 52  # then every product is exact in floating point
        rows, low, high = self.fast if whole else self.exact
        q = q.astype(rows.dtype)
        bounds = low @ np.minimum(q, 0) + high @ np.maximum(q, 0)
        heap, best = [(-bounds[0], 0)], []  # best: a heap of (score, -id, -rid), worst first
        while heap:
            bound, no = heapq.heappop(heap)
            if -bound < max(least, best[0][0] if len(best) == k else NONE):
                break
            left, right = self.kids[no]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            a, b = self.spans[no]
            scores = rows[a:b] @ q
            floor = max(least, best[0][0] if len(best) == k else NONE)
            for i in np.flatnonzero(scores >= floor).tolist():
                rid = int(self.rid[a + i])
                if rid != own:
                    item = (int(scores[i]), -int(self.ids[a + i]), -rid)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(s, -v, -r) for s, v, r in sorted(best, reverse=True)]


def _groups(batches, keys: int):
    """(key, rows) of each run of equal values in the first columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


#: Rows of the first round. kind 0: a score (rid and vec_id of the row found); 1: a block's box; 2: a query for the second round.
FOUND = "kind int, dim int, shard int, sub int, query long, query_id long, score long, rid long, vec_id long, low binary, high binary"
_I, _L, _B = pa.int32(), pa.int64(), pa.binary()
_FOUND = pa.schema(list(zip([x.split()[0] for x in FOUND.split(", ")], [_I] * 4 + [_L] * 5 + [_B] * 2)))
#: Queries that go to one block together: their numbers, ids, vectors (8 bytes a component) and bounds.
SENT = "dim int, shard int, sub int, n int, rids binary, ids binary, vectors binary, leasts binary"
_SENT = pa.schema([("dim", _I), ("shard", _I), ("sub", _I), ("n", _I), ("rids", _B), ("ids", _B), ("vectors", _B), ("leasts", _B)])
SCORES = "query long, query_id long, score long, rid long, vec_id long"
_SCORES = pa.schema([(x.split()[0], _L) for x in SCORES.split(", ")])


def _assigned(splits):
    def run(batches):
        known = splits.value
        for batch in batches:
            dims, packed = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            shard = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in known and len(known[dim].feature):
                    shard[at] = known[dim].assign(_matrix([packed[i] for i in at.tolist()], dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["dim", "rid", "vec_id", "packed", "shard"])

    return run


def _first_round(k: int, every: int):
    """Rows in order of (dim, shard, sub)."""

    def run(batches):
        for (dim, shard, sub), table in _groups(batches, 3):
            packed = table.column("packed").to_pylist()
            rid, ids = table.column("rid").to_numpy(), table.column("vec_id").to_numpy()
            tree = Tree(rid, ids, _matrix(packed, dim))
            low, high = (x[0].astype("<i8").tobytes() for x in tree.exact[1:])
            out = [(1, dim, shard, sub, None, None, None, None, None, low, high)]
            for i in np.flatnonzero(ids % every == 0).tolist():
                own, vec = int(rid[i]), int(ids[i])
                best = tree.search(own, _matrix(packed[i : i + 1], dim)[0], k, NONE)
                out += [(0, dim, shard, sub, own, vec, s, r, v, None, None) for s, v, r in best]
                out.append((2, dim, shard, sub, own, vec, best[-1][0] if len(best) == k else NONE, None, None, packed[i], None))
            yield _batch(out, _FOUND)

    return run


def _box_of_shard(batches):
    """Rows (dim, shard, low, high) in order of (dim, shard): one for each shard."""
    for (dim, shard), table in _groups(batches, 2):
        low = np.min([np.frombuffer(x, "<i8") for x in table.column("low").to_pylist()], axis=0)
        high = np.max([np.frombuffer(x, "<i8") for x in table.column("high").to_pylist()], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([dim], _I), pa.array([shard], _I), pa.array([low.tobytes()], _B), pa.array([high.tobytes()], _B)], ["dim", "shard", "low", "high"])


def _reached(q: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which boxes (columns) may hold a score of at least ``least`` for each query (rows)."""
    kind = np.float64 if max(_most(low), _most(high)) * _most(q) * q.shape[1] < 1 << 52 else np.int64
    q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
    return np.minimum(q, 0) @ low.T + np.maximum(q, 0) @ high.T >= least[:, None]


def _sent(boxes):
    """Queries, packed, with the blocks of the shards that they must see, but for their own block."""

    def run(batches):
        known = boxes.value
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                rows = batch.slice(at, PACK).to_pylist()
                for dim in sorted({r["dim"] for r in rows}):
                    shards, subs, low, high = known[dim]
                    asked = [r for r in rows if r["dim"] == dim]
                    q = _matrix([r["low"] for r in asked], dim)
                    rids, ids, leasts, shard, sub = (np.array([r[c] for r in asked], np.int64) for c in ("query", "query_id", "score", "shard", "sub"))
                    met, out = _reached(q, low, high, leasts), []
                    for j in np.flatnonzero(met.any(axis=0)).tolist():
                        for s in range(subs[j]):
                            mine = np.flatnonzero(met[:, j] & ~((shard == shards[j]) & (sub == s)))
                            if len(mine):
                                out.append((dim, shards[j], s, len(mine), *(x[mine].astype("<i8").tobytes() for x in (rids, ids, q, leasts))))
                    yield _batch(out, _SENT)

    return run


def _second_round(k: int):
    """Rows in order of (dim, shard, sub, copy, kind): a block, then the packs of queries sent to it."""

    def run(batches):
        place, tree = None, None
        for (*where, kind), table in _groups(batches, 5):
            dim = where[0]
            if kind == 0:
                place, tree = where, Tree(table.column("rid").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("packed").to_pylist(), dim))
            elif place == where:
                for packed in zip(*(table.column(c).to_pylist() for c in ("rids", "ids", "packed", "leasts"))):
                    rids, ids, vectors, leasts = (np.frombuffer(x, "<i8") for x in packed)
                    out = []
                    for own, vec, q, least in zip(rids.tolist(), ids.tolist(), vectors.reshape(-1, dim), leasts.tolist()):
                        out += [(own, vec, s, r, v) for s, v, r in tree.search(own, q, k, least)]
                    yield _batch(out, _SCORES)

    return run


def _shards(sizes: dict[int, int], shard_rows: int) -> dict[int, int]:
    """How many shards the rows of each length fall into: one for ``shard_rows`` rows, fewer if all boxes together were over ``BOX_BYTES``."""
    wanted = {dim: math.ceil(m / shard_rows) for dim, m in sizes.items()}
    fit = min(1.0, BOX_BYTES / max(1, sum(16 * dim * many for dim, many in wanted.items())))
    return {dim: max(1, int(many * fit)) for dim, many in wanted.items()}


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = SHARD_ROWS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k rows of highest inner product.

    Components are floor(scale * x). Vectors (and ids) that are null or hold null or non-finite components take no part, nor
    empty ones; vectors are compared with those of equal length only. A component is stored in 4 or 8 bytes, and one that needs
    more, or a product of two vectors that could, is an error. Every row counts for itself, also where rows repeat
    an id or are wholly equal: each such query has its k results under that id, and the others of the id are among its
    candidates. Ties go to smaller ids. Fewer rows than k give fewer results; an empty table none; further columns are ignored.
    """

    def pack(batches):
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), batch.column(1)
            out = []
            flat = vecs.flatten()
            offs = np.concatenate([[0], np.cumsum([0 if v is None else v for v in pa.compute.list_value_length(vecs).to_pylist()])]).astype(np.int64)
            whole = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
            for i, vec in enumerate(ids):
                own = whole[offs[i] : offs[i + 1]]
                if vec is not None and len(own) and np.isfinite(own).all():
                    if float(np.abs(own).max()) ** 2 * len(own) >= 1 << 62:
                        raise ValueError(f"the scores of vector {vec} need more than 64 bits")
                    out.append((vec, len(own), own.astype("<i4" if np.abs(own).max() < 1 << 31 else "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((_L, _I, _B))], ["vec_id", "dim", "packed"])

    spark = embeddings.sparkSession
    src = embeddings.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("embedding"))
    rows = src.mapInArrow(pack, "vec_id long, dim int, packed binary").withColumn("rid", F.monotonically_increasing_id())  # written at once
    rows = checkpointed(rows).select("dim", "rid", "vec_id", "packed")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    n = sum(sizes.values())
    shards = _shards(sizes, shard_rows)
    splits: dict[int, Splits] = {}
    if max(shards.values(), default=1) > 1:
        share = min(1.0, SAMPLE * sum(shards.values()) / n)  # of as many numbers as the boxes have, times SAMPLE / 2
        drawn = rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 40)) < int(share * (1 << 40))).select("dim", "packed").collect()
        for dim in {r["dim"] for r in drawn}:
            splits[dim] = Splits(_matrix([bytes(r["packed"]) for r in drawn if r["dim"] == dim], dim), shards[dim])
    placed = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(splits)), "dim int, rid long, vec_id long, packed binary, shard int")
    blocks = checkpointed(placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("subs")))  # a row a shard
    dealt = placed.join(F.broadcast(blocks), ["dim", "shard"]).withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int"))
    dealt = dealt.select("dim", "shard", "sub", "rid", "vec_id", "packed")
    block = ["dim", "shard", "sub"]
    first = checkpointed(dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_first_round(k, every), FOUND))
    found = first.where("kind = 0").select("query", "query_id", "score", "rid", "vec_id")
    subs = {(r["dim"], r["shard"]): r["subs"] for r in blocks.collect()}  # a row a shard
    if sum(subs.values()) > len(sizes):
        boxes = first.where("kind = 1").select("dim", "shard", "low", "high").repartition("dim", "shard").sortWithinPartitions("dim", "shard")
        boxes = boxes.mapInArrow(_box_of_shard, "dim int, shard int, low binary, high binary").collect()  # BOX_BYTES at most
        known = {}
        for dim in sizes:
            own = [b for b in boxes if b["dim"] == dim]
            low, high = (np.array([np.frombuffer(bytes(b[c]), "<i8") for b in own]) for c in ("low", "high"))
            known[dim] = [b["shard"] for b in own], [subs[dim, b["shard"]] for b in own], low, high
        sent = first.where("kind = 2").mapInArrow(_sent(spark.sparkContext.broadcast(known)), SENT)
        sent = checkpointed(sent)
        copies = checkpointed(sent.groupBy(*block).agg(F.ceil(F.sum("n") / F.lit(asked_rows)).cast("int").alias("copies")))  # a row a block
        copies = F.broadcast(copies) if sum(subs.values()) <= BROADCAST_ROWS else copies
        asked = sent.join(copies, block).withColumn("copy", F.pmod(F.xxhash64("rids", F.lit(3)), F.col("copies")).cast("int"))
        held = dealt.join(copies, block).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        place = [*block, "copy", "kind"]
        none = lambda kind: F.lit(None).cast(kind)
        both = held.select(*block, "copy", F.lit(0).alias("kind"), "rid", "vec_id", "packed", none("binary").alias("rids"), none("binary").alias("ids"), none("binary").alias("leasts"))
        both = both.unionByName(asked.select(*block, "copy", F.lit(1).alias("kind"), none("long").alias("rid"), none("long").alias("vec_id"), F.col("vectors").alias("packed"), "rids", "ids", "leasts"))
        found = found.unionByName(both.repartition(*place[:-1]).sortWithinPartitions(*place).mapInArrow(_second_round(k), SCORES))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
