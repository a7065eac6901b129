"""N-gram Jaccard join (operator 4): prefix index lists with set-relation skipping, and the components of its links.

1. Each text becomes its set of word shingles: 64-bit hashes made with a secret that each run draws, so that no texts can be
   built whose shingles agree; by chance two do once in 2**64 pairs. Equal sets are one class, known by 64 bits of the
   set, by 64 others where two different sets share the first (128 also for a set of one shingle). The shingles' counts
   over all documents, kept in a sketch of some million cells, give one order of all shingles, rare ones first.
2. Two sets that reach the similarity share a shingle among their first ``n - ceil(similarity * n) + 1`` in that order. These
   are dealt by shingle into index lists. A list is sorted by size and cut into blocks that know the farthest reach of their
   entries; an entry's partners by size are one window of the list, in which blocks whose reach falls short of the
   overlap that a link needs are skipped. Entries without any partner leave (index-level skipping).
3. The others of a list join the group of the list's least class. Lists of near copies mostly have one least class, so a
   text travels once a group and not once a list. Groups of over ``BLOCK`` classes meet as pairs of blocks. In a group the
   overlaps of a set with all others are derived from those of the most similar set already computed, by the shingles in
   which the two differ (answer-level skipping). A pair counts in the least group that both are in.
4. Large-star and small-star rounds give the components.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreforge.session import size_of

from . import common as C
from .shingles import shingle_sets

#: Cells of the sketch as a power of two: the least, and the most, which a broadcast holds in 16 MB. In between they grow with the
#: input, from ``SKETCH_BYTES`` on.
CELL_BITS, MOST_CELL_BITS, SKETCH_BYTES = 20, 24, 100 << 30
PARTS = 64
#: Bytes of text that are taken apart together, unless one text is longer.
CHUNK = 1_000_000
BLOCK, SKIP = 1024, 32
#: Shingles that so many documents may have get no list in one task: Spark finds their least class. By the sketch, a shingle that
#: stands out from the mean of all cells ``NOISE`` times: cells that are full of rare shingles are not mistaken for frequent ones.
HOT, NOISE = 100_000, 16
#: Entries of one list that a task holds; a longer list joins the group of its least class as it streams by.
LIST_ROWS = 1_000_000
#: Sets that differ in less than this share of their shingles count as highly similar.
CLOSE = 0.5


def cell_bits(size: int) -> int:
    """Cells of the sketch for an input of ``size`` bytes, as a power of two."""
    return min(MOST_CELL_BITS, CELL_BITS + max(0, (size // SKETCH_BYTES).bit_length()))


def frequent(cells: np.ndarray, hot: int) -> float:
    """The count of a cell from which its shingles count as ``hot``."""
    return max(hot, NOISE * float(cells.mean()))


def _need(t: int, a, b):
    """The least overlap of a link between sets of the given sizes."""
    return -(-t * (a + b) // (100 + t))


def prefix_size(t: int, n):
    return n - -(-t * n // 100) + 1


def _signature(h: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice 64 bits of each set; the second also takes in what the hashes of shingles do not hold."""
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt, more in ((0x5851F42D4C957F2D, np.zeros_like(least)), (0x14057B7EF767814F, least)):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(C.mix(h ^ np.uint64(salt)), out=run[1:])
        out.append(C.mix((run[at[1:]] - run[at[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)) ^ C.mix(more)).view(np.int64))
    return out[0], out[1]


def _classes_of(h: np.ndarray, n: np.ndarray, least: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The class of each set: its first 64 bits, the others where different sets share those."""
    one, two = _signature(h, n, least)
    return np.where(np.isin(one, clash), two, one) if len(clash) else one


def _first_pass(k: int, secret: bytes, bits: int):
    """Per row its set's size and signature; then, as rows of part >= 0, what the task counted of each cell."""
    names = ["doc_id", "key", "one", "two", "n", "part", "cells"]

    def run(batches):
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col, CHUNK):
                h, n, least = shingle_sets(col.slice(a, b - a), k, secret)
                cells += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=len(cells))
                m = b - a
                one, two = _signature(h, n, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array(one), pa.array(two), pa.array(n), pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary())], names)
        if cells.any():
            parts = cells.astype("<u4").reshape(PARTS, -1)  # a task reads far fewer words
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([*[none] * 5, pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return run


def _sum_cells(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(cells, "<u4").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["part", "cells"])


def _level(count: np.ndarray) -> np.ndarray:
    """The class of frequency of a count: half powers of two."""
    return (2 * np.log2(count + 1)).astype(np.uint8)


def _cell(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (len(level).bit_length() - 1))).astype(np.int64)


def _ordered(h: np.ndarray, n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The sets' hashes in the common order (by level, then hash), set by set; they come ascending."""
    lv, out = level[_cell(h, level)], h.copy()
    cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            out[a:b] = h[a:b][np.argsort(lv[a:b], kind="stable")]
    return out


def _prefixes(k: int, t: int, secret: bytes, level, from_level: int, clash: np.ndarray):
    def run(batches):
        lv = level.value
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col, CHUNK):
                h, n, least = shingle_sets(col.slice(a, b - a), k, secret, len(clash) > 0)
                rid = _classes_of(h, n, least, clash)
                one = np.unique(rid, return_index=True)[1]
                one = one[n[one] > 0]
                h = _ordered(h, n, lv)
                p = prefix_size(t, n[one])
                start = (np.cumsum(n) - n)[one]
                token = C.gather(h, start, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(np.repeat(rid[one], p)), pa.array(np.repeat(n[one], p).astype(np.int32)), pa.array(C.gather(np.arange(int(p.max()) if len(p) else 0), np.zeros(len(p), np.int64), p).astype(np.int32)), pa.array(lv[_cell(token, lv)] >= from_level)],
                    ["token", "rid", "n", "pos", "hot"],
                )

    return run


def _greatest(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of ``v[lo[i]:hi[i]]`` (below all if empty): whole blocks by their own greatest, the ends entry by entry."""
    least = np.iinfo(np.int64).min
    out = np.full(len(lo), least)
    padded = np.full(-(-max(len(v), 1) // SKIP) * SKIP, least)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, SKIP).max(axis=1)
    first, last = -(-lo // SKIP), hi // SKIP
    over = np.flatnonzero(first < last)
    if len(over):
        a, b = first[over], last[over]
        power = np.log2(b - a).astype(np.int64)
        best = np.full(len(over), least)
        for k in range(int(power.max()) + 1):  # blocks: the greatest of 2**k blocks from each on
            at = np.flatnonzero(power == k)
            best[at] = np.maximum(blocks[a[at]], blocks[b[at] - (1 << k)])
            blocks = np.maximum(blocks[: len(blocks) - (1 << k)], blocks[1 << k :]) if len(blocks) > 1 << k else blocks[:0]
        out[over] = best
    whole = first < last
    for s, e in ((lo, np.where(whole, first * SKIP, hi)), (np.where(whole, last * SKIP, hi), hi)):
        live = np.flatnonzero(s < e)
        at, end = s[live], e[live]
        while len(live):
            out[live] = np.maximum(out[live], v[at])
            on = at + 1 < end
            live, at, end = live[on], at[on] + 1, end[on]
    return out


def meeting(no: np.ndarray, n: np.ndarray, pos: np.ndarray, t: int) -> np.ndarray:
    """Which entries of index lists (list ``no``, size, position; in order of list and size) can link with another of the list.

    From a common shingle at their positions on, two sets share ``n - pos`` shingles at most. That ``n - pos`` reaches the
    overlap which a link with a set of size m needs means ``(100 + t) * (n - pos) - t * n >= t * m``: the left side is
    the entry's reach. Partners lie in a window of sizes, and must reach the entry's own size.
    """
    reach = (100 + t) * (n - pos) - t * n
    base = no * (100 * int(n.max()) + 1)
    at = np.arange(len(n))
    by_size, scaled = base + t * n, base + 100 * n
    lo = np.searchsorted(scaled, base + t * n)
    hi = np.minimum(at, np.searchsorted(by_size, base + np.maximum(reach, 0), side="right"))
    met = _greatest(reach, lo, hi) >= t * n
    hi = np.searchsorted(by_size, base + np.maximum(np.minimum(reach, 100 * n), 0), side="right")
    return met | (_greatest(reach, at + 1, hi) >= t * n)


def _lists(t: int):
    """Rows come in order of (token, rid). Gives (pivot, rid): which classes are in which groups."""

    def run(batches):
        keep, streamed = [np.zeros(0, np.int64)] * 4, None  # streamed: a list too long to hold, and its least class
        for batch in batches:
            cols = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(keep)]
            if streamed is not None:
                on = int(np.searchsorted(cols[0], streamed[0], side="right"))
                yield from _streamed(streamed[1], cols[1][:on])
                cols = [c[on:] for c in cols]
                streamed = streamed if not len(cols[0]) else None
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            yield from _settle([c[:cut] for c in cols], t)
            keep = [c[cut:] for c in cols]
            if len(keep[0]) > LIST_ROWS:
                streamed = int(keep[0][0]), int(keep[1][0])
                yield from _streamed(streamed[1], keep[1])
                keep = [k[:0] for k in keep]
        yield from _settle(keep, t)

    return run


def _streamed(pivot: int, rid: np.ndarray):
    rid = np.unique(rid)
    if len(rid):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), pivot)), pa.array(rid)], ["pivot", "rid"])


def _settle(cols: list[np.ndarray], t: int):
    token, rid, n, pos = cols
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (rid[1:] != rid[:-1])  # of rows of one class one
    token, rid, n, pos = token[new], rid[new], n[new].astype(np.int64), pos[new].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(token)]]))
    no = np.repeat(np.arange(len(start)), size)
    on = size[no] > 1
    if not on.any():
        return
    rid, n, pos, no = rid[on], n[on], pos[on], no[on]
    order = np.lexsort((n, no))
    rid, n, pos, no = rid[order], n[order], pos[order], no[order]
    met = meeting(no, n, pos, t)
    rid, no = rid[met], no[met]
    if len(rid):
        head = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
        pivot = np.repeat(np.minimum.reduceat(rid, head), np.diff(np.append(head, len(no))))
        order = np.lexsort((rid, pivot))
        pivot, rid = pivot[order], rid[order]
        new = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (rid[1:] != rid[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(pivot[new]), pa.array(rid[new])], ["pivot", "rid"])


def group_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, settled: list[list[int]], t: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between the sets of one group: edges that hold them together, and each set's linked weight.

    ``settled`` are the other groups of each that come before this one: pairs that share one count there. ``side`` 0
    meets 1 only if both occur; if all are one side, all meet.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    uniq, ids = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(ids, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(uniq)))])
    posting = np.repeat(np.arange(m), size)[order]
    others: dict[int, list[int]] = {}
    for i, before in enumerate(settled):
        for p in before:
            others.setdefault(p, []).append(i)
    own = [ids[cuts[i] : cuts[i + 1]] for i in range(m)]  # ascending, as the hashes are
    count = lambda tokens: np.bincount(C.gather(posting, at[tokens], at[tokens + 1] - at[tokens]), minlength=m)
    overlaps = np.zeros((m, m), np.int32)  # at most (2 * BLOCK) ** 2, but for chance in dealing
    linked = np.zeros(m, np.int64)
    edges, root = [], np.arange(m)
    crossing = side.min() != side.max()

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(m):
        x = int(np.argmax(2 * overlaps[:y, y] - size[:y])) if y else -1
        if y and size[x] + size[y] - 2 * int(overlaps[x, y]) < CLOSE * size[y]:
            overlap = overlaps[x] - count(np.setdiff1d(own[x], own[y], assume_unique=True)) + count(np.setdiff1d(own[y], own[x], assume_unique=True))
        else:
            overlap = count(own[y])
        overlaps[y] = overlap
        hit = 100 * overlap >= t * (size + size[y] - overlap)
        hit[y] = False
        if crossing:
            hit &= side != side[y]
        for p in settled[y]:
            hit[others[p]] = False
        other = np.flatnonzero(hit)
        linked[y] = weight[other].sum()
        for z in other[other > y].tolist():
            a, b = top(y), top(z)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((y, z))
    return edges, linked


def _groups(k: int, t: int, secret: bytes, clash: np.ndarray):
    """Rows come in order of the group (pivot, lo, hi). Gives edges and, with the row itself as other, linked weights."""

    def settle(key, held):
        rows = sorted(held.values(), key=lambda r: r[0])
        if len(rows) < 2:
            return []
        side = np.array([r[2] for r in rows])
        if key[1] != key[2] and side.min() == side.max():
            return []
        edges, linked = group_links([r[4] for r in rows], np.array([r[1] for r in rows]), side, [[p for p in r[3] if p < key[0]] for r in rows], t)
        return [(rows[a][0], rows[b][0], 0) for a, b in edges] + [(rows[i][0], rows[i][0], int(linked[i])) for i in np.flatnonzero(linked)]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["rid", "other", "weight"])

    def run(batches):
        key, held, out = None, {}, []
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col, CHUNK):
                h, n, least = shingle_sets(col.slice(a, b - a), k, secret, len(clash) > 0)
                sign = _classes_of(h, n, least, clash).tolist()
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                pivot, lo, hi, rid, copies, side, pivots = (batch.column(i).slice(a, b - a).to_pylist() for i in range(7))
                for i in range(b - a):
                    if sign[i] != rid[i]:
                        continue  # another text under the same doc_id and hash
                    if key != (pivot[i], lo[i], hi[i]):
                        out += settle(key, held)
                        key, held = (pivot[i], lo[i], hi[i]), {}
                    if rid[i] not in held:  # of repeated rows one
                        held[rid[i]] = (rid[i], copies[i], side[i], pivots[i], h[at[i] : at[i + 1]].copy())
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
        out += settle(key, held)
        if out:
            yield batch_of(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): large-star and small-star rounds until nothing changes, each written to the shared folder."""
    now = C.checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).withColumnRenamed("u", "_u")
        big = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = C.checkpointed(big)
        C.forget(now)
        least = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = big.join(least, F.col("u") == F.col("_u"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
        now = C.checkpointed(small)
        C.forget(big)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == tuple(found):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(found)


def _linked(documents: DataFrame, k: int, t: int, block: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, key, rid, n), and the classes as (rid, least_id, key, copies, root, weight): key is the hash of
    a text, in the classes of one of least id; weight is the number of rows linked with each of the class, but for its own."""
    spark, secret, bits = documents.sparkSession, os.urandom(32), cell_bits(size_of(documents) or 0)
    own = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(F.col("`text`")).alias("key"), F.col("`text`").alias("text"))
    first = C.checkpointed(own.mapInArrow(_first_pass(k, secret, bits), "doc_id long, key long, one long, two long, n long, part int, cells binary"))
    stage = first.where("part = -1")
    shared = stage.where("n > 0").groupBy("one").agg(F.min("two").alias("_a"), F.max("two").alias("_b")).where("_a <> _b")
    clash = [r["one"] for r in shared.select("one").collect()]  # different sets of equal 64 bits: hardly any
    stage = stage.select("doc_id", "key", (F.when(F.col("one").isin(clash), F.col("two")).otherwise(F.col("one")) if clash else F.col("one")).alias("rid"), "n")
    clash = np.array(clash, np.int64)
    cells = np.zeros(1 << bits, np.int64).reshape(PARTS, -1)
    for r in first.where("part >= 0").select("part", "cells").repartition("part").mapInArrow(_sum_cells, "part int, cells binary").collect():  # a number a cell
        cells[r["part"]] += np.frombuffer(r["cells"], "<i8")
    levels, from_level = _level(cells.ravel()), int(_level(np.array(frequent(cells, hot))))
    level = spark.sparkContext.broadcast(levels)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))  # null ids come last
    classes = stage.where("n > 0").groupBy("rid").agg(F.min("doc_id").alias("least_id"), F.min_by("key", last).alias("key"), F.count(F.lit(1)).alias("copies"))
    classes = C.checkpointed(classes)
    tokens = own.select("doc_id", "text").mapInArrow(_prefixes(k, t, secret, level, from_level, clash), "token long, rid long, n int, pos int, hot boolean")
    some_hot = bool((levels >= from_level).any())
    cold = tokens.where("not hot") if some_hot else tokens
    met = cold.select("token", "rid", "n", "pos").repartition("token").sortWithinPartitions("token", "rid").mapInArrow(_lists(t), "pivot long, rid long")
    if some_hot:
        entries = tokens.where("hot").select("token", "rid")
        least = entries.groupBy("token").agg(F.min("rid").alias("pivot"), F.max("rid").alias("_most")).where("pivot < _most").select(F.col("token").alias("_t"), "pivot")
        met = met.unionByName(entries.join(least, F.col("token") == F.col("_t")).select("pivot", "rid"))
    met = C.checkpointed(met.distinct())
    blocks = met.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    mine = met.join(blocks, "pivot").withColumn("m", F.pmod(F.xxhash64("rid", F.lit(11)), F.col("blocks")).cast("int"))
    mine = mine.groupBy("rid").agg(F.collect_list(F.struct("pivot", "m", "blocks")).alias("groups"))  # of one set: at most its prefix
    asked = classes.join(mine, "rid").select(F.col("rid").alias("asked"), F.col("least_id").alias("_d"), F.col("key").alias("_k"), "copies", "groups")
    rows = own.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("text", "asked", "copies", F.transform("groups", lambda g: g["pivot"]).alias("pivots"), F.explode("groups").alias("g"))
    rows = rows.select("text", "asked", "copies", "pivots", "g.*", F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)).alias("o"))
    rows = rows.select("pivot", F.least("m", "o").alias("lo"), F.greatest("m", "o").alias("hi"), F.col("asked").alias("rid"), "copies", F.when(F.col("m") <= F.col("o"), 0).otherwise(1).alias("side"), "pivots", "text")
    links = rows.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi").mapInArrow(_groups(k, t, secret, clash), "rid long, other long, weight long")
    links = C.checkpointed(links)
    C.forget(met)
    weight = links.groupBy("rid").agg(F.sum("weight").alias("_w"))
    roots = components(links.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    known = classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(weight, "rid", "left")
    known = known.select("rid", "least_id", "key", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("_w", F.lit(0).cast("long")).alias("weight"))
    return stage, known


def join(documents: DataFrame, k: int = 3, similarity: int = 90, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of ``documents`` (doc_id, text).

    Texts of at least ``similarity`` percent Jaccard similarity of their ``k``-word shingle sets are linked; n_links counts the
    other rows that a row is linked with, rows with an equal set included. Null, empty and wordless texts have no shingles and no
    links. Rows that repeat an id are linked like others; null ids take part, and a component of null ids only has id null. A
    text of fewer than ``k`` words has one shingle. Further columns are ignored; an empty table gives no rows.
    """
    stage, known = _linked(documents, k, similarity, block, hot)
    ids = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = known.join(ids, "root").select(F.col("rid").alias("_r"), "component_id", (F.col("copies") - 1 + F.col("weight")).alias("n_links"))
    out = stage.join(by_class, (F.col("rid") == F.col("_r")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def brute(rows: list[tuple[int | None, str | None]], k: int, t: int) -> list[tuple]:
    """The same by comparing all pairs: for tests."""
    import re

    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n_links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                n_links[i] += 1
                n_links[j] += 1
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None and (least.get(r) is None or doc < least[r]):
            least[r] = doc
    return [(doc, len(s), least.get(find(i)) if s else doc, n) for i, ((doc, _), s, n) in enumerate(zip(rows, sets, n_links))]


def keep_one(documents: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id, a null id only if there is no other. Rows
    without shingles (null, empty and wordless texts) all stay; of rows that repeat both id and text one stays, and of rows
    that repeat the smallest id with different texts one. Further columns, whatever their names, stay; an empty table gives no rows."""
    plain, names = C.apart(documents)
    stage, known = _linked(plain, k, similarity, BLOCK, HOT)
    kept = known.groupBy("root").agg(F.min("least_id").alias("_id"), F.min_by("key", F.coalesce("least_id", F.lit((1 << 63) - 1))).alias("_key")).select("_id", "_key")
    times = stage.where("n > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))).select("_id", "_key", "_times")
    rows = plain.withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")))
    once = rows.where("_times = 1").select(*plain.columns).unionByName(rows.where("_times > 1").dropDuplicates(["_id", "_key"]).select(*plain.columns))
    wordless = plain.where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return C.together(once.unionByName(wordless), names)
