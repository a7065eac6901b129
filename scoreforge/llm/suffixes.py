"""Suffix-array dedup (operator 2): bytes under strings of ``length`` bytes that start at two places or more are removed.

One suffix array of everything fits no machine, so suffixes are dealt to tasks such that equal strings meet. In every
window of ``length`` bytes the position whose next ``GRAM`` bytes hash lowest (the leftmost such) is the window's anchor:
equal windows have equal anchors at equal offsets. Anchors are dealt by that hash. Those whose hash no other anchor has
are dropped before any text moves; the others come with the bytes around them that their windows can reach.

In a task the suffixes that start at anchors, and likewise the reversed texts before them, are sorted by deep-shallow
sorting: a multikey quicksort, eight bytes a symbol and all groups at once, down to a shallow depth; each group that still
has a common prefix there is ordered by a blind trie. Common prefixes of neighbours then tell, for each offset, which
anchors have the whole window in common: ranks that no short common prefix parts, on both sides.

Texts that several rows share are taken once, with their number. Occurrences inside a text that repeats itself are settled
on the spot, one of each kind going on. No task sorts an unbounded group: an anchor hash with over ``HOT`` occurrences is
parted by longer grams. Its windows are taken by runs of neighbouring offsets (``WIDTHS``: ever shorter runs), and those of a
run are dealt by a hash of all the bytes that the run's windows have in common. Occurrences with the same surroundings are
then removed for certain and one stands for them all, so that at the last, where a run is one window, a group is one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM, HOT = 400, 32, 20_000
#: Neighbouring offsets whose windows are dealt by what they have in common, where an anchor or a wider run is too frequent.
WIDTHS = (64, 8, 1)
#: Surroundings (40 bytes) that several occurrences have are broadcast up to so many, else both sides are shuffled, in SALTS parts.
BROADCAST_ROWS, SALTS = 500_000, 64
#: Words of eight bytes that the quicksort looks at before blind tries take over.
SHALLOW = 8
#: Bytes of a text that are looked at together; texts over it are taken in overlapping pieces.
PIECE, POS_BITS = 1_000_000, 20
#: Anchors sorted together.
BATCH = 12_000
ANCHOR = pa.struct([("h", pa.int64()), ("p", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16())])


# ---------------------------------------------------------------- anchors


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    n = len(b) - GRAM + 1
    word = np.lib.stride_tricks.as_strided(np.ascontiguousarray(b), (len(b) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        h = (h ^ word[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))


def anchors(b: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, least and greatest offset of its windows) of each anchor of one text. Windows on both sides of a
    piece's border may have one anchor: a row each time, its offsets joined."""
    none = np.zeros(0, np.int64)
    out = [(none.view(np.uint64), none, none, none)]
    w = length - GRAM + 1
    at = 0
    while len(b) - at >= length:
        part = b[at : at + piece]
        h = _gram_hashes(part)
        n = len(h)
        packed = (h >> np.uint64(POS_BITS)) << np.uint64(POS_BITS) | np.arange(n, dtype=np.uint64)
        size = -(-n // w) * w
        pad = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        pad[:n] = packed
        rows = pad.reshape(-1, w)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(rows, axis=1).ravel()
        starts = n - w + 1
        p = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        last = np.concatenate([first[1:], [starts]]) - 1
        p = p[first]
        out.append((h[p], p + at, p - last, p - first))
        if len(b) - at <= piece:
            break
        at += piece - length + 1
    h, p, lo, hi = (np.concatenate(x) for x in zip(*out))
    first = np.flatnonzero(np.diff(p, prepend=-1))
    last = np.append(first[1:], len(p))[: len(first)] - 1
    return h[first], p[first], lo[last], hi[first]


# ---------------------------------------------------------------- deep-shallow sorting


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of ``strings`` by a blind trie: inner nodes know only the depth at which their children differ, so an insertion
    walks down unseeing, compares itself to one string found there, and is put where the two part."""
    root: list = [None, {}, [0]]  # depth and children, or (depth None) the strings equal to the first of the list
    top = root
    for i in range(1, len(strings)):
        s = strings[i]
        n = len(s)
        node = top
        while node[0] is not None:
            d = node[0]
            node = node[1].get(s[d] if d < n else -1) or next(iter(node[1].values()))
        t = strings[node[2][0]]
        if s == t:
            node[2].append(i)
            continue
        m = min(n, len(t))
        x = int.from_bytes(s[:m], "big") ^ int.from_bytes(t[:m], "big")
        lcp = m - (x.bit_length() + 7) // 8 if x else m
        parent, branch, node = None, None, top
        while node[0] is not None and node[0] < lcp:
            parent, branch = node, (s[node[0]] if node[0] < n else -1)
            node = node[1][branch]
        own = s[lcp] if lcp < n else -1
        if node[0] == lcp:
            node[1][own] = [None, None, [i]]
            continue
        fork = [lcp, {own: [None, None, [i]], (t[lcp] if lcp < len(t) else -1): node}, None]
        if parent is None:
            top = fork
        else:
            parent[1][branch] = fork
    out: list[int] = []
    stack = [top]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[2]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(rows: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (zero-padded rows, true lengths) within their groups (ascending), and the common prefix of each
    with the one before it in that order, 0 across groups."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64) if width else np.zeros((n, 0), np.uint64)
    perm = np.arange(n)
    seg = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if n else perm
    depth = np.zeros(n, np.int64)
    deepest = min(SHALLOW, words.shape[1])
    while True:
        size = np.bincount(seg)
        live = np.flatnonzero((size[seg] > 1) & (depth < deepest))
        if not len(live):
            break
        key = words[perm[live], depth[live]]
        own = seg[live]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.concatenate([head, [len(own)]]))
        pivot = np.repeat(key[head + count // 2], count)
        code = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        order = np.argsort(own * 3 + code, kind="stable")
        perm[live] = perm[live][order]
        depth[live] = (depth[live] + (code == 1))[order]
        mark = seg * 3
        mark[live] = (own * 3 + code)[order]
        seg = np.concatenate([[0], np.cumsum(mark[1:] != mark[:-1])])
    bounds = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]])) if n else np.zeros(1, int)
    for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist()):
        at = perm[a:b]
        skip = deepest * 8
        strings = [rows[i, min(skip, m) : m].tobytes() if m > skip else rows[i, m:m].tobytes() for i, m in zip(at.tolist(), lens[at].tolist())]
        short = [m if m <= skip else skip for m in lens[at].tolist()]
        if len(set(short)) > 1:  # ends inside the shallow part: the shorter comes first
            order = sorted(range(len(strings)), key=lambda i: (short[i], strings[i]))
        else:
            order = blind_trie_order(strings)
        perm[a:b] = at[order]
    lcp = np.zeros(n, np.int64)
    for a in range(1, n, 8192):
        x, y = perm[a : a + 8192], perm[a - 1 : a - 1 + len(perm[a : a + 8192])]
        differ = rows[x] != rows[y]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(x), np.int64)
        lcp[a : a + len(x)] = np.where(group[x] == group[y], np.minimum(same, np.minimum(lens[x], lens[y])), 0)
    return perm, lcp


def _padded(parts: list[bytes], width: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    rows = np.zeros((len(parts), -(-width // 8) * 8), np.uint8)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    if back:
        col = np.repeat(lens, lens) - 1 - col
    rows[np.repeat(np.arange(len(parts)), lens), col] = flat
    return rows, lens


def shared_windows(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For anchors in groups: which windows (by offset, up to ``length - GRAM``) another anchor of the group has as well."""
    n, most = len(left), length - GRAM
    r, rl = _padded(right, length, False)
    l, ll = _padded(left, most, True)  # noqa: E741
    r_perm, r_lcp = deep_shallow(r, rl, group)
    l_perm, l_lcp = deep_shallow(l, ll, group)
    flags = np.zeros((n, most + 1), bool)
    r_run, l_run = np.empty(n, np.int64), np.empty(n, np.int64)
    edge = np.concatenate([[True], group[1:] != group[:-1]])
    l_short = np.where(edge[np.arange(n)], -1, l_lcp)  # an empty common prefix joins within a group, never across
    for o in range(int(lo.min()), int(hi.max()) + 1):
        on = np.flatnonzero((lo <= o) & (o <= hi))
        if len(on) < 2:
            continue
        r_run[r_perm] = np.cumsum(r_lcp < length - o)
        l_run[l_perm] = np.cumsum(l_short < o)
        key = r_run[on] * (n + 1) + l_run[on]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        dup = np.zeros(len(on), bool)
        dup[order[1:]] |= same
        dup[order[:-1]] |= same
        flags[on[dup], o] = True
    return flags


# ---------------------------------------------------------------- the operator


def _first_pass(length: int, piece: int):
    def run(batches):
        for batch in batches:
            col = C.texts_of(batch)
            for s, e in C.chunks(col):
                raw, offs = C.utf8_flat(col.slice(s, e - s))
                keys, digests, parts = [], [], []
                for a, b in zip(offs.tolist(), offs[1:].tolist()):
                    own = raw[a:b]
                    keys.append(hashlib.md5(own).digest())
                    digests.append(hashlib.sha256(own).digest())
                    parts.append(anchors(own, length, piece))
                sizes = np.array([len(x[0]) for x in parts])
                h, p, lo, hi = (np.concatenate(x) for x in zip(*parts))
                found = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))], fields=list(ANCHOR))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(keys, pa.binary()), pa.array(np.diff(offs)), pa.array(digests, pa.binary()), lists], ["doc_id", "key", "n", "sha", "anchors"])

    return run


#: Rows between passes. kind 0: bytes [p, p + lo) are removed; 1: an anchor with its surroundings; 2: such of a too frequent anchor.
PASSED = "h long, doc_id long, key binary, p int, lo int, hi int, left binary, right binary, kind int"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
_NAMES = [x.split()[0] for x in PASSED.split(", ")]


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, _KINDS)], _NAMES)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _parted(h: int, lo: int, hi: int, left: bytes, right: bytes, width: int, length: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """An anchor's row as one for each run of ``width`` offsets: hash of what the run's windows have in common, lo, hi, left, right."""
    out = []
    for j in range(lo // width, hi // width + 1):
        a, b = max(lo, j * width), min(hi, j * width + width - 1)
        end = length - (j * width + width - 1)
        core = left[len(left) - j * width :] + right[:end] if end > 0 else left[len(left) - j * width : len(left) + end]
        name = hashlib.blake2b(core, digest_size=8, key=f"{h} {j} {width}".encode()).digest()
        out.append((int.from_bytes(name, "big", signed=True), a, b, left[len(left) - b :], right[: length - a]))
    return out


def _second_pass(length: int):
    """Brings the bytes around anchors that are not alone."""

    def run(batches):
        out, held, last = [], 0, None
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                doc, key = cols[0][i].as_py(), cols[1][i].as_py()
                if (doc, key) == last:
                    continue  # a repeated row: the join gives them one after another
                last, text = (doc, key), (cols[2][i].as_py() or "").encode()
                seen: dict = {}
                for a in cols[3][i].as_py():
                    p, lo, hi = a["p"], a["lo"], a["hi"]
                    seen.setdefault((a["h"], a["hot"], text[p - hi : p], text[p : p + length - lo], lo), []).append(p)
                twice = []  # settled here: it stands twice in this very text
                for (h, hot, left, right, lo), at in seen.items():
                    hi = len(left)
                    if hot:
                        out += [(h_, doc, key, at[0], lo_, hi_, l_, r_, 2) for h_, lo_, hi_, l_, r_ in _parted(h, lo, hi, left, right, min(WIDTHS[0], length), length)]
                        held += 4000
                    else:
                        out.append((h, doc, key, at[0], lo, hi, left, right, 1))
                        held += 600
                    if len(at) > 1:
                        twice += [(p - hi, p - lo + length) for p in at]
                    if held > 8_000_000:
                        yield _rows(out)
                        out, held = [], 0
                out += [(a, doc, key, a, b - a, 0, b"", b"", 0) for a, b in cover(twice)]
        if out:
            yield _rows(out)

    return run


def _narrowed(width: int, length: int):
    """Rows parted again by shorter runs of offsets."""

    def run(batches):
        for batch in batches:
            out = []
            for h, doc, key, p, lo, hi, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(h_, doc, key, p, lo_, hi_, l_, r_, 2) for h_, lo_, hi_, l_, r_ in _parted(h, lo, hi, left, right, width, length)]
                if len(out) > 10_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return run


def _third_pass(length: int):
    """Sorts whole groups of one hash, as they come in order of it, and gives what is to be removed."""

    def settle(held: dict):
        rows = sorted(held.values(), key=lambda r: r[0])
        hs = np.array([r[0] for r in rows], np.int64)
        first = np.concatenate([[True], hs[1:] != hs[:-1]])
        keep = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
        if not len(keep):
            return []
        rows = [rows[i] for i in keep.tolist()]
        lo, hi = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        flags = shared_windows(hs[keep], [r[6] for r in rows], [r[7] for r in rows], lo, hi, length)
        out = []
        for r, own in zip(rows, flags):
            for a, b in _runs(own):
                out.append((0, r[1], r[2], r[3] - b, b - a + length, 0, b"", b"", 0))
        return out

    def run(batches):
        held, last = {}, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and r[0] != last:
                    yield _rows(settle(held))
                    held = {}
                held[r[0], r[2], r[3]] = r  # of repeated rows one
                last = r[0]
        if held:
            yield _rows(settle(held))

    return run


def _last_pass(batches):
    """What is left of each text: n_removed, n_spans and the sha256 of the rest."""
    for batch in batches:
        out = []
        keys, texts, cuts = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            text = (texts[i].as_py() or "").encode()
            spans = cover([(c["p"], c["p"] + c["lo"]) for c in cuts[i].as_py()])
            rest = hashlib.sha256()
            at = 0
            for a, b in spans:
                rest.update(text[at:a])
                at = b
            rest.update(text[at:])
            out.append((keys[i].as_py(), sum(b - a for a, b in spans), len(spans), rest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "n_removed", "n_spans", "kept_sha256"])


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [a, b)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _parts(passed: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Anchors' rows in groups of ``hot`` at most, ready to be sorted, and the cuts known by then."""
    ready, cuts = passed.where("kind = 1").select(*_NAMES[:-1]), passed.where("kind = 0").select("doc_id", "key", "p", "lo")
    rows = passed.where("kind = 2").select(*_NAMES[:-1])
    for width in (*WIDTHS[1:], 0):
        rows = rows.withColumn("d", F.unhex(F.md5(F.concat("left", "right"))))
        kinds = C.checkpointed(rows.groupBy("h", "lo", "hi", "d").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("doc_id", "key", "p", "left", "right")).alias("r")))
        several = kinds.where("n > 1").select("h", "lo", "hi", "d")
        where = ["h", "lo", "hi", "d"]
        if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            same = rows.join(F.broadcast(several), where)
        else:  # one kind may have very many rows
            parts = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            same = rows.withColumn("salt", F.pmod(F.xxhash64("key", "p"), F.lit(SALTS)).cast("int")).join(parts, [*where, "salt"])
        cuts = cuts.unionByName(same.select("doc_id", "key", (F.col("p") - F.col("hi")).alias("p"), (F.col("hi") - F.col("lo") + length).alias("lo")))
        one = kinds.select("h", "r.doc_id", "r.key", "r.p", "lo", "hi", "r.left", "r.right")
        big = C.checkpointed(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("h"))
        if big.isEmpty():  # with runs of one offset always
            return ready.unionByName(one), cuts
        ready = ready.unionByName(one.join(big, "h", "left_anti").select(*_NAMES[:-1]))
        rows = C.checkpointed(one.join(big, "h", "left_semi").select(*_NAMES[:-1]).mapInArrow(_narrowed(width, length), PASSED)).select(*_NAMES[:-1])
    raise AssertionError("a group of one window has one row")


def remove_repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``documents`` (doc_id, text).

    Null texts count as empty; texts under ``length`` bytes lose nothing; a text that several rows have (repeated rows
    included) is removed whole from each if it has ``length`` bytes. Further columns are ignored; an empty table gives no rows.
    """
    own = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    stage = C.checkpointed(own.mapInArrow(_first_pass(length, piece), "doc_id long, key binary, n long, sha binary, anchors array<struct<h:long,p:int,lo:short,hi:short>>"))
    reps = stage.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    rep_rows = stage.select("doc_id", "key", "anchors").join(reps.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d")), F.col("key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    found = rep_rows.select("doc_id", "key", F.inline("anchors"))
    shared = C.checkpointed(found.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("h").alias("_h"), (F.col("times") > hot).alias("hot")))
    some_hot = not shared.where("hot").isEmpty()
    marked = found.join(shared, F.col("h") == F.col("_h")).groupBy("doc_id", "key").agg(F.collect_set(F.struct("h", "p", "lo", "hi", "hot")).alias("list"))  # of one text
    texts = own.select(F.col("doc_id").alias("_d"), C.text_key(F.col("text")).alias("_k"), "text")
    meet = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    passed = texts.join(marked, meet).select("doc_id", "key", "text", "list").mapInArrow(_second_pass(length), PASSED)
    passed = C.checkpointed(passed)
    ready, cuts = _parts(passed, length, hot) if some_hot else (passed.where("kind = 1"), passed.where("kind = 0").select("doc_id", "key", "p", "lo"))
    ready = ready.select(*_NAMES[:-1]).repartition("h").sortWithinPartitions("h")
    cuts = cuts.unionByName(ready.mapInArrow(_third_pass(length), PASSED).select("doc_id", "key", "p", "lo"))
    lists = cuts.groupBy("doc_id", "key").agg(F.collect_set(F.struct("p", "lo")).alias("cuts"))  # of one text
    left = texts.join(lists, meet).select("key", "text", "cuts").mapInArrow(_last_pass, "key binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["key"])
    by_key = reps.select(F.col("key").alias("_k"), "copies").join(left.withColumnRenamed("key", "_k2"), F.col("_k") == F.col("_k2"), "left").drop("_k2")
    rows = stage.select("doc_id", "key", "n", "sha").join(by_key, F.col("key") == F.col("_k"))
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def brute(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by comparing all windows: for tests."""
    data = [(t or "").encode() for t in texts]
    times: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            times[w] = times.get(w, 0) + 1
    out = []
    for d in data:
        spans = cover([(i, i + length) for i in range(len(d) - length + 1) if times[d[i : i + length]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept += d[at:a]
            at = b
        kept += d[at:]
        out.append((len(d), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
