"""Order-preserving alignment of two sequences (global, unit substitution cost), and edit distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreforge.functions.expr import let
from scoreforge.schemas import ALIGNED

#: Cells of the tables of steps that are filled at once, a byte each.
CELLS = 1 << 24
#: The same of a band around the diagonal of one pair's table.
BAND_CELLS = 1 << 26
#: Pairs of at most so many cells fill their tables at once.
FEW_CELLS = 1 << 12
#: Cells of a table that take about as long as one furthest place of ``_by_cost``, and as one cost there, whatever the pairs.
PLACE_CELLS, COST_CELLS = 8, 1 << 13
#: What part of the time of the tables may be spent on trying to do without.
TRIED = 1 / 6
#: Elements of both sides whose alignments are made and counted together.
KEYS = 1 << 21
#: What stands for a place that no path comes to.
NOWHERE = -(1 << 30)
DIAGONAL, UP, LEFT = range(3)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of an array of lists one after another, and the n+1 offsets; null lists count as empty."""
    if not len(lists):
        return pa.array([], lists.type.value_type), np.zeros(1, np.int64)
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.concatenate([[0], np.cumsum(lens)])


def coded(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two arrays of strings, equal where the strings (or nulls) are."""
    some = [x.cast(pa.string()) for x in (a, b) if len(x)]  # of no strings there may be no offsets
    both = pa.concat_arrays(some) if some else pa.array([], pa.string())
    codes = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
    return codes[: len(a)], codes[len(a) :]


#: Sequences one after another: numbers, or several arrays of the same length by name (what elements are compared by).
Flat = np.ndarray | dict[str, np.ndarray]
#: Which elements of two shapes that broadcast count as equal; any relation, transitive or not.
Same = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def _equal(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return a[""] == b[""]


def align_many(a: Flat, a_offs: np.ndarray, b: Flat, b_offs: np.ndarray, gap: int = 1, same: Same = _equal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments of many pairs of sequences, pair ``i`` being ``a[a_offs[i]:a_offs[i + 1]]`` and the same of ``b``: places in either,
    -1 for a gap, one alignment after another, and the offsets. Least cost (1 for two that differ, ``gap`` for one alone); ties
    go, from the end, to a pair, then to an element of ``a`` alone.

    Pairs of like size fill their tables together, a row of all of them at a time: along a row, the steps to the right are
    a running minimum. Then all go back together, a step at a time. Pairs of more than ``FEW_CELLS`` cells first go by cost
    (``_by_cost``), as long as that takes fewer places than a table has cells. What is left and has more than ``CELLS`` cells tries
    a band (``_in_band``); if none pays, it is cut up by ``_long``.
    """
    a, b = ({"": x} if isinstance(x, np.ndarray) else x for x in (a, b))
    m, n = np.diff(a_offs), np.diff(b_offs)
    count = len(m)
    length, parts, aligned = np.zeros(count, np.int64), [], np.zeros(count, bool)
    like, slack = np.flatnonzero((m + 1) * (n + 1) > FEW_CELLS) if gap else np.zeros(0, np.int64), 0
    while len(like):
        costs = gap * np.abs(n - m)[like] + slack + 1
        places, whole = costs * (slack // gap + 3), TRIED * (m * n)[like]
        order = np.argsort(costs, kind="stable")
        order = order[((PLACE_CELLS * places <= whole) & (4 * places <= BAND_CELLS))[order]]
        saved = np.append(0, np.cumsum((whole - PLACE_CELLS * places)[order]) - COST_CELLS * costs[order])
        order = order[: np.argmax(saved)][::-1]  # of what is left, pairs of few costs first; a cost is a round for all
        like, part = like[order], np.cumsum(places[order]) // max(1, CELLS // 4)
        for own in np.split(like, np.flatnonzero(np.diff(part)) + 1) if len(like) else []:
            own, g, p, size = _by_cost(a, a_offs, b, b_offs, own, gap, same, slack)
            length[own], aligned[own] = size, True
            parts.append((own, g, p, size))
        like, slack = like[~aligned[like]], 3 * slack + 8
    long = (m + 1) * (n + 1) > CELLS
    for i in np.flatnonzero(long & ~aligned).tolist():
        pair = {k: x[a_offs[i] : a_offs[i + 1]] for k, x in a.items()}, {k: x[b_offs[i] : b_offs[i + 1]] for k, x in b.items()}, int(m[i]), int(n[i]), gap, same
        g, p = _in_band(*pair) or _long(*pair)
        length[i] = len(g)
        parts.append((np.array([i]), g, p, length[i : i + 1]))
    bucket = lambda x: np.where(x > 0, 1 << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64), 0)
    wide, high = bucket(n), bucket(m)
    order = np.lexsort((n, m, wide, high))
    order = order[~(long | aligned)[order]]
    sorted_sizes = np.stack([high[order], wide[order]])
    cuts = [0, *(np.flatnonzero((sorted_sizes[:, 1:] != sorted_sizes[:, :-1]).any(axis=0)) + 1).tolist(), len(order)] if len(order) else [0]
    for s, e in zip(cuts, cuts[1:]):
        some = max(1, CELLS // int((high[order[s]] + 1) * (wide[order[s]] + 1)))
        for at in range(s, e, some):
            own = order[at : min(e, at + some)]
            g, p, size = _together(_rows(a, a_offs, own), m[own], _rows(b, b_offs, own), n[own], gap, same)
            length[own] = size
            parts.append((own, g, p, size))
    offs = np.concatenate([[0], np.cumsum(length)])
    g_all, p_all = np.zeros(offs[-1], np.int32), np.zeros(offs[-1], np.int32)
    for own, g, p, size in parts:
        to = np.repeat(offs[own] - (np.cumsum(size) - size), size) + np.arange(len(g))
        g_all[to], p_all[to] = g, p
    return g_all, p_all, offs


def _run(a: dict[str, np.ndarray], b: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, room: np.ndarray, same: Same, first: int, back: bool = False) -> np.ndarray:
    """How many elements in a row are equal, from the places ``i`` and ``j`` on (or going back from before them), ``room`` at most."""
    run, todo, size = np.zeros(len(i), np.int64), np.flatnonzero(room > 0), first
    while len(todo):
        ahead = run[todo, None] + np.arange(size)
        at = [x[todo, None] - 1 - ahead if back else x[todo, None] + ahead for x in (i, j)]
        alike = same(*({k: v.take(y, mode="clip") for k, v in x.items()} for x, y in zip((a, b), at))) & (ahead < room[todo, None])
        whole = alike.all(axis=1)
        run[todo] += np.where(whole, size, alike.argmin(axis=1))
        todo = todo[whole]
        size = max(first, min(4 * size, CELLS // 64 // max(1, len(todo))))
    return run


def _by_cost(a: dict[str, np.ndarray], a_offs: np.ndarray, b: dict[str, np.ndarray], b_offs: np.ndarray, own: np.ndarray, gap: int, same: Same, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignments of those of the pairs ``own`` that cost at most ``slack`` above ``gap`` for what one is longer (most first), and which ones.

    For each cost and diagonal it is found how far in ``a`` one comes (Ukkonen; Myers): costs do not fall along a diagonal, so this
    tells for every cell whether it can be had for a cost. Diagonals are counted towards the longer sequence; of those that a cost
    leads to, only ``slack // gap + 1`` lead to the end for the rest. All cells of best paths are among them, so that on the way back a
    step of the rule for ties is taken here if and only if it would be in the whole table: a pair of equal elements always, others by
    look-up. Time grows with the cost and the slack, not with the product of the lengths.
    """
    m, n = a_offs[own + 1] - a_offs[own], b_offs[own + 1] - b_offs[own]
    most, wide, sign = gap * np.abs(n - m) + slack, slack // gap + 1, np.where(n < m, -1, 1)
    lowest = lambda cost: -((slack - cost) // gap)  # noqa: E731  diagonal of the first column
    rows = np.searchsorted(-most, -np.arange(most[0] + 1), side="right")  # pairs that may cost so much
    begin = np.concatenate([[0], np.cumsum(rows * (wide + 2))])
    table = np.full(begin[-1], NOWHERE, np.int32)
    of = lambda cost: table[begin[cost] : begin[cost + 1]].reshape(-1, wide + 2)
    known, first = np.full(len(own), -1), 8 if wide == 1 else 2
    for cost in range(int(most[0]) + 1):
        live = int(rows[cost])
        far = np.where(sign < 0, 1, 0)[:live, None]
        ahead = sign[:live, None] * (lowest(cost) + np.arange(wide))  # of the place in b
        if cost:
            step = lowest(cost) - lowest(cost - 1)
            i = of(cost - 1)[:live, step : step + wide] + 1
            if cost >= gap:
                before = of(cost - gap)[:live]
                i = np.maximum(i, np.maximum(before[:, :-2] + far, before[:, 2:] + (1 - far)))
            i = np.minimum(i, np.minimum(m[:live, None], n[:live, None] - ahead))
        else:
            i = np.where(ahead == 0, 0, NOWHERE)
        there = np.nonzero(i >= np.maximum(0, -ahead))
        i, pair = i[there], there[0]
        j = i + ahead[there]
        i = i + _run(a, b, a_offs[own][pair] + i, b_offs[own][pair] + j, np.minimum(m[pair] - i, n[pair] - j), same, first)
        of(cost)[there] = i
        known[pair[(i == m[pair]) & (ahead[there] == (n - m)[pair]) & (known[pair] < 0)]] = cost
        if (known >= 0).all():
            break
    found = np.flatnonzero(known >= 0)
    i, j, cost, size, gaps = m.copy(), n.copy(), known, np.zeros(len(own), np.int64), [np.zeros((3, 0), np.int64)]

    def reached(pair: np.ndarray, cost: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        column = diagonal - lowest(cost)
        inside = (cost >= 0) & (column >= 0) & (column < wide)
        return np.where(inside, table[np.where(inside, begin[cost] + pair * (wide + 2) + column, 0)], NOWHERE)

    live = found
    while len(live):
        run = _run(a, b, a_offs[own][live] + i[live], b_offs[own][live] + j[live], np.minimum(i[live], j[live]), same, first, back=True)
        i[live] -= run
        j[live] -= run
        size[live] += run
        live = live[(i[live] > 0) | (j[live] > 0)]
        x, y, diagonal = i[live], j[live], (sign * (j - i))[live]
        pairs = (x > 0) & (y > 0) & (reached(live, cost[live] - 1, diagonal) >= x - 1)
        up = ~pairs & (x > 0) & ((y == 0) | (reached(live, cost[live] - gap, diagonal + sign[live]) >= x - 1))
        gaps.append(np.stack([live, size[live], np.where(up, UP, LEFT)])[:, ~pairs])
        i[live] -= pairs | up
        j[live] -= ~up
        cost[live] -= np.where(pairs, 1, gap)
        size[live] += 1
    pair, back, kind = np.concatenate(gaps, axis=1)
    ends = np.cumsum(size)
    steps = np.full(ends[-1], DIAGONAL, np.uint8)
    steps[ends[pair] - 1 - back] = kind
    size = size[found]
    places = lambda moves, lens: np.where(moves, np.cumsum(moves) - 1 - np.repeat(np.cumsum(lens) - lens, size), -1).astype(np.int32)
    return own[found], places(steps != LEFT, m[found]), places(steps != UP, n[found]), size


def _in_band(a: dict[str, np.ndarray], b: dict[str, np.ndarray], m: int, n: int, gap: int, same: Same) -> tuple[np.ndarray, np.ndarray] | None:
    """The alignment of one pair from the cells near its diagonal, or None where a band does not pay or would not fit ``BAND_CELLS``.

    A path that leaves the band has at least ``|n - m| + 2 * (below + 1)`` gaps. If the last cell costs less than those, all best paths
    lie in the band; their cells cost there what they cost in the whole table, all others as much or more, so the rule for ties
    takes the same steps. Else the band is widened.
    """
    below, far = 8, np.int32((gap + 1) * (m + n + 1))
    while True:
        first, wide = min(0, n - m) - below, abs(n - m) + 2 * below + 1  # cell (i, first + i + k) stands at k
        if 2 * wide > n or (m + 1) * wide > BAND_CELLS:
            return None
        columns, slope = first + np.arange(wide), np.arange(wide, dtype=np.int32) * gap
        above = np.where((columns >= 0) & (columns <= n), columns * gap, far).astype(np.int32)
        steps = np.full((m + 1, wide), LEFT, np.uint8)
        around = {k: np.concatenate([np.zeros(-first, v.dtype), v, np.zeros(wide, v.dtype)]) for k, v in b.items()}
        for i in range(1, m + 1):
            pair = above + ~same({k: v[i - 1 : i] for k, v in a.items()}, {k: v[i - 1 : i - 1 + wide] for k, v in around.items()})
            up = np.append(above[1:], far) + gap
            left, right = max(0, -first - i), max(0, min(wide, n + 1 - first - i))  # cells of columns 0 to n
            pair[: left + (first + i + left == 0)] = far
            row = np.full(wide, far, np.int32)
            row[left:right] = np.minimum.accumulate(np.minimum(pair, up)[left:right] - slope[left:right]) + slope[left:right]
            steps[i] = np.where(row == pair, DIAGONAL, np.where(row == up, UP, LEFT))
            above = np.minimum(row, far)
        if above[n - m - first] < gap * (abs(n - m) + 2 * (below + 1)):
            break
        below *= 4
    g, p, i, k = [], [], m, n - m - first
    while i > 0 or first + i + k > 0:
        step, j = (LEFT if i == 0 else UP if first + i + k == 0 else steps[i, k]), first + i + k
        g.append(-1 if step == LEFT else i - 1)
        p.append(-1 if step == UP else j - 1)
        if step == DIAGONAL:
            i -= 1
        elif step == UP:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return np.array(g[::-1], np.int32), np.array(p[::-1], np.int32)


def _rows(x: dict[str, np.ndarray], offs: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """Sequences as rows of one matrix; behind their ends stands what is never looked at."""
    lens = offs[own + 1] - offs[own]
    row = np.repeat(np.arange(len(own)), lens)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    made = {}
    for k, values in x.items():
        made[k] = np.zeros((len(own), int(lens.max(initial=0))), values.dtype)
        made[k][row, col] = values[np.repeat(offs[own], lens) + col]
    return made


def _together(a: dict[str, np.ndarray], m: np.ndarray, b: dict[str, np.ndarray], n: np.ndarray, gap: int, same: Same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count, high, wide = len(m), int(m.max(initial=0)), int(n.max(initial=0))
    steps = np.empty((high + 1, count, wide + 1), np.uint8)
    steps[0], steps[:, :, 0] = LEFT, UP
    slope = np.arange(wide + 1, dtype=np.int32) * gap
    above = np.broadcast_to(slope, (count, wide + 1)).copy()
    for i in range(1, high + 1):
        row, pair = _next_row(above, {k: x[:, i - 1 : i] for k, x in a.items()}, b, slope, gap, same)
        steps[i, :, 1:] = np.where(row[:, 1:] == pair, DIAGONAL, np.where(row[:, 1:] == above[:, 1:] + gap, UP, LEFT))
        above = row
    g, p = np.full((count, high + wide), -1, np.int32), np.full((count, high + wide), -1, np.int32)
    i, j, size = m.astype(np.int64), n.astype(np.int64), np.zeros(count, np.int64)
    live = np.flatnonzero((i > 0) | (j > 0))
    while len(live):
        step = steps[i[live], live, j[live]]
        up, left = live[step != LEFT], live[step != UP]
        i[up] -= 1
        j[left] -= 1
        at = high + wide - 1 - size
        g[up, at[up]] = i[up]
        p[left, at[left]] = j[left]
        size[live] += 1
        live = live[(i[live] > 0) | (j[live] > 0)]
    real = np.arange(high + wide) >= (high + wide - size)[:, None]
    return g[real], p[real], size


def _next_row(above: np.ndarray, x: dict[str, np.ndarray], b: dict[str, np.ndarray], slope: np.ndarray, gap: int, same: Same) -> tuple[np.ndarray, np.ndarray]:
    """A row of each cost table from the row above, and what its cells would cost as pairs."""
    row = above + gap
    pair = above[:, :-1] + ~same(x, b)
    np.minimum(row[:, 1:], pair, out=row[:, 1:])
    return np.minimum.accumulate(row - slope, axis=1) + slope, pair


def _long(a: dict[str, np.ndarray], b: dict[str, np.ndarray], m: int, n: int, gap: int, same: Same) -> tuple[np.ndarray, np.ndarray]:
    """The alignment of one pair in memory that grows with ``m + n``: the table is halved by rows until a piece has at most ``CELLS``.

    What is halved is one path, that of the rule for ties: below the middle row each cell hands on the column in which its path
    left that row, so the path of the last cell is known to pass there. On that path no step of higher rank costs the
    least, and it does not in the pieces either, where all other cells cost the same or more; so the pieces' paths are parts of it.
    """
    todo, parts = [(0, m, 0, n)], []
    while todo:
        top, bottom, left, right = todo.pop()
        x, y = {k: v[None, top:bottom] for k, v in a.items()}, {k: v[None, left:right] for k, v in b.items()}
        if bottom - top < 2 or (bottom - top + 1) * (right - left + 1) <= CELLS:
            g, p, _ = _together(x, np.array([bottom - top]), y, np.array([right - left]), gap, same)
            parts.append((np.where(g < 0, g, g + top), np.where(p < 0, p, p + left)))
            continue
        middle = (top + bottom) // 2
        at = left + _crossing(x, y, middle - top, gap, same)
        todo += [(middle, bottom, at, right), (top, middle, left, at)]
    return np.concatenate([g for g, _ in parts]), np.concatenate([p for _, p in parts])


def _crossing(a: dict[str, np.ndarray], b: dict[str, np.ndarray], middle: int, gap: int, same: Same) -> int:
    """The column in which the path of the last cell, seen from there, comes to the row ``middle``."""
    high, wide = (next(iter(x.values())).shape[1] for x in (a, b))
    places = np.arange(wide + 1)
    slope = places[None].astype(np.int32) * gap
    above, crossed = slope.copy(), places
    for i in range(1, high + 1):
        row, pair = _next_row(above, {k: x[:, i - 1 : i] for k, x in a.items()}, b, slope, gap, same)
        if i > middle:
            diagonal, up = row[0, 1:] == pair[0], row[0, 1:] == above[0, 1:] + gap
            own = crossed.copy()  # of the cell above
            own[1:] = np.where(diagonal, crossed[:-1], crossed[1:])
            start = places.copy()  # the last cell to the left that is not reached from its left
            start[1:][~(diagonal | up)] = 0
            crossed = own[np.maximum.accumulate(start)]
        above = row
    return int(crossed[-1])


def cells(g: np.ndarray, p: np.ndarray) -> pa.Array:
    """Places of alignments as structs, null for a gap."""
    return pa.StructArray.from_arrays([pa.array(x, pa.int32(), mask=x < 0) for x in (g, p)], ["g", "p"])


def listed(values: pa.Array, offs: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values, mask=None if mask is None else pa.array(mask))


def _udf(gap: int):
    @F.arrow_udf(ALIGNED.elementType)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, x_offs), (y, y_offs) = flat(a), flat(b)
        x, y = coded(x, y)
        return _listed_alignments(a, b, *align_many(x, x_offs, y, y_offs, gap))

    return run


def _fields(lists: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    elements, offs = flat(lists)
    names = [f.name for f in lists.type.value_type]
    return {k: pc.struct_field(elements, [k]).to_numpy(zero_copy_only=False) for k in names}, offs


def align_where(a: Column, b: Column, same: Same, gap: int = 1) -> Column:
    """Alignment of two sequences of structs (array<struct>) in which ``same`` says which elements are equal: of arrays of their
    fields by name, in shapes that broadcast, a truth for each two. It need not be transitive, as a tolerance is not, so no key could
    stand for it. Null elements, or nulls in what ``same`` compares, are what numpy makes of them (nan for numbers)."""

    @F.arrow_udf(ALIGNED.elementType)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, x_offs), (y, y_offs) = _fields(a), _fields(b)
        return _listed_alignments(a, b, *align_many(x, x_offs, y, y_offs, gap, same))

    return run(a, b)


def _listed_alignments(a: pa.Array, b: pa.Array, g: np.ndarray, p: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Alignments as lists, null where either sequence is."""
    void = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    keep = ~np.repeat(void, np.diff(offs))
    size = np.where(void, 0, np.diff(offs))
    return listed(cells(g[keep], p[keep]), np.concatenate([[0], np.cumsum(size)]), void)


def align(a: Column, b: Column, gap: int = 1) -> Column:
    """Alignment of two sequences of keys (array<string>): array<struct<g, p>> of places, null where one side has a gap."""
    return _udf(gap)(a, b)


def agreement(a: Column, b: Column, gap: int = 1) -> Column:
    """What the alignment of two sequences of keys (array<string>) comes to, without its steps: struct<only_a, only_b, equal, unequal>
    of numbers of steps, null where either sequence is. Nulls in them are equal to each other."""

    @F.arrow_udf("struct<only_a:int,only_b:int,equal:int,unequal:int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _agreements(a, b, gap)

    return run(a, b)


def _agreements(a: pa.Array, b: pa.Array, gap: int) -> pa.Array:
    """What ``agreement`` says, for some ``KEYS`` elements at a time."""
    lens = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    cuts = np.flatnonzero(np.diff(np.cumsum(lens) // KEYS, prepend=-1)).tolist() + [len(a)]
    return pa.concat_arrays([_agreement(*(z.slice(s, e - s) for z in (a, b)), gap) for s, e in zip(cuts, cuts[1:])] or [_agreement(a, b, gap)])


def _agreement(a: pa.Array, b: pa.Array, gap: int) -> pa.Array:
    (x, x_offs), (y, y_offs) = flat(a), flat(b)
    x, y = coded(x, y)
    g, p, offs = align_many(x, x_offs, y, y_offs, gap)
    row = np.repeat(np.arange(len(a)), np.diff(offs))
    both = (g >= 0) & (p >= 0)
    alike = both.copy()
    alike[both] = x[(g + x_offs[row])[both]] == y[(p + y_offs[row])[both]]
    void = pc.or_(pc.is_null(a), pc.is_null(b))
    counts = [pa.array(np.bincount(row[own], minlength=len(a)).astype(np.int32)) for own in (p < 0, g < 0, alike, both & ~alike)]
    return pa.StructArray.from_arrays(counts, ["only_a", "only_b", "equal", "unequal"], mask=void)


def align_native(a: Column, b: Column, gap: int = 1) -> Column:
    """The same without Python: rows of the cost table by folds, then the way back by one more. For short sequences: it
    copies a row a step."""
    first = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda y, j: j + 1)), lambda j: j * gap)

    def row(rows, x):
        above = F.element_at(rows, -1)
        places = F.arrays_zip(b.alias("y"), F.slice(above, F.lit(1), F.size(b)).alias("d"), F.slice(above, F.lit(2), F.size(b)).alias("u"))
        start = F.array(F.element_at(above, 1) + gap)
        return F.concat(rows, F.array(F.aggregate(places, start, lambda out, c: F.concat(out, F.array(F.least(c["d"] + (c["y"] != x).cast("int"), c["u"] + gap, F.element_at(out, -1) + gap))))))

    table = F.aggregate(a, F.array(first), row)
    return let(table, lambda rows: _way_back(a, b, rows, gap))


def _way_back(a: Column, b: Column, table: Column, gap: int) -> Column:
    state = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.array().cast("array<struct<g:int,p:int>>").alias("out"))
    at = lambda i, j: F.get(F.get(table, i), j)

    def step(s, _):
        i, j, out = s["i"], s["j"], s["out"]
        cell = lambda g, p: F.array(F.struct(g.cast("int").alias("g"), p.cast("int").alias("p")))
        over = (i == 0) & (j == 0)
        diagonal = (i > 0) & (j > 0) & (at(i, j) == at(i - 1, j - 1) + (F.get(a, i - 1) != F.get(b, j - 1)).cast("int"))
        up = (i > 0) & (at(i, j) == at(i - 1, j) + gap)
        made = F.when(over, out).when(diagonal, F.concat(cell(i - 1, j - 1), out)).when(up, F.concat(cell(i - 1, F.lit(None)), out)).otherwise(F.concat(cell(F.lit(None), j - 1), out))
        return F.struct(F.when(over | ~(diagonal | up), i).otherwise(i - 1).alias("i"), F.when(over | (~diagonal & up), j).otherwise(j - 1).alias("j"), made.alias("out"))

    steps = F.when(F.size(a) + F.size(b) > 0, F.sequence(F.lit(1), F.size(a) + F.size(b))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, state, step, lambda s: s["out"])


#: One character for each different word of a pair of sequences; those after the last are the code points from U+10000.
LETTERS = "".join(chr(0x4E00 + i) for i in range(4096))
MOST_LETTERS = len(LETTERS) + 0x100000


def edit_distance(a: Column, b: Column) -> Column:
    """Least substitutions, deletions and insertions between two sequences of words: Levenshtein over one character a word.
    Over ``MOST_LETTERS`` different words in a pair (a million) are an error, not a wrong number."""

    def of(known):
        place = lambda w: F.array_position(known, w).cast("int")
        far = lambda p: F.decode(F.unhex(F.lpad(F.hex(p + 0x10000 - len(LETTERS) - 1), 8, "0")), "UTF-32")
        letter = lambda w: let(place(w), lambda p: F.when(p <= len(LETTERS), F.substring(F.lit(LETTERS), p, F.lit(1))).otherwise(far(p)))
        text = lambda ws: F.array_join(F.transform(ws, letter), "")
        return F.when(F.size(known) > MOST_LETTERS, F.raise_error(F.lit("too many different words")).cast("int")).otherwise(F.levenshtein(text(a), text(b)))

    single = lambda ws: F.forall(ws, lambda w: F.char_length(w) == 1)  # noqa: E731  then they stand for themselves
    return F.when(single(a) & single(b), F.levenshtein(F.array_join(a, ""), F.array_join(b, ""))).otherwise(let(F.array_distinct(F.concat(a, b)), of))
