"""Byte-pair merging of many sequences at once, on NumPy arrays inside tasks.

A pair's place is that of its left id. Overlapping occurrences count; merging goes left to right without overlaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

Merge = tuple[int, int, int]

#: Ranks of pairs that no merge joins.
NEVER = np.iinfo(np.int64).max
_WEIGHT_BITS = 32
#: States of pairs besides ranks: not a merge, but a later one may join across it; nothing joins across it.
CROSSED, CUT = np.uint16(65_534), np.uint16(65_535)
#: Merges and cells of a table that is laid out, and the rounds after which long parts go rank by rank.
MAX_CELLED, MAX_CELLS, ROUNDS = 20_000, 1 << 23, 48


def code_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair; negative where there is no right id."""
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def bounds_of(lengths: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int64)


def adjacent(bounds: np.ndarray) -> np.ndarray:
    """Places in sequences laid end to end that have a right neighbour in their sequence."""
    last = np.zeros(int(bounds[-1]), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    return np.flatnonzero(~last)


class Chain:
    """Sequences laid end to end as one linked list of ids; place n, whose id is -1, follows every last id."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        self.ids = np.append(ids.astype(np.int64), -1)
        self.next, self.prev = np.arange(1, n + 2), np.arange(-1, n)
        filled = np.diff(bounds) > 0
        self.next[bounds[1:][filled] - 1] = n
        self.prev[bounds[:-1][filled]] = n
        self.next[n] = n

    def codes(self, at: np.ndarray) -> np.ndarray:
        return (self.ids[at] << 32) | self.ids[self.next[at]]

    def occurrences(self, at: np.ndarray, a: int, b: int) -> np.ndarray:
        """Those of the places at which (a, b) still is, without overlaps."""
        at = np.unique(at)
        at = at[(self.ids[at] == a) & (self.ids[self.next[at]] == b)]
        if a == b and len(at):
            index = np.arange(len(at))
            begins = np.concatenate([[True], self.next[at[:-1]] != at[1:]])
            at = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        return at

    def beside(self, at: np.ndarray) -> np.ndarray:
        """Places of the pairs that an id at one of the places is in."""
        left = self.prev[at]
        found = np.unique(np.concatenate([left[left < len(self.ids) - 1], at]))
        return found[self.ids[self.next[found]] >= 0]

    def merge(self, at: np.ndarray, new: int) -> None:
        second = self.next[at]
        after = self.next[second]
        self.ids[at], self.ids[second] = new, -2
        self.next[at] = after
        self.prev[after] = at


def _by_key(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    if len(keys):
        yield from zip(keys[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts))


class MergeTable:
    """Merges (a, b, id) in rank order, as arrays to look pairs up in."""

    def __init__(self, merges: Sequence[Merge]):
        table = np.array(merges, np.int64).reshape(-1, 3)
        code = code_of(table[:, 0], table[:, 1])
        self.table, self.order = table, np.argsort(code, kind="stable")
        self.sorted = code[self.order]
        self.new = table[:, 2].astype(np.int32)
        self._lay_out()

    def _lay_out(self) -> None:
        """A cell for each left and right id of use: the rank, CROSSED where only a later merge can join across the two,
        CUT where none can. Tables of too many cells are searched, and then ids count as CROSSED."""
        self.cells = None
        pairs = self.table.tolist()
        parts = {new: (a, b) for a, b, new in pairs}
        if not pairs or len(parts) < len(pairs) or len(pairs) > MAX_CELLED or any(new in p for new, p in parts.items()):
            return
        ends: list[dict[int, list[int]]] = [{}, {}]  # the ids at the left and right edges of what an id was merged from

        def edge(i: int, side: int) -> list[int]:
            found, at = [], i
            while at is not None and len(found) < MAX_CELLED:
                found.append(at)
                at = parts[at][side] if at in parts else None
            return ends[side].setdefault(i, found)

        crossed = {(x, y) for a, b, _ in pairs for x in edge(a, 1) for y in edge(b, 0)}
        lefts, rights = (sorted(set(side)) for side in zip(*crossed))
        if (len(lefts) + 1) * (len(rights) + 1) > MAX_CELLS:
            return
        top, width = max(lefts[-1], rights[-1]) + 1, len(rights) + 1
        self.left, self.right = np.zeros(top + 1, np.int32), np.zeros(top + 1, np.int32)
        self.left[lefts], self.right[rights] = (np.arange(len(lefts)) + 1) * width, np.arange(len(rights)) + 1
        cells = np.full((len(lefts) + 1) * width, CUT)
        x, y = np.array(list(crossed), np.int64).T
        cells[self.left[x] + self.right[y]] = CROSSED
        first = self.table[::-1]  # of a pair with two ranks the lower counts
        cells[self.left[first[:, 0]] + self.right[first[:, 1]]] = np.arange(len(pairs))[::-1]
        self.cells, self.top = cells, top

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(codes), NEVER)
        at = np.minimum(np.searchsorted(self.sorted, codes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == codes, self.order[at], NEVER)

    def states(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, CROSSED or CUT."""
        if self.cells is None:
            return np.minimum(self.ranks(code_of(a, b)), int(CROSSED)).astype(np.uint16)
        return self.cells[self.left[np.minimum(a, self.top)] + self.right[np.minimum(b, self.top)]]

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences with the pair of least rank merged wherever it is, until no known pair is left.

        Sequences are cut where no merge can join; the parts don't touch each other, so in a round each of them merges
        its own pair of least rank, and those without one are done. What is left after ROUNDS, long parts, goes rank
        by rank.
        """
        if not len(self.table) or not len(ids):
            return ids, bounds
        if len(self.table) >= int(CROSSED):
            return self._by_rank(ids, bounds)
        done, here = np.full(len(ids), -1, np.int32), np.arange(len(ids), dtype=np.int32)
        ids = ids.astype(np.int32)
        state = np.full(len(ids), CUT)
        state[:-1] = self.states(ids[:-1], ids[1:])
        state[bounds[1:][np.diff(bounds) > 0] - 1] = CUT
        for n in range(ROUNDS + 1):
            ends = np.flatnonzero(state == CUT) + 1
            starts = np.concatenate([[0], ends[:-1]])
            least = np.minimum.reduceat(state, starts)
            open_, size = least < CROSSED, ends - starts
            if not open_.all():
                going = np.repeat(open_, size)
                done[here[~going]] = ids[~going]
                ids, here, state, least, size = ids[going], here[going], state[going], least[open_], size[open_]
            if not len(ids):
                break
            if n == ROUNDS:
                cuts = bounds_of(size)
                ids, after = self._by_rank(ids, cuts)
                kept = np.arange(len(ids)) + np.repeat(cuts[:-1] - after[:-1], np.diff(after))
                done[here[kept]] = ids
                break
            at = np.flatnonzero(state == np.repeat(least, size))
            near = np.concatenate([[False], at[1:] == at[:-1] + 1])
            if near.any():  # of overlapping pairs, whose ids are equal, every second one
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(near, 0, index))) % 2 == 0]
            ids[at] = self.new[state[at]]
            state[at] = state[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, here, state = ids[keep], here[keep], state[keep]
            at -= np.arange(len(at))
            for beside in (at, at[at > 0] - 1):
                beside = beside[state[beside] != CUT]
                state[beside] = self.states(ids[beside], ids[beside + 1])
        alive = done >= 0
        return done[alive].astype(np.int64), np.concatenate([[0], np.cumsum(alive)])[bounds]

    def encode_repeated(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for sequences whose parts repeat, as they do where merges are few: equal parts of at most SHORT
        ids are encoded once."""
        if self.cells is None or len(ids) < 2 or ids.max() > 0xFFFF:
            return self.encode(ids, bounds)
        ends = bounds[1:][np.diff(bounds) > 0]
        state = np.full(len(ids), CUT)
        state[:-1] = self.states(ids[:-1], ids[1:])
        state[ends - 1] = CUT
        first, last = _stretches(state[:-1] != CUT, ends)
        joins = np.concatenate([[0], np.cumsum(state < CROSSED)])
        first, last = (x[joins[last] > joins[first]] for x in (first, last))
        size, out = last - first + 1, ids.astype(np.int32)
        narrow = out.astype(np.uint16)
        which = np.flatnonzero(size > SHORT)
        if len(which):
            cuts = bounds_of(size[which])
            here = np.arange(cuts[-1]) + np.repeat(first[which] - cuts[:-1], size[which])
            merged, after = self.encode(ids[here], cuts)
            out[here] = -1
            out[np.arange(len(merged)) + np.repeat(first[which] - after[:-1], np.diff(after))] = merged
        for n in np.unique(size[size <= SHORT]).tolist():
            starts = first[size == n]
            cells, order, heads = _grouped(narrow, starts, n)
            merged, after = self.encode(cells[order[heads], :n].ravel().astype(np.int64), np.arange(len(heads) + 1) * n)
            length = np.diff(after)
            made = np.full((len(heads), n), -1, np.int32)
            made[np.arange(n) < length[:, None]] = merged
            number = np.empty(len(starts), np.int64)
            number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(starts))))
            for k in range(n):
                out[starts + k] = made[number, k]
        alive = out >= 0
        return out[alive].astype(np.int64), np.concatenate([[0], np.cumsum(alive)])[bounds]

    def _by_rank(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chain = Chain(ids, bounds)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            found = self.ranks(chain.codes(at))
            known = found < NEVER
            for rank, places in _by_key(found[known], at[known]):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks, rank)
                waiting[rank].append(places)

        note(adjacent(bounds))
        while ranks:
            rank = heapq.heappop(ranks)
            a, b, new = self.table[rank].tolist()
            at = chain.occurrences(np.concatenate(waiting.pop(rank)), a, b)
            if len(at):
                chain.merge(at, new)
                note(chain.beside(at))
        alive = chain.ids[:-1] >= 0
        return chain.ids[:-1][alive], np.concatenate([[0], np.cumsum(alive)])[bounds]


def parts_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """A token's bytes merged by the ranks under `limit`, lowest first and of equals the leftmost."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def sum_pairs(ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, sum of weights, least place) of every pair; a sequence's weight and first place hold for all its pairs. Ids
    are below 65,536, so a pair and its place in the slice are one number, and sorting these is all that is needed."""
    at = adjacent(bounds)
    keys = np.sort(ids[at].astype(np.uint64) << 48 | ids[at + 1].astype(np.uint64) << 32 | at.astype(np.uint64))
    pairs, at = (keys >> 32).astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int64)
    if not len(pairs):
        return pairs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    codes = code_of(pairs[heads] >> 16, pairs[heads] & 0xFFFF)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = (weights == 1).all()
    n = np.diff(np.append(heads, len(pairs))) if same else np.add.reduceat(weights[owner[at]], heads)
    if (np.diff(places) > 0).all():  # then the first in the slice is the first
        return codes, n, places[owner[at[heads]]] + at[heads] - bounds[owner[at[heads]]]
    return codes, n, np.minimum.reduceat(places[owner[at]] + at - bounds[owner[at]], heads)


class PairSums:
    """What pairs of ids below 65,536 weigh in many slices: codes (a << 16 | b) are sorted `size` at a time."""

    def __init__(self, size: int):
        self.size, self.codes, self.weights, self.held = size, [], [], 0
        self.summed: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> None:
        if len(ids) < 2:
            return
        inner = np.ones(len(ids), bool)
        inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
        codes = (ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:].astype(np.uint32))[inner[:-1]]
        one = (weights == 1).all()
        self.weights.append(None if one else np.repeat(weights, np.diff(bounds))[inner])
        self.codes.append(codes)
        self.held += len(codes)
        if self.held >= self.size:
            self._sum()

    def _sum(self) -> None:
        plain = [c for c, w in zip(self.codes, self.weights) if w is None]
        if plain:
            codes = np.sort(np.concatenate(plain))
            heads = _heads(codes)
            self.summed.append((codes[heads], np.diff(np.append(heads, len(codes)))))
        weighted = [(c, w) for c, w in zip(self.codes, self.weights) if w is not None]
        if weighted:
            self.summed.append(_added(*map(np.concatenate, zip(*weighted))))
        self.codes, self.weights, self.held = [], [], 0
        if len(self.summed) > 8:
            self.summed = [_added(*map(np.concatenate, zip(*self.summed)))]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes in order, with their sums."""
        self._sum()
        return _added(*map(np.concatenate, zip(*self.summed))) if self.summed else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _added(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order].astype(np.int64)
    heads = _heads(codes)
    return codes[heads], np.add.reduceat(weights, heads) if len(heads) else weights


class PairSet:
    """Pairs, laid out as cells by left and right id where these are not too many."""

    def __init__(self, pairs: Sequence[tuple[int, int]]):
        a, b = np.array(list(pairs), np.int64).reshape(-1, 2).T
        self.sorted, self.cells = np.sort(code_of(a, b)), None
        lefts, rights = np.unique(a), np.unique(b)
        width = len(rights) + 1
        if len(a) and (len(lefts) + 1) * width <= MAX_CELLS:
            self.left, self.right = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
            self.left[lefts], self.right[rights] = (np.arange(len(lefts)) + 1) * width, np.arange(len(rights)) + 1
            self.cells = np.zeros((len(lefts) + 1) * width, bool)
            self.cells[self.left[a] + self.right[b]] = True

    def runs(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places of the longest runs whose adjacent pairs are all in the set."""
        if not len(self.sorted) or len(ids) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.cells is None:
            codes = code_of(ids[:-1], ids[1:])
            inside = self.sorted[np.minimum(np.searchsorted(self.sorted, codes), len(self.sorted) - 1)] == codes
        else:
            inside = self.cells[self.left[ids[:-1]] + self.right[ids[1:]]]
        return _stretches(inside, bounds[1:][np.diff(bounds) > 0])


def _stretches(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of the longest stretches in which each place is joined to the next; none goes over an end."""
    flags = np.zeros(len(joined) + 2, np.int8)
    flags[1:-1] = joined
    flags[ends] = 0
    turns = np.diff(flags)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _grouped(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, order, heads) of the stretches of n 16-bit ids from `starts` on: a row for each, an order in which equal
    rows are together and as they were given, and where each group begins in it."""
    cells = np.zeros((len(starts), -(-n // 4) * 4), np.uint16)
    for k in range(n):
        cells[:, k] = ids[starts + k]
    keys = cells.view(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T)
    keys = keys[order]
    return cells, order, np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))


#: Ids of a run that is compared as a few numbers; longer ones are compared as they stand.
SHORT = 12


def distinct_runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray, places: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(runs, sums of their weights, number of the first occurrence of each) of the runs of 16-bit ids, by their length;
    the first is that of the least of the numbers `places` (the first one most), if given, and else the first given."""
    size = last - first + 1
    same = (weight == 1).all()
    if places is None:
        every = np.arange(len(first))
    else:
        every = np.lexsort(places[::-1])
    held: dict[bytes, list[int]] = {}
    raw, step = ids.tobytes(), ids.itemsize
    long = every[size[every] > SHORT]
    for i, s, e, w in zip(long.tolist(), (first[long] * step).tolist(), ((last[long] + 1) * step).tolist(), weight[long].tolist()):
        held.setdefault(raw[s:e], [0, i])[0] += w
    yield list(held), np.array([w for w, _ in held.values()], np.int64), np.array([i for _, i in held.values()], np.int64)
    for n in np.unique(size[size <= SHORT]).tolist():
        which = every[size[every] == n]
        cells, order, heads = _grouped(ids, first[which], n)
        runs = np.ascontiguousarray(cells[order[heads], :n]).view(f"V{2 * n}").ravel().tolist()
        sums = np.diff(np.append(heads, len(which))) if same else np.add.reduceat(weight[which[order]], heads)
        yield runs, sums, which[order[heads]]


def learn(ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray, wanted: int, first_id: int, stop: tuple[int, int] | None = None) -> list[Merge]:
    """Up to `wanted` merges of weighted sequences laid end to end in the order of their first places, each of the
    heaviest pair and, of equally heavy ones, the one whose first place is least.

    `stop` is (weight, number of the sequence before which it first is) of the best pair that the sequences don't
    hold: learning ends before a pair that it beats.
    """
    chain = Chain(ids, bounds)
    owner = np.append(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), 0)
    weights = np.append(weights[owner[:-1]], 0)
    place = (owner << _WEIGHT_BITS) + np.arange(len(owner)) - bounds[owner]
    total: dict[int, int] = {}
    where: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int, int]] = []
    least = 0 if stop is None else stop[0]

    def grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each group, where it begins, places by group)"""
        codes = chain.codes(at)
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        heads = _heads(codes)
        return codes[heads], heads, at

    def push(at: np.ndarray) -> None:
        """Notes new pairs, but not those that weigh less than the pair that learning stops at: sums only fall."""
        codes, heads, at = grouped(at)
        if not len(heads):
            return
        sums, first, ends = np.add.reduceat(weights[at], heads), np.minimum.reduceat(place[at], heads), np.append(heads[1:], len(at))
        some = np.flatnonzero(sums >= least)
        for code, now, p, i, j in zip(codes[some].tolist(), sums[some].tolist(), first[some].tolist(), heads[some].tolist(), ends[some].tolist()):
            total[code], where[code] = now, at[i:j].copy()
            heapq.heappush(heap, (-now, p, code))

    push(adjacent(bounds))
    end = None if stop is None else (-stop[0], stop[1] << _WEIGHT_BITS)
    found: list[Merge] = []
    while heap and len(found) < wanted:
        weight, first, code = heap[0]
        now = total.get(code, 0)
        if now != -weight:
            heapq.heappop(heap)
            if now > 0:
                there = where[code]
                where[code] = there = there[chain.codes(there) == code]
                heapq.heappush(heap, (-now, int(place[there].min()), code))
            continue
        if end is not None and (weight, first) >= end:
            break
        a, b, new = code >> 32, code & 0xFFFFFFFF, first_id + len(found)
        found.append((a, b, new))
        at = chain.occurrences(where.pop(code), a, b)
        gone = chain.beside(np.concatenate([at, chain.next[at]]))
        codes, heads, gone = grouped(gone)
        for old, lost in zip(codes.tolist(), np.add.reduceat(weights[gone], heads).tolist()):
            if old in total:
                total[old] -= lost
        chain.merge(at, new)
        total.pop(code, None)
        push(chain.beside(at))
    return found
