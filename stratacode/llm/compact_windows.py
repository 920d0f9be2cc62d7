"""Substring dedup with compact windows.

Tokens are five-word shingles by position.  For one hash function a compact window ``(l, c, r)`` stands for all subsequences that begin in
``[l, c]`` and end in ``[c, r]``: their smallest hash sits at ``c``.  The windows of at least ``t`` tokens are the nodes of the Cartesian
tree over the hashes that span ``t`` tokens, about ``2 n / t`` per function however many subsequences they stand for.  Two passages
of similarity J share the smallest hash of each function with probability J, an exact repeat shares all.

1. One pass emits the window hashes; those held by different texts are counted out of the whole corpus.
2. A bitmap of fixed size over them lets a second pass keep only the stretches of text in which at least ``need`` functions hit.
3. Up to ``HOLDERS`` windows with one hash all meet each other.  More of them meet the first document that holds the hash (a star);
   pairs of stretches whose windows intersect in ``need`` functions along one diagonal are verified on their shingles.
4. The first holder of one hash may hold too little of a passage that later documents share.  So the windows of one function also
   meet by the hash of a run of shingles about their smallest one, just long enough that all who hold it are similar: no
   holder of such a run can stand between two others.
5. Where a hash has more holders, all pairs of them are compared too, block against block, by the shingles around their windows.  Those
   similar to an earlier holder over the least length are its class and do not meet each other again, so a passage shared by a third of all documents
   costs a few pairs each and block; any other two meet if they share the shingles that a passage of the least length needs.  A quote that is too
   short ends in the comparison.

Texts equal but for case are one text: copies are reported whole and never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.decontaminate import slots
from stratacode.llm.shingles import mix, shingle_hashes, word_hashes, word_spans
from stratacode.llm.staging import stage
from stratacode.llm.text import fresh, lowered, whole, words

MIN_WORDS, WIDTH, PERCENT = 50, 5, 75
FUNCTIONS, NEED = 6, 2
BITMAP_BITS = 27  # 16 MB, whatever the corpus
PLACE_BITS = 24
SEGMENT = 1 << 22
HOLDERS = 16  # windows of one hash up to which they are paired as a list
BLOCK = 2048  # windows of one hash, about, that a task compares with as many others
TOGETHER = 64  # windows of one hash, close together in one stretch, that share a row
SKETCH = 512  # bits of a window's neighbourhood
RUNS = 8  # runs of shared shingles up to which all ranges are tried


def multipliers(functions: int) -> np.ndarray:
    """Odd multipliers, one hash function each over hashes that are already mixed."""
    return mix(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)


def window_minima(tokens: np.ndarray, t: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """``(f, c)`` of the compact windows of at least ``t`` tokens: hash function and place, both ascending.

    A node of the Cartesian tree spans ``t`` tokens exactly if it is the smallest of some ``t`` consecutive ones, so the places are
    those of the sliding minima, which never move back.  Ties go to the earlier place.
    """
    n = len(tokens)
    if n < t:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    blocks = -(-n // t)
    held = np.full((functions, blocks * t), np.iinfo(np.uint64).max, np.uint64)
    held[:, :n] = ((tokens[None, :] * multipliers(functions)[:, None]) & ~low) | np.arange(n, dtype=np.uint64)
    shaped = held.reshape(functions, blocks, t)
    ahead = np.minimum.accumulate(shaped, axis=2).reshape(functions, -1)
    behind = np.minimum.accumulate(shaped[:, :, ::-1], axis=2)[:, :, ::-1].reshape(functions, -1)
    smallest = np.minimum(behind[:, : n - t + 1], ahead[:, t - 1 : n])
    new = np.ones(smallest.shape, bool)
    new[:, 1:] = smallest[:, 1:] != smallest[:, :-1]
    f, at = np.nonzero(new)
    return f, (smallest[f, at] & low).astype(np.int64)


def cartesian_spans(tokens: np.ndarray, f: np.ndarray, places: np.ndarray, t: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends ``(l, r)`` of the compact windows at ``places``, cut at ``t`` tokens around each: the next smaller tokens on either side."""
    n = len(tokens)
    steps = np.arange(1, t + 1)

    def reach(sign: int) -> np.ndarray:
        at = places[:, None] + sign * steps
        inside = (at >= 0) & (at < n)
        smaller = (tokens[np.where(inside, at, 0)] * odd[f][:, None] < (tokens[places] * odd[f])[:, None]) | ~inside
        return np.where(smaller.any(1), smaller.argmax(1), t)

    return places - reach(-1), places + reach(1)


def shortest_run(t: int, percent: int) -> int:
    """Fewest consecutive shared tokens that make two passages of ``t`` tokens similar: the ``k`` with ``k / (2 t - k) = percent``."""
    return -(-2 * t * percent // (100 + percent))


def run_keys(tokens: np.ndarray, left: np.ndarray, places: np.ndarray, right: np.ndarray, run: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """``(window, key)``: hashes of runs of ``run`` tokens about the smallest one, inside the compact windows.

    ``t`` equal tokens whose smallest is at ``places`` hold one of these runs wherever they begin, at the same distance from the smallest.
    """
    back = np.arange(0, t, t - run + 1)
    begins = places[:, None] - back[None, :]
    which, column = np.nonzero((begins >= left[:, None]) & (begins + run - 1 <= right[:, None]))
    at = begins[which, column]
    weights = mix(np.arange(1, run + 1, dtype=np.uint64)) | np.uint64(1)
    key = np.zeros(len(at), np.uint64)
    for i in range(run):
        key += tokens[at + i] * weights[i]
    return which, mix(key + np.uint64(run))


def segments(tokens: np.ndarray, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a very long text that overlap by two windows."""
    for start in range(0, max(1, len(tokens)), SEGMENT):
        yield start, tokens[start : start + SEGMENT + 2 * t]


def _keys(t: int, functions: int, width: int):
    odd = multipliers(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, prints = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
            for text, mark in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                tokens = shingle_hashes(word_hashes(text), width)
                found = []
                for _, part in segments(tokens, t):
                    f, c = window_minima(part, t, functions)
                    found.append(part[c] * odd[f])
                found = np.unique(np.concatenate(found))
                keys.append(found)
                prints.append(np.full(len(found), mark, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(prints))], ["key", "mark"])

    return run


def _stretches(bitmap, bits: int, t: int, functions: int, need: int, width: int, run_length: int):
    odd = multipliers(functions)
    names = ["doc_id", "print", "start", "words", "key", "f", "l", "c", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bitmap.value, np.uint8)

        def on(places: np.ndarray) -> np.ndarray:
            return (marked[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1

        for rows in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for key, text, mark in zip(*[rows.column(i).to_pylist() for i in range(3)]):
                word = word_hashes(text)
                tokens = shingle_hashes(word, width)
                short = (word >> np.uint64(32)).astype(np.uint32)
                hits = []
                for start, part in segments(tokens, t):
                    f, places = window_minima(part, t, functions)
                    value = part[places] * odd[f]
                    high, low = slots(value, bits)
                    keep = np.flatnonzero(on(high))
                    keep = keep[on(low[keep]) == 1]
                    if len(keep):
                        f, places, value = f[keep], places[keep], value[keep]
                        left, right = cartesian_spans(part, f, places, t, odd)
                        hits.append((left + start, places + start, right + start, f, value.view(np.int64)))
                if not hits:
                    continue
                left, at, right, f, value = (np.concatenate(x) for x in zip(*hits))
                order = np.argsort(left, kind="stable")
                left, at, right, f, value = left[order], at[order], right[order], f[order], value[order]
                # Windows that overlap form a stretch.
                reach = np.maximum.accumulate(right)
                cuts = np.flatnonzero(left[1:] > reach[:-1]) + 1
                for piece in np.split(np.arange(len(left)), cuts):
                    if len(np.unique(f[piece])) < need:
                        continue
                    first, last = int(left[piece[0]]), int(right[piece].max())
                    base = piece[f[piece] == 0]
                    which, exact = run_keys(tokens, left[base], at[base], right[base], run_length, t)
                    exact, once = np.unique(exact, return_index=True)  # periodic text holds one run many times
                    piece, base = np.concatenate([piece, base[which[once]]]), len(piece)
                    values, kinds = value[piece], f[piece]
                    values[base:], kinds[base:] = exact.view(np.int64), functions
                    row = (key, mark, first, short[first : last + width].tobytes(), values, kinds, left[piece], at[piece], right[piece])
                    for column, x in zip(out, row):
                        column.append(x)
            types = [rows.schema.field(0).type, pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types)], names)

    return run


def _neighbourhoods(t: int, width: int):
    """The shingles ``t - 1`` places to either side of each listed window of a stretch, 32 bits each.

    Windows of one hash that lie close together, as repeated lines have them, share one row: the shingles from ``begin`` on and the ``places`` of the windows,
    up to ``TOGETHER`` of them.  Windows of one hash with equal neighbourhoods, as periodic text has them, are listed once a stretch.
    """
    names = ["key", "doc_id", "stretch", "begin", "tokens", "places"]
    around = np.arange(1 - t, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                rows = whole_batch.slice(at, 256)
                out: tuple[list, ...] = tuple([] for _ in names)
                for doc, stretch, start, text, windows in zip(*[rows.column(i).to_pylist() for i in range(5)]):
                    tokens = shingle_hashes(np.frombuffer(text, np.uint32).astype(np.uint64), width).astype(np.uint32)
                    tokens[tokens == 0] = 1
                    places = np.array([w["c"] for w in windows], np.int64) - start
                    every = places[:, None] + around
                    near = np.where((every >= 0) & (every < len(tokens)), tokens[np.clip(every, 0, len(tokens) - 1)], np.uint32(0))
                    seen, listed = set(), []
                    for w, place, x in zip(windows, places.tolist(), near):
                        mark = (w["key"], x.tobytes())
                        if mark in seen:
                            continue
                        seen.add(mark)
                        last = listed[-1] if listed else None
                        if last and last[0] == w["key"] and place - last[1][-1] < 2 * t and len(last[1]) < TOGETHER:
                            last[1].append(place)
                        else:
                            listed.append((w["key"], [place]))
                    for key, held in listed:
                        begin, end = max(0, held[0] - t + 1), min(len(tokens), held[-1] + t)
                        row = (key, doc, stretch, start + begin, tokens[begin:end].tobytes(), [start + x for x in held])
                        for column, value in zip(out, row):
                            column.append(value)
                types = [pa.int64(), rows.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types)], names)

    return run


def _fewest(near: np.ndarray, t: int) -> np.ndarray:
    """Per neighbourhood the fewest different shingles that ``t`` of its places in a row hold."""
    order = np.argsort(near, axis=1, kind="stable")
    line = np.take_along_axis(near, order, axis=1)
    last = np.full(near.shape, -1, np.int16)  # the place before that holds the same
    np.put_along_axis(last, order[:, 1:], np.where(line[:, 1:] == line[:, :-1], order[:, :-1], -1).astype(np.int16), axis=1)
    out = np.full(len(near), t)
    for x in range(near.shape[1] - t + 1):
        inside = (near[:, x : x + t] > 0).all(1)
        out = np.where(inside, np.minimum(out, (last[:, x : x + t] < x).sum(1)), out)
    return out


def crowded_pairs(near: np.ndarray, rank: np.ndarray, side: np.ndarray, t: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(later, earlier)``: rows of ``near``, neighbourhoods of equal windows, that can hold one passage, by the rank of their documents.

    Two rows meet if their sets of shingles share what passages of ``t`` places need, of the fewest different shingles that the neighbourhood has there.  A bit per shingle
    rules most pairs out: equal shingles number no more than equal bits and the shingles that share a bit on one side.  Those whose ``t`` places are similar place by
    place to an earlier row are its class; two rows of one class have both met that row and do not meet again.  Only rows of different ``side`` meet if there are two.
    """
    order = np.lexsort((np.arange(len(rank)), rank))
    rank, side = rank[order], side[order]
    # Shingles are numbered by value, 0 stays 0; a mark per number then tells what a row holds.
    values, near = np.unique(np.append(np.uint32(0), near[order]), return_inverse=True)
    near = near[1:].reshape(len(order), -1).astype(np.int32)
    held = np.zeros(len(values), bool)
    kept = np.sort(near, axis=1)
    places = (kept > 0).sum(1)
    kept[:, 1:][kept[:, 1:] == kept[:, :-1]] = 0
    distinct = (kept > 0).sum(1)
    spare, fewest = places - distinct, _fewest(near, t)
    bits = np.zeros((len(near), SKETCH), bool)
    row, column = np.nonzero(kept)
    bits[row, values[kept[row, column]] % SKETCH] = True
    sketch = np.packbits(bits, axis=1).view(np.uint64)
    hidden = distinct - bits.sum(1)
    del bits
    two = side.min() != side.max()
    classes, number = np.zeros((len(near), 1), np.uint64), 0
    least = shortest_run(t, percent)
    later, earlier = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(near), 64):
        chunk = slice(begin, begin + 64)
        equal = np.zeros((len(near[chunk]), len(near) - begin), np.uint16)
        for word in range(sketch.shape[1]):
            equal += np.bitwise_count(sketch[chunk, word][:, None] & sketch[begin:, word][None, :])
        need = -(-(fewest[chunk][:, None] + fewest[begin:][None, :]) * percent // (100 + percent))
        fits = equal + np.minimum(hidden[chunk][:, None], hidden[begin:][None, :]) >= need
        fits &= np.arange(fits.shape[0])[:, None] < np.arange(fits.shape[1])[None, :]
        meets = fits & (rank[chunk][:, None] < rank[begin:][None, :])
        if two:
            meets &= side[chunk][:, None] != side[begin:][None, :]
        for i in np.flatnonzero(meets.any(1)).tolist():
            j = np.flatnonzero(fits[i])
            meet, least_shared = meets[i, j], need[i, j]
            i, j = i + begin, j + begin
            new = ~(classes[j] & classes[i]).any(1)
            j, meet, least_shared = j[new], meet[new], least_shared[new]
            if not meet.any():
                continue
            held[kept[i]], held[0] = True, False
            shares = held[kept[j]].sum(1) >= least_shared
            j, meet = j[shares], meet[shares]
            inside = held[near[j]]
            held[kept[i]] = False
            if not meet.any():
                continue
            # A passage of p places about the window shares (p + t) percent / (100 + percent) of them at least.
            total = np.cumsum((100 + percent) * inside.astype(np.int32) - percent, axis=1, dtype=np.int32)
            most = total[:, t - 1 :].max(1) - np.minimum(total[:, : t - 1].min(1), 0)
            close = most >= percent * (t - spare[i] - spare[j])
            j, meet = j[close], meet[close]
            if not meet.any():
                continue
            later.append(j[meet])
            earlier.append(np.full(meet.sum(), i))
            same = np.cumsum((near[j] == near[i]) & (near[j] > 0), axis=1, dtype=np.int16)
            same[:, t:] -= same[:, :-t].copy()
            members = j[(same[:, t - 1 :] >= least).any(1)]
            if number == 64 * classes.shape[1]:
                classes = np.concatenate([classes, np.zeros_like(classes)], axis=1)
            bit = np.uint64(1) << np.uint64(number % 64)
            classes[i, number // 64] |= bit
            classes[members, number // 64] |= bit
            number += 1
    return order[np.concatenate(later)], order[np.concatenate(earlier)]


def chained(stretch: np.ndarray, kept: np.ndarray, diagonal: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, chain, stays)`` of pairs of windows of two stretches: their order by stretches and diagonal, the chain of each and whether it stays.

    A chain is what the verifier takes as one cluster: diagonals no more than ``t`` apart.  The first and the last one of every ``t`` places hold a chain together.
    """
    order = np.lexsort((diagonal, kept, stretch))
    a, b, d = stretch[order], kept[order], diagonal[order]
    other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begins = np.concatenate([[True], other | (np.diff(d) > t)])
    chain = np.cumsum(begins) - 1
    part = (d - d[begins][chain]) // t
    edge = begins[1:] | (np.diff(part) != 0)
    return order, chain, np.concatenate([[True], edge]) | np.concatenate([edge, [True]])


def _crowded(t: int, functions: int, percent: int):
    names = ["stretch", "l", "c", "r", "kept_stretch", "kl", "kc", "kr", "f"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("begin", "ascending")])  # whichever task sent them first
        held = [np.array(x, np.int64) for x in rows.column("places").to_pylist()]
        count = np.array([len(x) for x in held])
        row = np.repeat(np.arange(len(held)), count)
        pad = np.zeros(t - 1, np.uint32)
        near = np.empty((len(row), 2 * t - 1), np.uint32)
        begin, size, at = rows.column("begin").to_numpy(), np.empty(len(held), np.int64), 0
        for i, (tokens, places) in enumerate(zip(rows.column("tokens").to_pylist(), held)):
            line = np.concatenate([pad, np.frombuffer(tokens, np.uint32), pad])
            near[at : at + len(places)] = np.lib.stride_tricks.sliding_window_view(line, 2 * t - 1)[places - begin[i]]
            size[i], at = len(tokens) // 4, at + len(places)
        rank = pc.rank(rows.column("doc_id"), tiebreaker="dense").to_numpy().astype(np.int64)
        c, stretch, begin, end = np.concatenate(held), rows.column("stretch").to_numpy()[row], begin[row], (begin + size)[row]
        left, right = np.maximum(begin, c - t + 1), np.minimum(end, c + t) - 1
        later, earlier = crowded_pairs(near, rank[row], rows.column("block").to_numpy()[row], t, percent)
        if not len(later):
            return pa.table([pa.array([], pa.int64() if "stretch" in x else pa.int32()) for x in names], names)
        # The verifier looks at the ends of a chain of windows, so what lies inside it tells no more.
        order, chain, stays = chained(stretch[later], stretch[earlier], c[later] - c[earlier], t)
        later, earlier, first = later[order], earlier[order], np.flatnonzero(np.diff(chain, prepend=-1))
        ends = [np.minimum.reduceat(left[later], first), np.maximum.reduceat(right[later], first),
                np.minimum.reduceat(left[earlier], first), np.maximum.reduceat(right[earlier], first)]
        l, r, kl, kr = (x[chain[stays]] for x in ends)
        later, earlier = later[stays], earlier[stays]
        columns = [stretch[later], l, c[later], r, stretch[earlier], kl, c[earlier], kr, np.full(len(later), functions)]
        return pa.table([pa.array(x, pa.int64() if "stretch" in y else pa.int32()) for x, y in zip(columns, names)], names)

    return run


def _runs(marked: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Ranges of marked places, joined across at most ``gap`` unmarked ones."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), (at[np.concatenate([cuts, [len(at) - 1]])] + 1).tolist()))


def _widened(x: int, y: int, t: int, n: int) -> tuple[int, int]:
    """The range grown to ``t`` places on both sides, as far as ``n`` places allow."""
    x = max(0, x - max(0, t - (y - x)) // 2)
    y = min(n, max(y, x + t))
    return max(0, min(x, y - t)), y


def _partner(a: np.ndarray, x: int, y: int, b: np.ndarray, t: int, percent: int) -> tuple[int, int, int, int, float] | None:
    """The range ``[x, y)`` of ``a``, of ``t`` places at least, with its most similar range of ``b``; None below ``percent``."""
    x, y = _widened(x, y, t, len(a))
    if y - x < t:
        return None
    left = np.unique(a[x:y])
    inside = np.isin(b, left)
    marks = np.concatenate([[0], np.cumsum(inside)])
    if 100 * marks[-1] < percent * len(left):
        return None
    # What b has inserted is at most the share that the similarity leaves over.
    gap = (y - x) * (100 - percent) // percent
    at = np.flatnonzero(inside)
    gap = min(gap, int(np.diff(at).max(initial=1)) - 1)
    while True:
        best = None
        for u, v in _runs(inside, gap):
            u, v = _widened(u, v, t, len(b))
            if v - u < t or 100 * (marks[v] - marks[u]) < percent * len(left):
                continue
            right = np.unique(b[u:v])
            both = len(np.intersect1d(left, right, assume_unique=True))
            score = both / (len(left) + len(right) - both)
            if 100 * both >= percent * (len(left) + len(right) - both) and (best is None or score > best[4]):
                best = (x, y, u, v, score)
        if best is not None or not gap:
            return best
        gap //= 2


def passages(a: np.ndarray, b: np.ndarray, t: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Near-equal passages of two stretches of shingles: ``(a_first, a_end, b_first, b_end, similarity)`` in shingle places.

    A passage begins and ends at a run of shared shingles and holds any unshared ones between; if that is less than ``t`` places, its
    neighbours fill it up.  The exact similarity of the shingle sets decides.  The longest passage is taken first, then what
    lies on either side; ranges of more than ``RUNS`` runs that are not similar as a whole are cut at their widest gap.
    """
    found: list[tuple[int, int, int, int, float]] = []
    open_ranges = [_runs(np.isin(a, b), 0)]
    while open_ranges:
        runs = open_ranges.pop()
        if not runs:
            continue
        edges = np.array(runs)
        held = np.concatenate([[0], np.cumsum(edges[:, 1] - edges[:, 0])])
        if 100 * held[-1] < percent * t:
            continue
        # No passage spans a gap that its shared shingles cannot make up for.
        gaps = edges[1:, 0] - edges[:-1, 1]
        cuts = np.flatnonzero(gaps * percent > held[-1] * (100 - percent)) + 1
        if not len(cuts) and 100 * held[-1] >= percent * max(edges[-1, 1] - edges[0, 0], t):
            whole_range = _partner(a, runs[0][0], runs[-1][1], b, t, percent)
            if whole_range is not None:
                found.append(whole_range)
                continue
        if not len(cuts) and len(runs) > RUNS:
            cuts = np.array([np.argmax(gaps) + 1])
        if len(cuts):
            ends = [0, *cuts.tolist(), len(runs)]
            open_ranges += [runs[x:y] for x, y in zip(ends, ends[1:])]
            continue
        tries = [(runs[j][1] - runs[i][0], i, j) for i in range(len(runs)) for j in range(i, len(runs)) if j - i + 1 < len(runs)]
        for size, i, j in sorted(tries, key=lambda k: (-k[0], k[1])):
            if 100 * (held[j + 1] - held[i]) < percent * max(size, t):
                continue
            inner = _partner(a, runs[i][0], runs[j][1], b, t, percent)
            if inner is not None:
                found.append(inner)
                open_ranges += [runs[:i], runs[j + 1 :]]
                break
    return found


def _verifier(t: int, functions: int, need: int, percent: int, width: int):
    names = ["doc_id", "start_word", "end_word", "kept_doc_id", "kept_start", "kept_end", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair may have hundreds of windows, which are large as Python values.
        for rows in (batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64)):
            out: list[tuple] = []
            for r in rows.to_pylist():
                w = sorted(((x["c"] - x["kc"], x["f"], x["l"], x["r"], x["kl"], x["kr"]) for x in r["windows"]))
                clusters, last = [], None
                for x in w:  # windows along one diagonal; beyond t inserted words a passage is two
                    if last is None or x[0] - last > t:
                        clusters.append([])
                    clusters[-1].append(x)
                    last = x[0]
                # 32 bits a word tell shingles of five words apart.
                a_words, b_words = (np.frombuffer(r[side], np.uint32).astype(np.uint64) for side in ("words", "kept_words"))
                a_all, b_all = shingle_hashes(a_words, width), shingle_hashes(b_words, width)
                done = set()
                for cluster in clusters:
                    kinds = {x[1] for x in cluster}
                    if len(kinds) < need and functions not in kinds:
                        continue
                    al, ar = min(x[2] for x in cluster) - r["start"], max(x[3] for x in cluster) + 1 - r["start"]
                    bl, br = min(x[4] for x in cluster) - r["kept_start"], max(x[5] for x in cluster) + 1 - r["kept_start"]
                    for x, y, u, v, score in passages(a_all[al:ar], b_all[bl:br], t, percent):
                        x, y, u, v = x + al + r["start"], y + al + r["start"], u + bl + r["kept_start"], v + bl + r["kept_start"]
                        if (x, y) not in done:
                            done.add((x, y))
                            out.append((r["doc_id"], x, y + width - 1, r["kept_doc_id"], u, v + width - 1, score))
            columns = list(zip(*out)) or [()] * 7
            key = rows.schema.field("doc_id").type
            types = [key, pa.int64(), pa.int64(), key, pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, types)], names)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, width: int = WIDTH,
                      percent: int = PERCENT, functions: int = FUNCTIONS, need: int = NEED, bitmap_bits: int = BITMAP_BITS, holders: int = HOLDERS, block: int = BLOCK) -> DataFrame:
    """Passages of at least ``min_words`` words that near-duplicate a passage of a document with a smaller id.

    One row per passage and partner: doc_id, start_word, end_word (excluded), kept_doc_id, kept_start, kept_end, similarity (Jaccard of
    shingle sets, ``percent`` % at least).  References always lead to smaller ids, so one occurrence of every
    passage is never listed under its own doc_id.  A document whose text another one with a smaller id has, apart from the case
    of A-Z, is listed whole, from word 0, with similarity 1.

    Passages of ``min_words`` equal words are always found unless shingles repeat inside them.  A passage with changed words, of similarity 0.75, is missed by chance
    once in 200 times with the default six functions, whatever other documents hold of it.  Where more than ``holders`` windows share a hash, two that are both
    similar to an earlier one are listed with that one and not with each other.
    Null, empty and short texts have no passages; rows without an id take no part; rows repeated under one id are one document; an
    empty table gives no rows.  Repeats inside one document are not looked for.  Other columns are not read.
    """
    spark = docs.sparkSession
    t = min_words - width + 1
    text = whole(F.col(f"`{text_col}`"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).where(F.col("doc_id").isNotNull())
    id_field = st.StructField("doc_id", narrow.schema["doc_id"].dataType)
    key_type = id_field.dataType
    mark = F.md5(lowered(F.col("text")).cast("binary"))

    # Whole copies.
    prints = stage(narrow.select("doc_id", mark.alias("print")), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id != last")
    copied = stage(prints.join(classes, "print").where("doc_id != kept_doc_id").select("doc_id", "print", "kept_doc_id").distinct(), "copies")
    sized = narrow.join(copied, "doc_id").where(mark == F.col("print")).select("doc_id", "kept_doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n"))
    zero = F.lit(0).cast("bigint")
    copies = (
        sized.where(F.col("n") >= min_words).distinct()
        .select("doc_id", zero.alias("start_word"), F.col("n").alias("end_word"), "kept_doc_id", zero.alias("kept_start"), F.col("n").alias("kept_end"),
                F.lit(1.0).alias("similarity"))
    )

    # 1: window hashes held by different texts.
    short = F.shiftright(F.xxhash64(mark), 32).cast("int")
    key_schema = st.StructType([st.StructField("key", st.LongType()), st.StructField("mark", st.IntegerType())])
    keys = narrow.select("doc_id", "text", short.alias("mark")).mapInArrow(_keys(t, functions, width), key_schema)
    shared = keys.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo != hi").select("key")
    slot = F.explode(F.array(F.shiftrightunsigned("key", 64 - bitmap_bits), F.col("key").bitwiseAND((1 << bitmap_bits) - 1)))
    chunks = (
        shared.select(slot.alias("slot")).select((F.col("slot") + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    marked = np.zeros(1 << (bitmap_bits - 3), np.uint8)
    for row in stage(chunks, "bitmap").collect():  # 2^bitmap_bits bits at most
        at = (row["chunk"] - 1) * len(row["bits"])
        marked[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(marked.tobytes())

    # 2: stretches of text with enough hits, one document per text.
    schema = st.StructType([id_field, st.StructField("print", st.StringType()), st.StructField("start", st.LongType()), st.StructField("words", st.BinaryType()),
                            st.StructField("key", st.ArrayType(st.LongType())), *[st.StructField(c, st.ArrayType(st.IntegerType())) for c in ("f", "l", "c", "r")]])
    found = narrow.select("doc_id", "text", mark.alias("print")).mapInArrow(_stretches(bitmap, bitmap_bits, t, functions, need, width, shortest_run(t, percent)), schema)
    found = stage(found.withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    first = found.groupBy("print", "start").agg(F.min(F.struct("doc_id", "stretch")).alias("x")).select(F.col("x.stretch").alias("stretch"))

    # 3: windows of equal hash; few of them all meet, more meet the first document that holds it.
    window = F.explode(F.arrays_zip("key", "f", "l", "c", "r")).alias("w")
    hits = found.select("stretch", "doc_id", "key", "f", "l", "c", "r").join(stage(first, "first"), "stretch", "left_semi")
    hits = hits.select("stretch", "doc_id", window).select("stretch", "doc_id", "w.*")
    head = F.min(F.struct("doc_id", "stretch", "l", "c", "r")).alias("k")
    heads = hits.groupBy("key").agg(head, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("k.doc_id != last").select("key", "k", "n")
    held = stage(hits.join(heads, "key"), "held")
    lists = held.where(F.col("n") <= holders).groupBy("key").agg(F.collect_list(F.struct("stretch", "doc_id", "f", "l", "c", "r")).alias("all"))
    few = lists.select(F.explode("all").alias("w"), "all").select("w.*", F.explode(F.filter("all", lambda x: x["doc_id"] < F.col("w.doc_id"))).alias("k"))
    many = held.where(F.col("n") > holders)
    ends = ["stretch", "l", "c", "r", F.col("k.stretch").alias("kept_stretch"), F.col("k.l").alias("kl"), F.col("k.c").alias("kc"), F.col("k.r").alias("kr"), "f"]
    met = few.select(*ends).unionByName(many.where(F.col("doc_id") != F.col("k.doc_id")).select(*ends))

    # 5: the holders of one hash that are many, block against block.
    listed = many.where(F.col("f") < functions).groupBy("stretch").agg(F.sort_array(F.collect_list(F.struct("key", "c", "n"))).alias("windows"))
    long, place = st.LongType(), st.IntegerType()
    near_schema = st.StructType([st.StructField("key", long), id_field, st.StructField("stretch", long), st.StructField("begin", long),
                                 st.StructField("tokens", st.BinaryType()), st.StructField("places", st.ArrayType(place))])

    def near(windows: DataFrame) -> DataFrame:
        return found.join(windows, "stretch").select("doc_id", "stretch", "start", "words", "windows").mapInArrow(_neighbourhoods(t, width), near_schema)

    # Only hashes of more windows than a block holds need more than one, and there is at most one such hash for every block of windows.
    largest = listed.withColumn("windows", F.filter("windows", lambda w: w["n"] > block)).where(F.size("windows") > 0)
    counts = near(largest).groupBy("key").agg(F.sum(F.size("places")).alias("n")).where(F.col("n") > block)
    last_block = F.coalesce(F.floor((F.col("n") - 1) / F.lit(block)).cast("int"), F.lit(0))
    own_block = F.pmod(F.xxhash64("stretch", "begin"), last_block + 1).cast("int")
    dealt = near(listed).join(F.broadcast(counts), "key", "left").withColumn("block", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), last_block))).drop("n")
    pair_schema = st.StructType([st.StructField("stretch", long), *[st.StructField(c, place) for c in ("l", "c", "r")], st.StructField("kept_stretch", long),
                                 *[st.StructField(c, place) for c in ("kl", "kc", "kr", "f")]])
    blocks = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other").groupBy("key", "x", "y")
    met = met.unionByName(blocks.applyInArrow(_crowded(t, functions, percent), pair_schema))
    pairs = (
        met.groupBy("stretch", "kept_stretch")
        .agg(F.count_distinct("f").alias("functions"), F.max("f").alias("last_f"),
             F.collect_list(F.struct("f", "l", "c", "r", "kl", "kc", "kr")).alias("windows"))
        .where((F.col("functions") >= need) | (F.col("last_f") == functions))
    )
    pairs = stage(pairs, "pairs")
    side = found.select("stretch", "doc_id", "start", "words")
    sides = (
        pairs.join(side, "stretch")
        .join(side.toDF("kept_stretch", "kept_doc_id", "kept_start", "kept_words"), "kept_stretch")
        .select("doc_id", "start", "words", "kept_doc_id", "kept_start", "kept_words", "windows")
    )
    out = st.StructType([
        id_field, st.StructField("start_word", st.LongType()), st.StructField("end_word", st.LongType()), st.StructField("kept_doc_id", key_type),
        st.StructField("kept_start", st.LongType()), st.StructField("kept_end", st.LongType()), st.StructField("similarity", st.DoubleType()),
    ])
    return sides.mapInArrow(_verifier(t, functions, need, percent, width), out).unionAll(copies)


def _without(text: str, spans: list[dict]) -> str:
    """The text without the given word ranges."""
    raw = text.encode("utf-8")
    starts = word_spans(text)[1]
    change = np.zeros(len(starts) + 1, np.int64)
    for s in spans:
        change[min(s["a"], len(starts))] += 1
        change[min(s["b"], len(starts))] -= 1
    kept, at = [], 0
    for x, y in _runs(np.cumsum(change[:-1]) > 0, 0):
        kept.append(raw[at : starts[x]])
        at = int(starts[y]) if y < len(starts) else len(raw)
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8").strip()


def _cutter(names: list[str], text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            *columns, listed = rows.columns
            texts, spans = columns[text_at].to_pylist(), listed.to_pylist()
            sizes = columns[chars_at].to_pylist() if chars_at is not None else []
            keep = []
            for i, found in enumerate(spans):
                if found and texts[i]:
                    texts[i] = _without(texts[i], found)
                    if sizes:
                        sizes[i] = len(texts[i])
                keep.append(not found or bool(texts[i]))
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if sizes:
                columns[chars_at] = pa.array(sizes, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return run


def cut_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the listed word spans; documents of which no word is left are dropped.

    Only listed documents change (a null text and a row without id stay as they are); a length column named ``n_chars`` follows the text.
    All columns of ``docs`` come back in their order.  The texts move once, to meet their spans.
    """
    words = F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b")))
    gone, listed = fresh(docs, "gone", "spans")
    by_id = spans.groupBy(F.col("doc_id").alias(gone)).agg(words.alias(listed))
    joined = docs.join(by_id, F.col(f"`{id_col}`") == F.col(gone), "left").drop(gone)
    names = docs.columns
    cut = _cutter(names, names.index(text_col), names.index("n_chars") if "n_chars" in names else None)
    return joined.mapInArrow(cut, docs.schema)
