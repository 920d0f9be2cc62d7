from __future__ import annotations

import random
import tracemalloc
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest

from stratacode.llm import bottomk, compact_windows as cw, decontaminate as dc

from llm_corpora import prose, words_of

from stratacode.llm.staging import BATCH, stage


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(rng, text, changes):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), min(changes, len(w))):
        w[i] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(w)


def components(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_equal_brute_force(make, monkeypatch):
    monkeypatch.setattr(bottomk, "BLOCK_MEMBERS", 16)
    rng = random.Random(11)
    pairs = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    base = prose(rng, 150)
    pairs += [(100 + i, edited(rng, base, rng.randint(0, 9))) for i in range(60)]  # one large near group, not all linked to one
    chain = prose(rng, 200)
    for i in range(8):
        pairs.append((200 + i, chain))
        chain = edited(rng, chain, 5)
    shared = prose(rng, 60)
    pairs += [(300 + i, shared + " " + prose(rng, 60)) for i in range(40)]  # a common passage is no near copy
    pairs += [(400 + i, t) for i, t in enumerate(["x y", "X  y", "x y z", "", None, "one two three four five", "one two three four five six"])]
    out = {r["doc_id"]: r for r in bottomk.near_duplicates(make(pairs)).collect()}
    want = components(pairs)
    for i, t in pairs:
        assert out[i]["component_id"] == want[i] and out[i]["kept"] == (want[i] == i) and out[i]["n_shingles"] == len(shingles(t))


def test_near_duplicates_of_odd_rows(edge):
    out = bottomk.near_duplicates(edge)
    assert out.count() == edge.count()
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()}
    assert {(6, 5, False), (8, 7, False), (None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)} <= rows
    one = bottomk.keep_one(edge)
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == edge.columns and sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 9, 10] and ids.count(None) == 2
    assert bottomk.near_duplicates(edge.limit(0)).count() == 0


def test_one_id_with_two_texts_ties_their_groups(make):
    rng = random.Random(12)
    a, b = prose(rng, 80), prose(rng, 80)
    out = bottomk.near_duplicates(make([(1, a), (5, a), (5, b), (9, b)])).collect()
    assert {r["component_id"] for r in out} == {1}


@pytest.mark.parametrize("blocks", [1, 2])
def test_block_comparison_is_exact_and_small(blocks):
    rng = np.random.default_rng(3)
    common = rng.integers(-(2**62), 2**62, 600)
    sets = [np.unique(np.append(common[60 * (i % 4) : 60 * (i % 4) + 360], rng.integers(-(2**62), 2**62, rng.integers(0, 220)))) for i in range(300)]
    block = rng.integers(0, blocks, len(sets))
    ids = np.arange(len(sets))
    table = pa.table({"id": ids, "label": ids, "block": block.astype(np.int32), "set": pa.array([s.tobytes() for s in sets], pa.binary())})
    tracemalloc.start()
    got = bottomk._block_forest(75)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * table.nbytes  # 10 times its rows before

    def joined(links):
        label = list(range(len(sets)))
        for a, b in links:
            old, new = sorted((label[a], label[b]))[::-1]
            label = [new if x == old else x for x in label]
        return label

    bags = [set(s.tolist()) for s in sets]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2)
             if (blocks == 1 or block[a] != block[b]) and 100 * len(bags[a] & bags[b]) >= 75 * len(bags[a] | bags[b])]
    found = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
    assert links and set(found) <= set(links) and joined(found) == joined(links)


def test_staged_batches_are_bounded(make, spark):
    before = spark.conf.get(BATCH)
    docs = make([(i, "w " * 2000) for i in range(400)]).coalesce(1)

    def sizes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rows.nbytes])], ["n"])

    sent = docs.select("text").mapInArrow(sizes, "n bigint")
    whole, bounded = ([r["n"] for r in stage(sent, "sizes", most).collect()] for most in (None, 1 << 17))
    assert max(whole) > 1 << 20 and max(bounded) < 1 << 18 and sum(bounded) >= 400 * 4000
    assert spark.conf.get(BATCH) == before


def spans_of(docs, **options):
    out: dict[int, set[int]] = {}
    for r in cw.repeated_passages(docs, **options).collect():
        assert r["kept_doc_id"] < r["doc_id"]
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_every_exact_passage_is_found_and_clean_text_is_not(make):
    rng = random.Random(13)
    passages = [prose(rng, n, 10**6) for n in (50, 51, 64, 120, 300)]
    pairs = [(i, prose(rng, rng.randint(10, 300), 10**6)) for i in range(80)]
    for i in range(80):
        p = passages[i % 5]
        pairs.append((100 + i, prose(rng, rng.randint(0, 200), 10**6) + " " + p + " " + prose(rng, rng.randint(0, 200), 10**6)))
    pairs += [(200, pairs[0][1] + " " + prose(rng, 60, 10**6)), (201, pairs[-1][1].upper())]
    got, first, cover = spans_of(make(pairs)), {}, {}
    for i, t in sorted(pairs):
        w = words_of(t)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                cover.setdefault(i, set()).update(range(j, j + 50))
    for i, places in cover.items():
        assert places <= got.get(i, set()), i
    assert set(got) <= set(cover)


def test_an_earlier_partial_quote_hides_no_exact_repeat(make):
    rng = random.Random(19)
    pairs, want = [], []
    for i, part in enumerate([20, 30, 38, 40, 41, 42, 43, 44, 45, 46, 48, 49] * 8):
        p = prose(rng, 50, 10**6).split()
        quote = p[:part] if i % 2 else p[50 - part :]
        for j, held in enumerate((quote, p, p)):
            pairs.append((3 * i + j, " ".join([prose(rng, 40, 10**6), *held, prose(rng, 40, 10**6)])))
        want.append(3 * i + 2)
    got = spans_of(make(pairs))
    missed = [i for i in want if len(got.get(i, ())) < 46]
    assert not missed


def _after_quotes(rng, quotes, part, cases):
    """Passages held by two documents, with one word changed in the later one, after others that quote their first ``part`` words."""
    pairs, want = [], set()
    for _ in range(cases):
        p = prose(rng, 54, 10**6).split()
        q = [*p]
        q[part + 2 if part < 40 else 30] = "new" + str(rng.random())
        pairs += [(len(pairs) + k, " ".join([prose(rng, 40, 10**6), *held, prose(rng, 40, 10**6)])) for k, held in enumerate([p[:part]] * quotes + [p, q])]
        want.add((len(pairs) - 1, len(pairs) - 2))
    return pairs, want


@pytest.mark.parametrize("quotes,part", [(1, 38), (1, 43), (20, 36)])
def test_every_holder_of_a_window_meets_every_other(make, quotes, part):
    pairs, want = _after_quotes(random.Random(31), quotes, part, 24 if quotes > 1 else 40)
    found = {(r["doc_id"], r["kept_doc_id"]) for r in cw.repeated_passages(make(pairs), block=8).collect()}
    assert want <= found


def test_crowded_windows_lose_no_similar_pair():
    rng, t = np.random.default_rng(32), 12
    quote, near, rank = rng.integers(1, 2**32, 8, np.uint32), [], []
    for i in range(150):
        x = rng.integers(1, 2**32, 2 * t - 1, np.uint32)
        x[t - 1 : t + 7] = quote
        near.append(x)
        if i % 3 == 0:  # a changed copy of another one
            y = x.copy()
            y[rng.integers(0, 2 * t - 1, 2)] = rng.integers(1, 2**32, 2, np.uint32)
            near.append(y)
    near, rank = np.array(near), rng.permutation(len(near))
    windows = [(x, x + t) for x in range(t)]
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    sets = [[set(r[x:y].tolist()) for x, y in windows] for r in near]
    want = {(i, j) for i in range(len(near)) for j in range(len(near)) if rank[j] < rank[i] and any(similar(a, b) for a in sets[i] for b in sets[j])}
    got = set()
    side = rng.integers(0, 2, len(near))
    for x, y in ((0, 0), (0, 1), (1, 1)):
        rows = np.flatnonzero((side == x) | (side == y))
        got |= {(rows[i], rows[j]) for i, j in zip(*cw.crowded_pairs(near[rows], rank[rows], side[rows], t, 75))}
    assert len(want) >= 40 and want <= got and len(got) < 3 * len(want)
    # Equal neighbourhoods are a class: each meets its first row and no other.
    same = np.tile(near[0], (500, 1))
    later, earlier = cw.crowded_pairs(same, np.arange(500), np.zeros(500, int), t, 75)
    assert len(later) == 499 and set(earlier.tolist()) == {0}


def _clusters(stretch, kept, diagonal, t, *spans):
    """Per pair of stretches and run of diagonals no more than ``t`` apart: its first and last diagonal and the places it spans."""
    out = []
    for a, b, d, *x in sorted(zip(*[list(map(int, c)) for c in (stretch, kept, diagonal, *spans)])):
        if out and out[-1][:2] == [a, b] and d - out[-1][3] <= t:
            out[-1][3:] = [d, *[(min, max)[k % 2](y, z) for k, (y, z) in enumerate(zip(out[-1][4:], x))]]
        else:
            out.append([a, b, d, d, *x])
    return out


def test_chains_of_window_pairs_keep_their_ends():
    rng, t = np.random.default_rng(33), 12
    a, b, d = *rng.integers(0, 6, (2, 20000)), rng.choice([-400, 0, 900], 20000) + rng.integers(-60, 60, 20000)
    order, chain, stays = cw.chained(a, b, d, t)
    assert _clusters(a, b, d, t) == _clusters(a[order][stays], b[order][stays], d[order][stays], t) and stays.sum() < 3000
    assert len(set(chain.tolist())) == len(_clusters(a, b, d, t))


def test_repeated_lines_take_few_rows():
    rng, t, width = np.random.default_rng(34), 16, 5
    line, texts, windows = rng.integers(1, 2**32, 24, np.uint32), [], []
    for _ in range(3):
        # A line that comes 40 times, another word after it each time.
        text = np.concatenate([np.append(line, rng.integers(1, 2**32, 1, np.uint32)) for _ in range(40)])
        texts.append(text.tobytes())
        windows.append([{"key": 5, "c": 100 + 25 * k + 9} for k in range(40)])
    asked = pa.table({"doc_id": [1, 2, 3], "stretch": [7, 8, 9], "start": [100] * 3, "words": pa.array(texts, pa.binary()), "windows": windows})
    got = pa.Table.from_batches(cw._neighbourhoods(t, width)(iter(asked.to_batches())))
    assert sum(map(len, got.column("places").to_pylist())) == 120 and got.num_rows == 3 and got.nbytes < 120 * 4 * (2 * t - 1)
    rows = got.append_column("block", pa.array(np.zeros(got.num_rows, np.int32)))
    out = cw._crowded(t, 6, 75)(rows)
    # All pairs, one row each, as the verifier got them before.
    near, at = [], []
    for text, stretch in zip(texts, (7, 8, 9)):
        tokens = cw.shingle_hashes(np.frombuffer(text, np.uint32).astype(np.uint64), width).astype(np.uint32)
        for k in range(40):
            c = 25 * k + 9
            near.append([int(tokens[x]) if 0 <= x < len(tokens) else 0 for x in range(c - t + 1, c + t)])
            at.append((stretch, 100 + max(0, c - t + 1), 100 + c, 100 + min(len(tokens), c + t) - 1))
    at = np.array(at)
    later, earlier = cw.crowded_pairs(np.array(near, np.uint32), at[:, 0], np.zeros(len(at), int), t, 75)
    want = _clusters(at[later, 0], at[earlier, 0], at[later, 2] - at[earlier, 2], t, *[x for k in (later, earlier) for x in (at[k, 1], at[k, 3])])
    kept = {x: out.column(x).to_numpy() for x in out.column_names}
    found = _clusters(kept["stretch"], kept["kept_stretch"], kept["c"] - kept["kc"], t, *[kept[x] for x in ("l", "r", "kl", "kr")])
    assert want and found == want and out.num_rows <= len(later)


def test_edits_at_the_edges_and_in_blocks_are_found(make):
    rng = random.Random(20)
    pairs, want = [], []
    shapes = [(54, [4]), (54, [49]), (50, [0]), (50, [49]), (95, range(44, 51)), (120, range(50, 62)), (60, [1, 58])]
    for i, (n, changed) in enumerate(shapes * 12):
        p = prose(rng, n, 10**6).split()
        q = ["new" + str(rng.random()) if k in changed else w for k, w in enumerate(p)]
        a, b = shingles(" ".join(p)), shingles(" ".join(q))
        assert 4 * len(a & b) >= 3 * len(a | b)
        pairs += [(2 * i + k, " ".join([prose(rng, 60, 10**6), *held, prose(rng, 60, 10**6)])) for k, held in enumerate((p, q))]
        want.append(2 * i + 1)
    got = spans_of(make(pairs))
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_passages_against_all_pairs_of_ranges():
    rng = np.random.default_rng(21)
    t, exists, found = 12, 0, 0

    def near(x, y):
        x, y = set(x.tolist()), set(y.tolist())
        return 4 * len(x & y) >= 3 * len(x | y)

    for _ in range(120):
        a = rng.integers(0, 2**62, rng.integers(5, 36)).astype(np.uint64)
        b = a.copy()
        changed = rng.random(len(b)) < rng.choice([0.0, 0.05, 0.1, 0.2])
        b[changed] = rng.integers(2**62, 2**63, changed.sum()).astype(np.uint64)
        at = int(rng.integers(0, len(b) + 1))
        b = np.concatenate([b[:at], rng.integers(2**62, 2**63, rng.integers(0, 6)).astype(np.uint64), b[at:]])
        got = cw.passages(a, b, t, 75)
        for x, y, u, v, score in got:
            assert y - x >= t and v - u >= t and near(a[x:y], b[u:v]) and score >= 0.75
        spans = [(i, j) for i in range(len(a)) for j in range(i + t, len(a) + 1)]
        others = [(i, j) for i in range(len(b)) for j in range(i + t, len(b) + 1)]
        if any(near(a[i:j], b[u:v]) for i, j in spans for u, v in others if 3 * (j - i) <= 4 * (v - u) and 3 * (v - u) <= 4 * (j - i)):
            exists, found = exists + 1, found + bool(got)
    assert exists > 60 and found >= 0.95 * exists


def test_near_passages_and_short_repeats(make):
    rng = random.Random(14)
    p, short = prose(rng, 200, 10**6), prose(rng, 40, 10**6)
    near = edited(rng, p, 4)
    docs = make([(1, prose(rng, 90, 10**6) + " " + p), (2, near + " " + prose(rng, 90, 10**6)), (3, short + " " + prose(rng, 90, 10**6)), (4, prose(rng, 90, 10**6) + " " + short)])
    got = spans_of(docs)
    assert set(got) == {2} and len(got[2]) > 150


def test_cutting_removes_the_later_occurrence(make, edge):
    rng = random.Random(15)
    p = prose(rng, 100, 10**6).replace("\n", " ")
    docs = make([(1, p), (2, "ahead of it " + p + " behind it"), (3, p)])
    out = {r["doc_id"]: r for r in cw.cut_repeats(docs, cw.repeated_passages(docs)).collect()}
    assert set(out) == {1, 2} and out[1]["text"] == p and words_of(out[2]["text"]) == "ahead of it behind it".split()
    assert out[2]["n_chars"] == len(out[2]["text"])
    spans = cw.repeated_passages(edge)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in spans.collect()} == {(8, 7)}
    kept = cw.cut_repeats(edge, spans)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1
    assert cw.repeated_passages(edge.limit(0)).count() == 0


def test_window_minima_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(16)
    for n in (10, 46, 47, 200, 555):
        tokens, t = rng.integers(0, 2**63, n).astype(np.uint64), 46
        odd = cw.multipliers(3)
        f, c = cw.window_minima(tokens, t, 3)
        for k in range(3):
            value, want, todo = tokens * odd[k], {}, [(0, n - 1)]
            while todo:
                low, high = todo.pop()
                if high - low + 1 >= t:
                    m = low + int(value[low : high + 1].argmin())
                    want[m] = (low, high)
                    todo += [(low, m - 1), (m + 1, high)]
            assert sorted(want) == c[f == k].tolist()
            left, right = cw.cartesian_spans(tokens, f[f == k], c[f == k], t, odd)
            for m, l, r in zip(c[f == k], left, right):
                assert (l, r) == (max(want[m][0], m - t), min(want[m][1], m + t))


def test_masks_hit_every_window_with_four_substitutions():
    for wrong in combinations(range(dc.WINDOW), 4):
        assert any(all(at + p not in wrong for p in mask) for mask in dc.MASKS for at in range(dc.WINDOW - mask[-1])), wrong


def test_contamination_equals_brute_force(make, spark, edge):
    rng = random.Random(17)
    items = [(i, prose(rng, rng.randint(16, 60), 5000)) for i in range(20)]
    pairs = [(i, prose(rng, rng.randint(0, 200), 5000)) for i in range(60)]
    for i in range(60):
        leak = edited(rng, items[i % 20][1].upper() if i % 7 == 0 else items[i % 20][1], rng.randint(0, 8))
        pairs.append((100 + i, prose(rng, rng.randint(0, 90), 5000) + " " + leak + " " + prose(rng, rng.randint(0, 90), 5000)))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (None, items[0][1])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated_spans(make(pairs), bench).collect()}
    want = set()
    for (d, text), (i, item) in product(pairs, items):
        a, b = words_of(text), words_of(item)
        for shift in range(16 - len(b), len(a) - 15):
            same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            if any(sum(same[s : s + 16]) >= 12 for s in range(low, high - 15)):
                want |= {(d, i)} | ({(d, None)} if i == 0 else set())
    assert got == want
    assert dc.contaminated_spans(edge, bench).count() == 0
    assert dc.contaminated_spans(edge.limit(0), bench).count() == 0 == dc.contaminated_spans(make(pairs), bench.limit(0)).count()
    clean = dc.drop_contaminated(make(pairs).unionByName(edge), bench)
    assert clean.columns == edge.columns and clean.count() == len(pairs) + edge.count() - len({d for d, _ in want})


def test_helper_names_do_not_clash(make, spark):
    docs = make([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words that stand alone here"), (3, "another text of the same id"), (None, "x")])
    clashing = docs.selectExpr("*", "1 AS _gone", "2 AS _many", "3 AS _row", "4 AS _leak", "'x' AS Text2")
    kept = bottomk.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted((r["doc_id"] or 0, r["_gone"], r["_many"]) for r in kept.collect()) == [(0, 1, 2), (1, 1, 2), (3, 1, 2)]
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(30)))], "item_id bigint, text string")
    leaking = make([(1, " ".join(f"w{i}" for i in range(30))), (2, "clean text")]).selectExpr("*", "4 AS _leak")
    left = dc.drop_contaminated(leaking, items)
    assert [(r["doc_id"], r["_leak"]) for r in left.collect()] == [(2, 4)]
