from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hst
from llm_corpora import LOWER, prose
from tokenizers import Tokenizer

from stratacode.llm import alignment, divergence, min_slack

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

# --- source divergence audit ---------------------------------------------------------------------


def audited(rows, min_docs, top):
    """The whole result in plain Python; rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t, _, _ in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for (_, own, source), found in zip(rows, terms):
            if own == lang:
                docs.update(set(found))
                counts[source].update(found)
        kept = sorted(t for t, n in docs.items() if n >= min_docs)

        def rates(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        whole = rates(sum(counts.values(), Counter()))
        p = {s: rates(c) for s, c in counts.items()}
        for s in counts:
            ranked = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s],
                      "term": [(t, f(p[s][t], whole[t])) for t in kept if counts[s][t] and p[s][t] > whole[t]]}
            for part, items in ranked.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def divergence_docs(spark, rows):
    data = [(i, t, lang, s, "x", 1, 2) for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, term string, n int, `p` int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_audit_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [(prose(rng, rng.randint(0, 60), 60) + rng.choice(["", " Éa É b", " x1y", " ÄÄ"]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ç", "d", None]))
            for _ in range(300)]
    rows += rows[:40] + [(None, "en", "empty"), ("", "en", "blank"), (None, None, None), ("123 ...", "xx", "only"), ("word", "yy", "rare")]
    got = divergence.audit(divergence_docs(spark, rows), min_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, 3, 4)


def test_audit_ties_and_small_batches(spark, monkeypatch):
    # Ten terms of equal counts in each source: ranks follow the UTF-8 order of the terms.
    names = ["zeta", "é", "alpha", "\U0001f600", "￮", "beta", "gamma", "Ä", "delta", "eta", "theta", "iota"]
    rows = [(" ".join(names), "en", "a")] * 4 + [("other words here", "en", "b")] * 4
    got = divergence.audit(divergence_docs(spark, rows), min_docs=2)
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, 2, 10)


def test_audit_of_nothing(spark):
    assert divergence.audit(divergence_docs(spark, []).limit(0)).count() == 0
    got = divergence.audit(divergence_docs(spark, [("a", "en", "x"), ("b", "en", "y")]))  # no term in ten documents
    assert sorted(tuple(r) for r in got.collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_audit_sends_counts_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["e"] * 4), pa.array(["s"] * 4), pa.array(["a b", "a c d", "a a", ""])], ["lang", "source", "text"])
    out = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for r in out:
        n[r["term"]] += r["n"]
        docs[r["term"]] += r["docs"]
    assert n == {None: 0, "a": 4, "b": 1, "c": 1, "d": 1} and docs == {None: 0, "a": 3, "b": 1, "c": 1, "d": 1}
    assert sum(r["term"] is None for r in out) >= 2


# --- minimum bin slack --------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(hst.lists(hst.integers(1, 40), max_size=9), hst.integers(0, 90))
def test_fullest_combination(lengths, room):
    counts = Counter(lengths)
    got = min_slack.fullest(sorted(counts), counts, room)
    assert not Counter(got) - counts
    assert sum(got) == max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)


def pack_plain(lengths, room):
    """First-fit decreasing."""
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, used in enumerate(bins) if used + n <= room), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_no_more_sequences_than_first_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([100, 700, 1000])) for _ in range(500)]
    pool = min_slack.Pool(1000)
    for i, n in enumerate(lengths):
        pool.add(n, (i, 0, 0, n, b""))
    bins = list(pool.sequences())
    assert sorted(n for b in bins for n, _ in b) == sorted(lengths) and max(sum(n for n, _ in b) for b in bins) <= 1000
    assert -(-sum(lengths) // 1000) <= len(bins) <= pack_plain(lengths, 1000)


def test_packed_pieces_hold_every_token(make, edge):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(8)
    docs = make([(100 + i, prose(rng, rng.randint(1, 400))) for i in range(150)]).unionByName(edge.where("doc_id <> 9 or doc_id is null")).repartition(5)
    out = min_slack.pack_documents(docs, WORD_BPE, room=512, buffer_tokens=4000, rest_tokens=1500, merge_tasks=2).toPandas()
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all() and part["length"].sum() <= 512
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"]].append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, min_slack.END_ID], "<u4").tobytes())
    for doc, texts in want.items():
        part = out[out["doc_id"].isna()] if doc is None else out[out["doc_id"] == doc]
        assert sum(map(len, texts)) == 4 * part["length"].sum()
        assert (part["start"] == 512 * part["piece"]).all()
        if len(texts) == 1:
            part = part.sort_values("piece")
            assert b"".join(bytes(x) for x in part["ids"]) == texts[0] and (part["length"].iloc[:-1] == 512).all()
            assert (part["doc_tokens"] == len(texts[0]) // 4).all()
    assert out["sequence_id"].nunique() <= 1.05 * out["length"].sum() / 512 + 1
    assert min_slack.pack_documents(docs.limit(0), WORD_BPE).count() == 0


# --- alignment ------------------------------------------------------------------------------------

ALIGNER = alignment.Aligner(BYTE_BPE, PIECES, units=2000)
ODD = ["a", "b", " ", "  ", "\n", "é", "ß", "　", " ", "▁", ".", "'s", "The", "ing", "中文", "\x00", "\t", "1", "\U0001f600", "\x1c", " ",
       "<|endoftext|>", "<s>", "<0x41>"]


def aligned(text):
    """(token ids of A, of B, groups, links) by comparing every pair of byte ranges; None where a tokenizer loses bytes."""
    a, b = ALIGNER.a.encode(" " + text, add_special_tokens=False).ids, ALIGNER.b.encode(text)
    whole = (" " + text).encode()
    spelled = [[ALIGNER.bytes_a[i] for i in a], [ALIGNER.bytes_b[i] for i in b]]
    if not text or b"".join(spelled[0]) != whole or b"".join(spelled[1]) != whole:
        return None
    spans = [[(sum(map(len, s[:i])), sum(map(len, s[: i + 1]))) for i in range(len(s))] for s in spelled]
    links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if max(s, u) < min(e, v)]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    named = lambda ids, at, s, e: ",".join(str(i) for i, (u, v) in zip(ids, at) if s <= u and v <= e)
    groups = [f"{named(a, spans[0], s, e)}|{named(b, spans[1], s, e)}" for s, e in zip([0, *ends], ends)]
    return a, b, groups, links


def facts(x):
    return (x.n_a, x.n_b, x.n_groups, x.n_links, x.groups, sorted(x.pairs.tolist())) if x.exact else None


def wanted(text):
    found = aligned(text)
    if found is None:
        return None
    a, b, groups, links = found
    return len(a), len(b), len(groups), len(links), ";".join(groups), sorted(x * alignment.PAIR + y for x, y in links)


@settings(max_examples=400, deadline=None)
@given(hst.lists(hst.sampled_from(ODD), min_size=1, max_size=30), hst.randoms(use_true_random=False))
def test_any_ranges_in_any_bracketing_close_alike(parts, rng):
    ALIGNER.make_room()
    text = "".join(parts)
    raw = (" " + text).encode()
    cuts = sorted(rng.sample(range(len(raw) + 1), rng.randint(0, min(6, len(raw)))))
    fragments = [alignment.lift(raw[i:j], ALIGNER) for i, j in zip([0, *cuts], [*cuts, len(raw)])]
    while len(fragments) > 1:
        i = rng.randrange(len(fragments) - 1)
        fragments[i : i + 2] = [alignment.join(fragments[i], fragments[i + 1], ALIGNER)]
    assert facts(alignment.close(fragments[0], ALIGNER)) == wanted(text)


def test_tokenizer_of_a_task_has_one_thread(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    alignment.aligner(BYTE_BPE, PIECES)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_identity_of_the_monoid():
    x, none = alignment.lift(b" some words that go on and on", ALIGNER), alignment.Fragment()
    for y in (alignment.join(x, none, ALIGNER), alignment.join(none, x, ALIGNER)):
        assert facts(alignment.close(y, ALIGNER)) == facts(alignment.close(x, ALIGNER))


@pytest.mark.parametrize("chunk_bytes", [8, 200, 1 << 16])
@pytest.mark.parametrize("heavy_bits", [3, 20])
def test_alignment_equals_plain_python(make, chunk_bytes, heavy_bits):
    rng = random.Random(4)
    pairs = [(i, prose(rng, rng.randint(1, 90), 300)) for i in range(40)] + [(100 + i, "".join(rng.choice(ODD) for _ in range(rng.randint(1, 50)))) for i in range(60)]
    pairs += [(200, None), (201, ""), (202, " "), (203, "▁ lost"), (204, "one"), (204, "one"), (None, "no id"), (205, "x" * 900), (206, "a " * 400), (207, "中" * 300)]
    docs = make(pairs)
    got = alignment.align(docs, BYTE_BPE, PIECES, chunk_bytes=chunk_bytes, heavy_bits=heavy_bits)
    found = [(i, aligned(t) if t else None) for i, t in pairs]
    count = Counter(link for _, x in found if x for link in x[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for i, x in found:
        if x is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        want.append((i, len(a), len(b), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.documents.collect()), key=repr) == sorted(want, key=repr)
    if chunk_bytes == 200 and heavy_bits == 20:
        assert {(r["a"], r["b"]): r["links"] for r in got.pairs.collect()} == count
        texts = defaultdict(list)
        for r in sorted(got.groups.collect(), key=lambda r: r["place"]):
            texts[r["doc_id"]].append(r["groups"])
        for i, x in found:
            if x and i != 204:
                assert ";".join(texts[i]) == ";".join(x[2])


def test_alignment_of_edge_rows(edge):
    out = alignment.align(edge, BYTE_BPE, PIECES).documents.toPandas()
    assert len(out) == edge.count() and out["n_a"].notna().all()
    assert out.loc[out["doc_id"].isin([7, 8]), "groups_sha256"].nunique() == 1
    assert alignment.align(edge.limit(0), BYTE_BPE, PIECES).documents.count() == 0
