from __future__ import annotations

import random
import types
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hst
from tokenizers import Tokenizer

from stratacode.llm import min_slack, packing, tokens
from stratacode.llm.tokens import WordEncoder

from llm_corpora import prose

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, words=50)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(hst.text(hst.one_of(hst.sampled_from("aBcÉéß. ,!'’\n\t ́JǰΣσİı0ǆ<|endoftext|>"), hst.characters(codec="utf-8")), max_size=60))
def test_word_encoder_equals_the_tokenizer(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("sizes", [[1], [4096], [5000, 3], [300] * 50, list(range(1, 900, 7)), [20000, 1, 1, 1]])
def test_windows_are_full_and_cover_every_token(sizes):
    pool = packing.Pool((i, 0, n) for i, n in enumerate(sizes))
    windows = [*packing.pack(pool), *packing.pack_tail(pool, 4096)]
    cover = defaultdict(list)
    for tier, pieces in windows:
        assert tier & (tier - 1) == 0 and sum(n for _, _, n in pieces) == tier
        for doc, start, n in pieces:
            cover[doc].append((start, n))
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(cover[doc]):
            assert start == at
            at += length
        assert at == n


def test_round_trip(make, edge):
    rng = random.Random(5)
    docs = make([(100 + i, prose(rng, rng.randint(1, 900))) for i in range(60)]).unionByName(edge.where("doc_id <> 9 or doc_id is null"))
    out = packing.pack_documents(docs, PATH, buffer_tokens=5000).toPandas()
    for (sequence, _), part in out.groupby(["sequence_id", "tier"]):
        part = part.sort_values("offset")
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all() and part["length"].sum() == part["tier"].iloc[0]
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"]].append(np.array([*plain(r["text"]), packing.END_ID], "<u4").tobytes())
    for doc, texts in want.items():
        part = out[out["doc_id"].isna()] if doc is None else out[out["doc_id"] == doc]
        assert sum(map(len, texts)) == part["length"].sum() * 4
        if len(texts) == 1:
            assert b"".join(bytes(x) for x in part.sort_values("start")["ids"]) == texts[0]
    groups = out.drop_duplicates("sequence_id").groupby(["tier", "step_group"])["tier"].sum()
    assert groups.max() <= packing.GROUP_TOKENS
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_steps_of_a_tier_are_balanced(make):
    docs = make([(i, "word " * 255) for i in range(300)])
    out = packing.pack_documents(docs, PATH, group_tokens=2048).toPandas().drop_duplicates("sequence_id")
    full = out[out["tier"] == 256].groupby("step_group")["tier"].sum().sort_index()
    assert (full.iloc[:-1] == 2048).all()


def test_tiers_are_checked(make):
    with pytest.raises(ValueError):
        packing.pack_documents(make([(1, "a")]), PATH, tiers=(100, 200))


@pytest.mark.parametrize("packer", [
    lambda: packing._packer(PATH, packing.TIERS, 2, 1 << 20),
    lambda: min_slack._packer(PATH, 2048, 0, 1 << 20, 1 << 16, 32, pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "doc_tokens", "sequence_id", "offset", "rest_of")] + [("ids", pa.binary())])),
])
def test_a_worker_holds_no_words_after_its_task(monkeypatch, packer):
    task = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(packing, "TaskContext", task)
    monkeypatch.setattr(min_slack, "TaskContext", task)
    texts = [f"word{i} and w{i * i} more" for i in range(300)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    out = pa.Table.from_batches(list(packer()(iter([rows]))))
    assert sum(out.column("length").to_pylist()) == sum(len(ENCODER(t)) // 4 + 1 for t in texts)
    known = tokens.encoder(PATH)
    assert not any(m.fresh or m.old for m in (known.words, known.parts))
    assert list(known.batch(pa.array(texts[:2]))) == [ENCODER(t) for t in texts[:2]]
