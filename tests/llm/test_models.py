from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_corpora import prose, words_of
from pyspark.sql import functions as F

from stratacode.llm import interpolation as ip
from stratacode.llm import linear, pu_quality, toxicity

SF = "/root/testdata/sf0.01"
BAD = ("vile", "awful", "nasty", "foul")


def test_logistic_fit_separates():
    rng = np.random.default_rng(1)
    row, column = np.nonzero(rng.random((400, 30)) < 0.3)
    y = np.isin(np.arange(400), row[column == 3]).astype(float)
    x = linear.SparseRows(row, column, 400, 30, np.ones((400, 1)))
    w = linear.fit_logistic(x, y)
    assert ((linear.sigmoid(x.score(w)) > 0.5) == (y == 1)).mean() > 0.99
    assert not linear.fit_logistic(linear.SparseRows(row[:0], column[:0], 0, 30, np.ones((0, 1))), y[:0]).any()


@pytest.fixture
def abusive(make, spark):
    rng = random.Random(21)
    pairs, marks = [], []
    for i in range(600):
        w = prose(rng, rng.randint(30, 120)).split(" ")
        kind = i % 5
        for _ in range(4 if kind < 2 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD[:2] if kind == 0 else BAD[2:]) + rng.choice(["", ",", "."]))
        pairs.append((i, " ".join(w)))
        marks.append((i, int(kind == 0), int(kind < 2)))
    return make(pairs), spark.createDataFrame(marks, "doc_id bigint, rude int, toxic int")


def test_chain_on_rows_it_has_not_seen(abusive):
    docs, labels = abusive
    chain = toxicity.train(docs, labels.where("doc_id < 400"), {"rude": F.col("rude"), "toxic": F.col("toxic")})
    out = toxicity.score(docs.where("doc_id >= 400"), chain).join(labels, "doc_id").toPandas()
    assert list(out.columns)[:2] == ["doc_id", "text"]
    for name in ("rude", "toxic"):
        assert ((out[f"p_{name}"] > 0.5) == (out[name] == 1)).mean() > 0.97
    # The second model gives the first one's answer a weight.
    assert chain.weights[1][len(chain.features)] != 0 and len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_chain_of_odd_rows(abusive, edge, spark):
    docs, labels = abusive
    extra = spark.createDataFrame([(None, 1, 1), (4, 1, None), (4, 0, 1), (4, 0, 0)], "doc_id bigint, rude int, toxic int")
    chain = toxicity.train(docs.unionByName(edge), labels.unionByName(extra), {"rude": F.col("rude"), "toxic": F.col("toxic")}, max_rows=200)
    out = toxicity.score(edge.withColumn("p_rude", F.lit("old")), chain)
    assert out.count() == edge.count() and out.where("p_toxic is null or p_rude is null").count() == 0
    assert toxicity.score(edge.limit(0), chain).count() == 0
    none = toxicity.train(docs, labels.limit(0), {"toxic": F.col("toxic")})
    assert {r["p_toxic"] for r in toxicity.score(edge, none).collect()} == {0.5}


def test_quality_on_held_out_labels(spark):
    from stratacode.llm.queries import C

    out = C.queries["op6_pu_quality"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    bad = rows[rows["quality"] == 0]
    assert len(bad) > 5 and (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_of_odd_rows(edge):
    measured = pu_quality.measure(edge, ["doc_id", "shard"])
    assert measured.columns == ["doc_id", "shard", "x"] and measured.count() == edge.count()
    model = pu_quality.fit(measured, F.lit(False), 0.7)  # nothing trusted: no opinion
    assert {r[0] for r in measured.select(pu_quality.score_column(model)).collect()} == {0.5}
    model = pu_quality.fit(measured, F.coalesce(F.col("doc_id") > 8, F.lit(False)), 0.5, steps=5)
    assert measured.select(pu_quality.score_column(model).alias("s")).where("s between 0 and 1").count() == edge.count()
    assert pu_quality.measure(edge.limit(0), ["doc_id"]).count() == 0
    assert pu_quality.estimated_prior(edge.select(F.lit(None).alias("quality"))) == 0.5


def test_risk_is_not_negative_when_positives_are_all(spark, make):
    rng = random.Random(22)
    measured = pu_quality.measure(make([(i, prose(rng, 80) if i % 2 else "*** " * 80) for i in range(120)]), ["doc_id"]).persist()
    model = pu_quality.fit(measured, (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 60), 0.5)
    out = measured.select("doc_id", pu_quality.score_column(model).alias("s")).toPandas()
    assert (out[out["doc_id"] % 2 == 1]["s"].min()) > out[out["doc_id"] % 2 == 0]["s"].max()


def bins(x):
    return ip._NONE if x <= 0 else math.floor(2 * math.log2(x) + 0.5)


def plain_model(rows):
    """(doc, text, held) -> base and model log-probabilities, by the definition over plain counters."""
    docs = [(words_of(t) + ["\n"], held) for _, t, held in rows]
    one, two, starts = Counter(), Counter(), 0
    for w, held in docs:
        if not held:
            one.update(w)
            two.update(zip(["^", *w[:-1]], w))
            starts += 1
    n, v = sum(one.values()), len(one)
    context = lambda u: starts if u == "^" else one[u]
    seen: dict = Counter()
    for (u, w), c in two.items():
        p1, p2 = (one[w] - 1) / max(1, n - 1), (c - 1) / max(1, context(u) - 1)
        seen[context(u).bit_length(), bins(p1), bins(p2 / p1) if c > 1 else ip._NONE] += c
    weights = ip.learn_weights(dict(seen), uniform=1 / (v + 1))
    out = []
    for w, held in docs:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip(["^", *w[:-1]], w):
            a = weights[context(u).bit_length()]
            score += math.log10(a[0] * two[u, x] / max(1, context(u)) + a[1] * one[x] / max(1, n) + a[2] / (v + 1))
        out.append((len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("heavy_bits,chunk_bytes,broadcast_bytes", [(18, 2000, 1 << 20), (4, 10**6, 1 << 20), (6, 2000, 0)])
def test_scores_equal_the_definition(make, edge, heavy_bits, chunk_bytes, broadcast_bytes):
    rng = random.Random(23)
    docs = make([(100 + i, prose(rng, rng.randint(0, 80), 60)) for i in range(40)]).unionByName(edge.where("length(text) < 5000 or text is null"))
    rows = [(r["doc_id"], r["text"], (r["doc_id"] or 0) % 4 == 1) for r in docs.collect()]
    got = ip.score(docs, F.col("doc_id") % 4 == 1, heavy_bits=heavy_bits, chunk_bytes=chunk_bytes, broadcast_bytes=broadcast_bytes, bitmap_bits=20)
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 6))
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect()), key=key)
    want = sorted(((i, *x) for (i, _, _), x in zip(rows, plain_model(rows))), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], abs=1e-8)


def test_scores_of_nothing(edge):
    assert ip.score(edge.limit(0), F.lit(False)).count() == 0
    alone = ip.score(edge.where("doc_id = 5"), F.lit(True)).first()
    assert alone["n_known"] == 0 and alone["train_tokens"] == 0 and math.isfinite(alone["score"])


def test_word_table_holds_what_is_counted():
    rng = np.random.default_rng(24)
    words = np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    for top in (9, 2**40):
        counts = np.where(rng.random(len(words)) < 0.6, 1, rng.integers(0, top, len(words)))
        table = ip._by_hash(words.view(np.int64), counts)
        assert (ip._looked_up(table, words) == counts).all() and not ip._looked_up(table, words + np.uint64(1))[~np.isin(words + np.uint64(1), words)].any()
        if top == 9:
            assert sum(map(len, table)) < 0.7 * 16 * len(words)
    assert not ip._looked_up(ip._by_hash(words[:0].view(np.int64), counts[:0]), words).any()


def test_weights_are_shares_and_prefer_what_predicts():
    w = ip.learn_weights({(3, -10, 12): 90.0, (3, -10, ip._NONE): 10.0, (4, -10, ip._NONE): 50.0})
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.5 and w[4, 0] < 0.01


def test_chunks_close_soon_after_they_are_full(monkeypatch):
    monkeypatch.setattr(ip, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * 100] * 3000), pa.array([False] * 3000)], ["id", "text", "held"])
    sizes = []

    def seen(table):
        sizes.append(table.num_rows)
        return table

    out = pa.Table.from_batches(list(ip._gathered(seen, 20_000)(iter([rows]))))
    assert out.column("id").to_pylist() == list(range(3000)) and max(sizes) <= 200 + ip.PART_ROWS  # 1000 before


def test_chunks_close_on_rows_without_bytes(make, monkeypatch):
    monkeypatch.setattr(ip, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Of", (), {"partitionId": staticmethod(lambda: 3)}))}))
    texts = [None] * 2500 + [""] * 2500 + ["a b"] * 7
    rows = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    out = pa.Table.from_batches(ip._gathered(lambda table: table, 1 << 20, 1024)([rows])).to_pydict()
    sizes = Counter(out["chunk"])
    assert out["id"] == list(range(len(texts))) and max(sizes.values()) <= 1024 and len(sizes) == 5
    assert ip.PLACE_BITS + 12 + 20 <= 63 and ip.CHUNK_ROWS < 1 << ip.PLACE_BITS
    monkeypatch.undo()
    docs = make([(i, None if i % 3 else "a b c") for i in range(60)])
    column = lambda **o: sorted((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in ip.score(docs, F.lit(False), bitmap_bits=20, **o).collect())
    assert column() == column(chunk_rows=7) == column(chunk_rows=7, broadcast_bytes=0)


def test_one_repeated_id_does_not_grow_the_sample(make, spark):
    rng = random.Random(2)
    docs = make([(1, prose(rng, 20)) for _ in range(300)] + [(i, prose(rng, 20)) for i in range(2, 20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id bigint, toxic int")
    chain = toxicity.train(docs, labels, {"toxic": F.col("toxic")}, max_rows=10)
    out = toxicity.score(docs.withColumnRenamed("kept", "P_TOXIC"), chain)
    assert out.where("p_toxic between 0 and 1").count() == 318 and [c.lower() for c in out.columns].count("p_toxic") == 1


def test_bigram_counts_share_columns(make):
    rng = random.Random(3)
    docs = make([(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(30)))) for i in range(120)])
    rows = pa.table({"id": [0, 1], "text": ["a b a b", "b a"], "held": [False, True]})
    counts = ip._by_hash(*np.unique(ip._tokens("a b a b").view(np.int64), return_counts=True))
    corpus = ip.Corpus(5, 3, 1)
    apart, shared = (ip._bigram_counts(corpus, packed)(rows, counts).to_pydict() for packed in (False, True))
    assert list(shared) == ["key", "n", "cc"] and shared["key"] == apart["key"] and shared["n"] == apart["n"]
    assert [(c >> 31, c & (1 << 31) - 1 if c >= 0 else c) for c in shared["cc"]] == list(zip(apart["cu"], apart["cv"]))
    scores = lambda **o: sorted((r["doc_id"], r["base_score"], round(r["score"], 9)) for r in ip.score(docs, F.col("doc_id") % 4 == 1, bitmap_bits=20, **o).collect())
    assert scores() == scores(pack_below=0)
