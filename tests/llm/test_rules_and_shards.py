from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from stratacode.llm import histogram_sort as hs
from stratacode.llm import quality_rules as qr

from llm_corpora import WORD, prose


def counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if three[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(ws), sum(map(len, ws)), sum(c in qr.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_a_plain_count(make, edge):
    rng = random.Random(1)
    texts = [prose(rng, n, 30) for n in (1, 2, 3, 10, 60, 300)] + ["a b c a b c", "x\nx\n\nx", "a " * 40, "#* a|b <c>"]
    docs = make(list(enumerate(texts, 100))).unionByName(edge)
    got = qr.measure(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == docs.count()
    for row in got:
        assert tuple(row)[1:] == counts(row["text"]), row["text"]


def test_verdict_filter_and_columns(make, edge):
    rng = random.Random(2)
    good = "the of and to in that is " + " ".join(prose(rng, 200).split("\n"))
    docs = make([(20, good), (21, "spam *** " * 60), (22, good)]).unionByName(edge)
    judged = {(r["doc_id"], r["text"]): r for r in qr.judge(qr.measure(docs)).collect()}
    assert judged[20, good]["kept"] and judged[20, good]["failed_rules"] == []
    assert "symbols" in judged[21, "spam *** " * 60]["failed_rules"]
    assert judged[1, None]["failed_rules"] == ["too_short"]
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] >= 20) == [20, 22]
    assert qr.keep_good(docs.limit(0)).count() == 0


def test_the_plan_is_native_and_has_no_shuffle(make):
    plan = qr.judge(qr.measure(make([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_shards_are_gapless_and_near_equal(make):
    rng = random.Random(3)
    copy = prose(rng, 100)
    pairs = [(i, copy if i % 3 == 0 else prose(rng, rng.randint(1, 120))) for i in range(1500)]
    docs = make(pairs)
    out = hs.histogram_sort(docs, 8, piece_bytes=4096, tolerance=0.01).withColumn("size", hs.byte_size(F.col("text"))).toPandas()
    assert sorted(out["doc_id"]) == list(range(1500))
    total = out["size"].sum() / 8
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
        assert abs(part["size"].sum() - total) < 0.05 * total
    # A group that alone exceeds the tolerance is cut; other texts stay together.
    assert out[out["text"] == copy]["shard"].nunique() > 1


def test_shards_of_odd_rows(edge):
    out = hs.histogram_sort(edge, 4).toPandas()
    assert len(out) == edge.count() and list(out.columns)[-2:] == ["shard", "slot"]
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert hs.histogram_sort(edge.limit(0), 4).count() == 0
    assert hs.histogram_sort(edge, 1).select("shard").distinct().count() == 1


def test_splitters_are_exact(spark):
    rng = random.Random(4)
    keys = [(rng.randint(-(2**63), 2**63 - 1), rng.randint(1, 50)) for _ in range(3000)] + [(5, 7)] * 500
    found = hs.find_splitters(spark.createDataFrame(keys, "key bigint, size bigint"), 10, 0.01)
    for s in found:
        assert s.bytes_below == sum(b for k, b in keys if k < s.key)
        assert s.rows_below == sum(k < s.key for k, _ in keys)
