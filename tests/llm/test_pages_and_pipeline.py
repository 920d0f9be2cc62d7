from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from llm_corpora import prose, words_of
from tokenizers import Tokenizer

from stratacode.llm import html_layout
from stratacode.llm.html_layout import render

CASES = [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<b>a<i>b</b>c</i>d", "abcd"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ul><li>a<ol><li>x<li>y</ol><li>b</ul>", "- a\n  1. x\n  2. y\n- b"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<pre>a\n   b</pre>", "a\n   b"), ("<table><tr><td>a<td>long<tr><td>bbb<td>c</table>", "a    long\nbbb  c"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table></table>z", "a\n\nx  y\n\nz"), ("<td>loose</td> cell", "loose cell"),
    ("<head><title>t</title><style>s</style></head><body>v<script>if (a<b) '</p>'</script>w", "vw"), ("<title>t</title>body starts", "body starts"),
    ("<div hidden>no</div><p style='display:none'>no</p><i style='visibility: hidden'>no<b style='visibility:visible'>yes</b></i>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("&lt;b&gt; &amp; &copy;&nbsp;x", "<b> & ©\xa0x"), ("a<!-- no --> b<!DOCTYPE x>", "a b"), ('<a href="x>y" title=\'>\'>t</a>', "t"), ('<a href="x>y', "y"),
    ("</p>a</div></b>b", "ab"), ("<h1>a<h2>b</h2>", "a\n\nb"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\n  b\nc"), ("<select><option>a</select>b", "b"),
    ("1 < 2 and <3", "1 < 2 and <3"), ("<textarea> a\n b</textarea>", " a\n b"), ("<script>never closed", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert render(html) == text


def test_depth_length_and_tables_of_pages(spark):
    assert render("<div>" * 30_000 + "x") == "x" and render("<a '" * 20_000) == "" and len(render("<p>word" * 50_000).split()) == 50_000
    rows = [(1, "u", "<p>a", "old"), (2, None, None, None), (2, None, None, None), (None, "u", "", "old")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = html_layout.extract_text(pages)
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect()) == [(0, ""), (1, "a"), (2, ""), (2, "")]
    assert out.columns == ["page_id", "url", "html", "text"] and html_layout.extract_text(pages.limit(0)).count() == 0


@pytest.fixture
def tables(spark, make, edge, tmp_path):
    rng = random.Random(31)
    sentence = "the of and to in that is was for with "
    clean = [(i, sentence * 2 + prose(rng, rng.randint(60, 200), 10**6)) for i in range(100, 130)]
    item, passage = prose(rng, 40, 10**6), prose(rng, 70, 10**6)
    pairs = clean + [
        (200, clean[0][1]), (201, clean[1][1].replace("the of", "the of of", 1)), (202, sentence * 2 + passage + " " + prose(rng, 80, 10**6)),
        (203, sentence * 2 + prose(rng, 80, 10**6) + " " + passage), (204, sentence * 3 + item + " " + prose(rng, 80, 10**6)), (205, "*** " * 80), (206, "too short"),
    ]
    make(pairs).unionByName(edge).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), clean, passage


def test_stages_take_effect_and_keep_clean_documents(spark, tables):
    sf_dir, clean, passage = tables
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.persist()
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    rules, near, cut, left = seen
    ids = {i for i, _ in clean}
    assert not {205, 206, 1, 2, 3, 4} & set(rules) and ids | {200, 201, 202, 203, 204} <= set(rules)
    assert not {200, 201} & set(near) and ids | {202, 203, 204} <= set(near)
    assert set(cut) == set(near) and cut[202] == near[202] and " ".join(words_of(passage)) not in " ".join(words_of(cut[203])) and len(words_of(cut[203])) >= 80
    assert set(left) == set(cut) - {204}
    assert all(left[i] == t for i, t in clean)


def test_run_packs_exactly_what_the_stages_keep(spark, tables):
    sf_dir, clean, _ = tables
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    for i, text in clean:
        part = out[out["doc_id"] == i].sort_values("start")
        ids = b"".join(bytes(x) for x in part["ids"])
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert ids == b"".join(x.to_bytes(4, "little") for x in want)
    assert not {200, 201, 204, 205, 206} & set(out["doc_id"].dropna())


def test_empty_tables(spark, edge, tmp_path):
    edge.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
