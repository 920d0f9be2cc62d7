"""Source divergence audit by count-cell ranking.

Every language keeps the terms found in at least ``min_docs`` of its documents.  With ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))`` as the smoothed rate of
a term that a source (or a language) holds ``n`` times among ``N`` kept occurrences, sources are compared by ``f(p, q) = floor((p - q)^2 / (p + q))``.

``f`` of a term depends on its two counts only, so terms are grouped into cells of equal counts and ``f`` is evaluated once per cell:

* a source against its language: cells (source count, language count) are merged by value, the values ranked by cumulative multiplicity, and only the
  values that begin within the wanted ranks are expanded into terms;
* two sources: cells of the terms that both hold come from one join whose rows are counted where they arise; terms that only one of them holds
  follow from its own cells, terms of neither from the number of kept terms.

Documents are read once; each task sends the distinct terms of a source, never one row per word.  All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from stratacode.llm.staging import stage
from stratacode.llm.text import whole

MIN_DOCS, TOP_TERMS = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
ENTRIES = 400_000  # distinct (lang, source, term) that a task holds before it sends them

# A term is a run of ASCII letters and characters beyond ASCII; everything else separates.  A-Z become small.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = st.StructType([
    st.StructField("lang", st.StringType()), st.StructField("source", st.StringType()), st.StructField("term", st.StringType()),
    st.StructField("n", st.LongType()), st.StructField("docs", st.LongType()),
])


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8").translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a row without a term says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = [None, *(t.decode("utf-8") for t in times)]
            rows = len(terms)
            columns = [pa.repeat(pa.scalar(lang, pa.string()), rows), pa.repeat(pa.scalar(source, pa.string()), rows), pa.array(terms, pa.string()),
                       pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())]
            batch = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            yield from (batch.slice(at, 1 << 16) for at in range(0, rows, 1 << 16))
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms_of(text), len(times)
            times.update(found)
            docs.update(set(found))
            size += len(times) - before
            if size >= ENTRIES:
                yield from emit()
                size = 0
    yield from emit()


def rate(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (N + 2 V))``; decimal, so that no count overflows."""
    over = F.greatest(total + PRIOR * kept, F.lit(1))
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), over.cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two rates; rates are at most 10^9 + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def _telling_terms(rated: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of every group by distance from its language, among those that the group uses more often."""
    own = rated.where("p > q").select("lang", "source", "term", "n", "lang_n", distance(F.col("p"), F.col("q")).alias("value"))
    cells = own.groupBy("lang", "source", "n", "lang_n").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("terms"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value has a term at least, so no value beyond the first ``top`` is reached.
    values = values.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    # Of equal values only the first by name can be needed.
    same = Window.partitionBy("lang", "source", "value").orderBy("term")
    expanded = own.join(values, ["lang", "source", "value"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= top)
    return (
        expanded.withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def _source_pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """Distance of every two sources of a language, summed over all kept terms."""
    # What a term adds compared with a term that neither source holds; only terms of both need a join.
    one = rated.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("pa0"))
    two = one.toDF("lang", "term", "b", "pb", "pb0")
    met = one.join(two, ["lang", "term"]).where("a < b")
    cells = met.groupBy("lang", "a", "b", "pa", "pb").agg(F.count(F.lit(1)).alias("terms"), F.first("pa0").alias("pa0"), F.first("pb0").alias("pb0"))
    pa_, pb, pa0, pb0 = map(F.col, ("pa", "pb", "pa0", "pb0"))
    both = distance(pa_, pb) - distance(pa_, pb0) - distance(pa0, pb) + distance(pa0, pb0)
    shared = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * both).alias("shared"))
    # A source's own cells against the other's rate of an absent term; the number of kept terms of the language for the rest.
    own = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    gain = F.sum(F.col("terms") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0"))))
    alone = (
        own.join(groups.select("lang", "source", "p0"), ["lang", "source"]).join(other, "lang").where("source <> other")
        .groupBy("lang", "source", "other").agg(gain.alias("gain"))
    )
    pairs = groups.alias("x").join(groups.alias("y"), "lang").where("x.source < y.source").select(
        "lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (F.col("x.kept") * distance(F.col("x.p0"), F.col("y.p0"))).alias("absent"))
    summed = (
        pairs.join(shared, ["lang", "a", "b"], "left")
        .join(alone.toDF("lang", "a", "b", "gain_a"), ["lang", "a", "b"], "left")
        .join(alone.toDF("lang", "b", "a", "gain_b"), ["lang", "a", "b"], "left")
        .select("lang", "a", "b", (F.col("absent") + sum(F.coalesce(c, F.lit(0)) for c in ("shared", "gain_a", "gain_b"))).alias("value"))
    )
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(summed.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by distance, part ``term`` the ``top`` terms that
    a source uses more often than its language.

    Ranks are from 1, by value falling and item rising in UTF-8 order.  Null text, language and source are empty strings; every row is a document, repeated
    ones too.  A group without terms is compared like any other; without kept terms all distances are 0.  Other columns are not read; an empty table gives no rows.
    """
    named = docs.select(*[whole(F.col(f"`{c}`")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stage(named.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = stage(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = stage(counts.drop("docs").join(kept, ["lang", "term"]), "held-terms")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = stage(groups.withColumn("p0", rate(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    rated = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", rate(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        rate(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "p0")
    return _source_pairs(rated, groups).unionByName(_telling_terms(rated, top))
