"""Language-model scores by deleted interpolation.

``p(v | u) = l2 c(u, v) / c(u) + l1 c(v) / N + l0 / (V + 1)``: maximum-likelihood estimates of bigrams, unigrams and a uniform share for unknown
words, with weights that depend on how often the context ``u`` was seen (buckets of doubling frequency).  The weights come
from expectation-maximisation on deleted counts: every training token is held out in turn, its own occurrence taken off all counts.

Documents are read in chunks of bounded text, and what is shuffled are the distinct items of a chunk, never one row per token.  Word counts
are broadcast while the whole table of them measures at most ``broadcast_bytes``; beyond that size each chunk gets the counts of its own
words by a join, with the same result.  A bigram seen once is known from its unigrams alone, so only repeated ones
go back to the documents:

* a bitmap of fixed size over the repeated bigrams lets a chunk keep most others at home,
* bigrams more frequent than one in ``2^HEAVY_BITS`` tokens (at most that many, whatever the corpus) are
  broadcast with their scores, so the hottest keys are not shuffled at all,
* the rest is joined by key and summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_type

from stratacode.llm.decontaminate import slots
from stratacode.llm.shingles import mix, word_hashes
from stratacode.llm.staging import stage

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1 << 18
PART_ROWS = 64  # rows that join a chunk at once, so that it ends soon after it is full
BATCH_BYTES = 4 << 20  # of texts that go to Python at once
PLACE_BITS, CHUNK_BITS = 24, 16  # of a document's number: its place in a chunk, the chunk in its task; the task has the rest
BITMAP_BITS = 27
HEAVY_BITS = 20
HELD_BITS = 24  # of a bigram's count: chunks in which held-out rows have it; the training count has the rest
EM_ROUNDS = 60
BROADCAST_BYTES = 64 << 20
# Hashes of the two tokens that are no words: fixed values that no short word's hash takes.
START, END = 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B
_NONE = -1000  # bin of a probability of zero


def _tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), np.uint64(END))


def _half_octaves(x: np.ndarray) -> np.ndarray:
    """Bin of a probability or ratio, two bins per doubling."""
    return np.where(x > 0, np.floor(2 * np.log2(np.where(x > 0, x, 1.0)) + 0.5), _NONE).astype(np.int64)


@dataclass
class Corpus:
    tokens: int  # N
    words: int  # V, the end token included if it occurs
    documents: int


class _Chunk:
    """The documents of one chunk with the corpus counts of their words."""

    def __init__(self, rows: pa.Table, counts: tuple[bytes, bytes, bytes], corpus: Corpus) -> None:
        ids, texts = rows.column("id").to_pylist(), rows.column("text").to_pylist()
        held = rows.column("held").to_pylist()
        # A fixed order, so that a repeated task numbers the documents alike.
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), texts[i] or "", bool(held[i])))
        self.ids = [ids[i] for i in order]
        self.held = np.array([bool(held[i]) for i in order], bool)
        parts = [_tokens(texts[i]) for i in order]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        tokens = np.concatenate(parts)
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        del texts
        before = np.append(np.uint64(0), tokens[:-1])
        before[first] = START
        self.keys = mix(before * np.uint64(0xD1342543DE82EF95) + tokens)
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.sizes)
        del parts, before
        words, at = np.unique(tokens, return_inverse=True)
        del tokens
        self.cv = _looked_up(counts, words)[at]
        del words, at
        self.cu = np.append(np.int64(0), self.cv[:-1])
        self.cu[first] = corpus.documents
        self.train = ~self.held[self.doc]


def _by_hash(words: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Word counts for look-ups, as bytes that a worker reads in place: the sorted hashes of repeated words, their counts and the sorted hashes of single words.

    Words that only held-out rows have are left out, since their count is 0.
    """
    known = words.view(np.uint64)
    often = counts > 1
    order = np.argsort(known[often])
    n = counts[often][order]
    small = n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64)
    return known[often][order].tobytes(), small.tobytes(), np.sort(known[counts == 1]).tobytes()


def _looked_up(table: tuple[bytes, bytes, bytes], tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens."""
    known, once = np.frombuffer(table[0], np.uint64), np.frombuffer(table[2], np.uint64)
    n = np.frombuffer(table[1], np.uint32 if len(table[1]) == 4 * len(known) else np.int64)
    out = np.zeros(len(tokens), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        out = np.where(known[at] == tokens, n[at], 0).astype(np.int64)
    if len(once):
        rest = np.flatnonzero(out == 0)
        at = np.minimum(np.searchsorted(once, tokens[rest]), len(once) - 1)
        out[rest] = once[at] == tokens[rest]
    return out


def _gathered(function, chunk_bytes: int, chunk_rows: int = CHUNK_ROWS):
    """``function`` of a table as a function of batches: tables of about ``chunk_bytes`` of text and ``chunk_rows`` rows at most, numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, count = TaskContext.get().partitionId() << CHUNK_BITS, [], 0, 0

        def emit(number: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from function(table.append_column("chunk", pa.array(np.full(table.num_rows, first + number, np.int64)))).to_batches(max_chunksize=1 << 16)

        number = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(PART_ROWS, chunk_rows - count))
                at += part.num_rows
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                count += part.num_rows
                if size >= chunk_bytes or count >= chunk_rows:  # null and empty texts have no bytes
                    yield from emit(number)
                    number, held, size, count = number + 1, [], 0, 0
        if held:
            yield from emit(number)

    return run


def _word_counts(table: pa.Table) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    held = np.array([bool(x) for x in table.column("held").to_pylist()], bool)
    parts = [_tokens(t) for t in table.column("text").to_pylist()]
    tokens = np.concatenate(parts)
    weight = np.repeat(~held, [len(p) for p in parts]).astype(np.float64)
    words, at = np.unique(tokens, return_inverse=True)
    n = np.bincount(at, weight, len(words)).astype(np.int64)
    return pa.table({"chunk": pa.array(np.full(len(words), chunk, np.int64)), "w": pa.array(words.view(np.int64)), "n": pa.array(n)})


def _bigram_counts(corpus: Corpus, packed: bool):
    """Distinct bigrams of a chunk: key, n (training count and, in the last ``HELD_BITS`` bits, 1 if held-out rows have it), counts of the context and the word.

    ``packed``: both counts are below 2^31 and share a column; else they have one each.
    """
    names = ("key", "n", "cc") if packed else ("key", "n", "cu", "cv")

    def run(rows: pa.Table, counts: tuple[bytes, bytes, bytes]) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        x = _Chunk(rows, counts, corpus)
        order = np.argsort(x.keys)
        keys = x.keys[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, first = keys[start], order[start]  # equal bigrams have equal counts, so any will do
        del x.keys, x.doc
        train = np.add.reduceat(x.train[order], start, dtype=np.int64)
        held = np.diff(np.append(start, len(order))) - train
        del order, start
        # Training tokens by bucket of the context and bin of the deleted unigram, under small keys of their own.
        bucket = _bit_length(x.cu[x.train])
        deleted = _half_octaves((x.cv[x.train] - 1) / max(1, corpus.tokens - 1))
        code, times = np.unique(bucket * 4096 + (deleted + 2048), return_counts=True)
        minus = np.full(len(code), -1, np.int64)
        cu, cv = np.concatenate([x.cu[first], minus]), np.concatenate([x.cv[first], minus])
        n = np.concatenate([(train << HELD_BITS) | (held > 0), times << HELD_BITS])
        columns = (np.concatenate([keys.view(np.int64), code]), n, *([np.where(cu < 0, -1, (cu << 31) | cv)] if packed else [cu, cv]))
        return pa.table({c: pa.array(v) for c, v in zip(names, columns)})

    return run


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def learn_weights(seen: dict[tuple[int, int, int], float], rounds: int = EM_ROUNDS, buckets: int = 65, uniform: float = 1e-6) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket by EM.

    ``seen`` counts held-out tokens by (bucket, bin of the unigram probability, bin of the ratio bigram / unigram or of the bigram itself
    where the unigram is zero).
    """
    weights = np.tile([0.3, 0.6, 0.1], (buckets, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b in range(buckets):
        rows = [(q, r, n) for (bucket, q, r), n in seen.items() if bucket == b and n > 0]
        if not rows:
            continue
        q, r, n = (np.array(x, np.float64) for x in zip(*rows))
        p1 = np.where(q == _NONE, 0.0, 2.0 ** (q / 2))
        p2 = np.where(r == _NONE, 0.0, np.where(q == _NONE, 1.0, p1) * 2.0 ** (np.where(r == _NONE, 0, r) / 2))
        parts = np.stack([p2, p1, np.full(len(p1), uniform)], axis=1)
        w = weights[b].copy()
        for _ in range(rounds):
            share = parts * w
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def _scorer(bitmap, heavy, corpus: Corpus, weights: np.ndarray, bits: int, schema_type: pa.DataType):
    fields = [("id", schema_type), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rest", pa.float64())]

    def run(rows: pa.Table, counts: tuple[bytes, bytes, bytes]) -> pa.Table:
        if not rows.num_rows:
            longs = {c: pa.array([], pa.int64()) for c in ("uid", "key", "n")}
            return pa.table(longs | {"doc": pa.array([], pa.struct(fields))})
        x = _Chunk(rows, counts, corpus)
        docs = len(x.ids)
        chunk = rows.column("chunk")[0].as_py()
        bucket = _bit_length(x.cu)
        rest = weights[:, 1][bucket] * x.cv / max(1, corpus.tokens) + weights[:, 2][bucket] / (corpus.words + 1)
        once = np.where(x.train, weights[:, 0][bucket] / np.maximum(1, x.cu), 0.0)
        del bucket, x.cu
        logs = np.log10(rest + once)
        del rest, once
        base = np.log10((x.cv + 1) / (corpus.tokens + corpus.words + 1))
        # The hottest bigrams are scored here.
        keys, gain_train, gain_held = heavy.value
        left = np.ones(len(x.keys), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, x.keys), len(keys) - 1)
            hot = keys[at] == x.keys
            at = at[hot]
            logs[hot] += np.where(x.train[hot], gain_train[at], gain_held[at])
            left = ~hot
            del at, hot
        marked = np.frombuffer(bitmap.value, np.uint8)
        high, low = slots(x.keys, bits)
        on = lambda p: (marked[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        left &= (on(high) & on(low)) == 1
        del high, low
        doc, key = x.doc[left], x.keys[left]
        del x.keys, left
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        del order
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(key)))
        doc, key = doc[start], key[start]
        uid = np.int64(chunk) << np.int64(PLACE_BITS)
        sent = len(doc)
        own = np.arange(docs)
        sums = lambda v: np.bincount(x.doc, v, docs)
        facts = [x.held, x.sizes, sums(x.cv > 0).astype(np.int64), sums(base), sums(logs)]
        about = pa.StructArray.from_arrays([pa.array(x.ids, schema_type), *[pa.array(v, t) for v, (_, t) in zip(facts, fields[1:])]], fields=[pa.field(n, t) for n, t in fields])
        return pa.table({
            "uid": pa.array(np.concatenate([uid + doc, uid + own]).astype(np.int64)),
            # A document's own row has a key of its own that no bigram has.
            "key": pa.array(np.concatenate([key, mix((uid + own).astype(np.uint64) + np.uint64(1))]).view(np.int64)),
            "n": pa.array(np.concatenate([np.where(x.held[doc], -times, times), np.zeros(docs, np.int64)])),
            "doc": pa.chunked_array([pa.nulls(sent, about.type), about]),
        })

    return run


def _marked(spark, keys: DataFrame, bits: int):
    """Broadcast bitmap with two places per key."""
    slot = F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1)))
    chunks = (
        keys.select(slot.alias("slot")).select((F.col("slot") + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    marked = np.zeros(1 << (bits - 3), np.uint8)
    for row in chunks.collect():  # 2^bits bits at most
        at = (row["chunk"] - 1) * len(row["bits"])
        marked[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(marked.tobytes())


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          bitmap_bits: int = BITMAP_BITS, heavy_bits: int = HEAVY_BITS, broadcast_bytes: int = BROADCAST_BYTES,
          chunk_rows: int = CHUNK_ROWS, pack_below: int = 1 << 31) -> DataFrame:
    """One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Rows for which ``held_out`` is true are scored but not learned from; a null condition (of a null id, say) counts as false.  A null or empty
    text is its end token.  Repeated rows count as often as they occur.  With nothing to learn from, every token is unknown; an empty table gives
    no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    id_type = rows.schema["id"].dataType
    longs = lambda *names: st.StructType([st.StructField(n, st.LongType()) for n in names])
    words = rows.mapInArrow(_gathered(_word_counts, chunk_bytes, chunk_rows), longs("chunk", "w", "n"))
    unigrams = stage(words.groupBy("w").agg(F.sum("n").alias("c")), "unigrams", BATCH_BYTES)
    size = unigrams.agg(F.count(F.lit(1)).alias("rows"), F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.max("c").alias("most")).first()
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("held")).alias("d")).first()
    corpus = Corpus(size["n"] or 0, size["v"] or 0, total["d"] or 0)

    if 16 * size["rows"] <= broadcast_bytes:
        table = unigrams.toArrow()
        shared = spark.sparkContext.broadcast(_by_hash(table.column("w").to_numpy(), table.column("c").to_numpy()))
        del table

        def by_chunk(function, schema):
            return rows.mapInArrow(_gathered(lambda table: function(table, shared.value), chunk_bytes, chunk_rows), schema)

    else:
        # Hashing deals unevenly, so twice as many chunks as the rows need.
        chunks = max(1, -(-(total["b"] or 0) // chunk_bytes), -(-2 * total["rows"] // chunk_rows))
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
        asked = dealt.groupBy("chunk").applyInArrow(_word_counts, longs("chunk", "w", "n"))
        counts = stage(asked.join(unigrams, "w").select("chunk", "w", "c"), "counts")

        def by_chunk(function, schema):
            def run(texts: pa.Table, known: pa.Table) -> pa.Table:
                return function(texts, _by_hash(known.column("w").to_numpy(), known.column("c").to_numpy()))

            return dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, schema)

    # Fewer columns are less to shuffle: nearly all the disk of the job is this table.
    packed = max(size["most"] or 0, corpus.documents) < pack_below
    held = F.col("n").bitwiseAND((1 << HELD_BITS) - 1)
    met = by_chunk(_bigram_counts(corpus, packed), longs("key", "n", "cc") if packed else longs("key", "n", "cu", "cv"))
    pairs = met.groupBy("key").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in met.columns[2:]])
    if packed:
        low = F.when(F.col("cc") < 0, F.col("cc")).otherwise(F.col("cc").bitwiseAND((1 << 31) - 1))
        pairs = pairs.withColumns({"cu": F.shiftright("cc", 31), "cv": low})
    pairs = pairs.select("key", F.shiftright("n", HELD_BITS).alias("train"), held.alias("held"), "cu", "cv")
    pairs = stage(pairs.where("train > 1 or (train > 0 and held > 0) or cu < 0").drop("held"), "bigrams", BATCH_BYTES)
    repeated = pairs.where("cu >= 0")

    # Deleted counts by bucket and bins.
    bits = F.when(F.col("cu") > 0, F.length(F.bin("cu"))).otherwise(0)
    bin_of = lambda x: F.when(x > 0, F.floor(2 * F.log2(F.when(x > 0, x)) + 0.5)).otherwise(_NONE)
    p1 = (F.col("cv") - 1) / F.lit(float(max(1, corpus.tokens - 1)))
    p2 = (F.col("train") - 1) / F.greatest(F.col("cu") - 1, F.lit(1))
    again = (
        repeated.where("train > 1").groupBy(bits.alias("b"), bin_of(p1).alias("q"), bin_of(p2 / p1).alias("r"))
        .agg(F.sum("train").alias("n")).collect()
    )
    seen: dict[tuple[int, int, int], float] = {(x["b"], x["q"], x["r"]): float(x["n"]) for x in again}
    single: dict[tuple[int, int], float] = {}
    for x in pairs.where("cu < 0").select("key", "train").collect():
        single[x["key"] // 4096, x["key"] % 4096 - 2048] = float(x["train"])
    for (b, q, _), n in seen.items():
        single[b, q] = single.get((b, q), 0.0) - n
    seen |= {(b, q, _NONE): n for (b, q), n in single.items() if n > 0}
    weights = learn_weights(seen, uniform=1.0 / (corpus.words + 1))

    weight = lambda i: F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, i]]), bits + 1)
    rest = weight(1) * F.col("cv") / F.lit(float(max(1, corpus.tokens))) + weight(2) / F.lit(float(corpus.words + 1))
    context = F.greatest(F.col("cu"), F.lit(1))
    full = F.log10(rest + weight(0) * F.col("train") / context)
    gains = repeated.select("key", "train", (full - F.log10(rest + weight(0) / context)).alias("gain_train"), (full - F.log10(rest)).alias("gain_held"))
    # At most 2^heavy_bits bigrams can be as frequent as this.
    hot = gains.where(F.col("train") > F.lit(max(1, corpus.tokens >> heavy_bits))).select("key", "gain_train", "gain_held").toArrow()
    hot_keys = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hot_keys)
    heavy = spark.sparkContext.broadcast((hot_keys[order], hot.column("gain_train").to_numpy()[order], hot.column("gain_held").to_numpy()[order]))
    bitmap = _marked(spark, repeated.select("key"), bitmap_bits)

    about = st.StructType([st.StructField("id", id_type), st.StructField("held", st.BooleanType()), *longs("n_tokens", "n_known").fields,
                           st.StructField("base", st.DoubleType()), st.StructField("rest", st.DoubleType())])
    schema = st.StructType([*longs("uid", "key", "n").fields, st.StructField("doc", about)])
    sent = by_chunk(_scorer(bitmap, heavy, corpus, weights, bitmap_bits, to_arrow_type(id_type)), schema)
    n = F.col("n")
    gain = F.coalesce(F.when(n > 0, n * F.col("gain_train")).when(n < 0, -n * F.col("gain_held")), F.lit(0.0))
    return (
        # A hash table of the gains of a partition, which has a key once, spares sorting the many rows that are sent.
        sent.join(gains.drop("train").hint("shuffle_hash"), "key", "left")
        .select("uid", gain.alias("gain"), "doc.*")
        .groupBy("uid").agg(*[F.max(c).alias(c) for c in ("id", "held", "n_tokens", "n_known", "base")], (F.max("rest") + F.sum("gain")).alias("score"))
        .select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
                F.col("base").alias("base_score"), "score")
    )
