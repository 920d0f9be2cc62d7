"""Cross-tokenizer alignment with an associative fragment monoid.

A text (with one space before it) is encoded by a byte-level and a SentencePiece tokenizer.  Byte offsets at which tokens of both end cut the tokens into
groups; a link is a pair of tokens whose byte ranges overlap.

Neither tokenizer has a token that goes on over a space between two characters that are no white space, so such a space is a *cut* (and no token of theirs
holds a line break between such characters and anything else): what lies between
two cuts is encoded on its own, and both tokenizers end there.  Any byte range of a text is a ``Fragment``: an open head up to the first cut that can be
seen in it, closed groups, an open tail from the last cut on.  ``join`` encodes what a tail and the next head form together; it is
associative, so the ranges of one text may be joined in any bracketing.  Texts of up to ``chunk_bytes`` are one fragment in the task that reads them.
Longer ones are cut into byte ranges that Spark deals over its tasks; each range sends its closed part as a row that stays where it is, and a tree
of joins over heads and tails of ``FANOUT`` neighbours at a time closes the seams.

A text is encoded once; its links by pair are staged with its facts.  How often two ids are linked corpus-wide is counted from these lists: pairs more frequent
than one link in ``2^HEAVY_BITS`` (at most that many pairs) are broadcast, the links of all others are joined by pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_schema

from stratacode.llm.staging import stage

CHUNK_BYTES = 1 << 16
FANOUT = 16
HEAVY_BITS = 20
UNITS = 200_000  # distinct units that a worker remembers, but for those of one batch
BATCH_BYTES = 1 << 20
HELD_LINKS = 1_000_000  # links that a task sums before it sends them
PAIR = 1 << 32

# White space other than ASCII, in UTF-8 (fixed values of the Unicode property).
_WIDE = [rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80"]
_BLANK = rb"[\x09-\x0d\x1c-\x20]"
_ANY_WIDE = re.compile(b"|".join(_WIDE))


def _between(mark: bytes) -> tuple[re.Pattern[bytes], re.Pattern[bytes]]:
    """A mark between two characters that are no white space: where no wide white space occurs, and anywhere."""
    plain = rb"(?<!" + _BLANK + rb")(?!\A)" + mark + rb"(?!" + _BLANK + rb"|\Z)"
    return re.compile(plain), re.compile(b"".join(rb"(?<!" + w + rb")" for w in _WIDE) + plain + rb"(?!" + b"|".join(_WIDE) + rb")")


_CUT, _WIDE_CUT = _between(rb"\x20")
# Neither tokenizer joins a single line break to what stands beside it, so units end there too.
_BREAK, _WIDE_BREAK = _between(rb"\n")
LINE = b"\xff"  # begins the name of a unit that begins with a line break; no text holds this byte
SEEN = 3  # bytes that must be known on either side of a cut: the longest white space


def _cut(stretch: bytes) -> re.Pattern[bytes]:
    return _WIDE_CUT if _ANY_WIDE.search(stretch) else _CUT


def split_units(stretch: bytes) -> list[bytes]:
    """The names of the units of a stretch that begins at a cut: what follows their space, or ``LINE`` and what follows their line break."""
    if not stretch:
        return []
    cut, line_break = (_WIDE_CUT, _WIDE_BREAK) if _ANY_WIDE.search(stretch) else (_CUT, _BREAK)
    first, *lines = line_break.split(stretch)
    out = cut.split(first)
    out[0] = out[0][1:]
    for line in lines:
        units = cut.split(line)
        units[0] = LINE + units[0]
        out += units
    return out


def spelled(unit: bytes) -> bytes:
    """The bytes of a unit."""
    return b"\n" + unit[1:] if unit[:1] == LINE else b" " + unit


@dataclass
class Closed:
    """Closed groups of a stretch of text, as numbers of its units in order (``Aligner.units``) and sums over them."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    exact: bool = True  # both tokenizers give back the bytes
    groups: str = ""  # a1,a2|b1;a3|b2
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # a * 2^32 + b of each link

    def __add__(self, other: "Closed") -> "Closed":
        between = ";" if self.groups and other.groups else ""
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.n_links + other.n_links, self.exact and other.exact,
                      self.groups + between + other.groups, np.concatenate([self.pairs, other.pairs]))


class Aligner:
    """Alignment of text between cuts.  A unit (a word with its space, mostly) is aligned once and remembered, up to ``units`` of them."""

    def __init__(self, path_a: str, path_b: str, units: int = UNITS) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back = _byte_alphabet()
        named = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(back[c] for c in named.get(i, "") if c in back) for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.marked = [[f"{i}{mark}" for i in ids] for mark in (",", "|", ";", "\n")]
        self.limit = units
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.facts = np.empty((0, 5), np.int64)  # tokens of either side, groups, links, units that do not give back their bytes
        self.pairs, self.bounds = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.seen = np.empty(0, np.int64)

    def numbers(self, stretch: bytes) -> np.ndarray:
        """The units of a stretch that begins at a cut, by number."""
        return self.all_numbers([stretch])[0]

    def all_numbers(self, stretches: list[bytes]) -> list[np.ndarray]:
        """``numbers`` of several stretches; new units of all of them are encoded together."""
        split = [split_units(x) for x in stretches]
        known = self.known
        missing = list(set().union(*split).difference(known))
        if missing:
            self._learn(missing)
        numbers = [np.array([known[u] for u in units], np.int64) for units in split]
        self.seen += np.bincount(np.concatenate(numbers) if numbers else [], minlength=len(self.groups)).astype(np.int64)
        return numbers

    def make_room(self) -> None:
        """Forgets rare units if there are too many; to be called between texts, since all numbers change."""
        if len(self.known) > self.limit:
            self.shrink()

    def shrink(self) -> None:
        """Keeps the units seen twice or more, or as often as it takes to keep half of the limit at most.  What was seen long ago counts less each time."""
        least = 2
        while np.count_nonzero(self.seen >= least) > self.limit // 2:
            least *= 2
        kept = np.flatnonzero(self.seen >= least)
        many, units = np.diff(self.bounds)[kept], list(self.known)  # in the order of their numbers
        self.pairs, self.bounds = self.links(kept), np.concatenate([[0], np.cumsum(many)])
        self.facts, self.seen = self.facts[kept], self.seen[kept] // 2
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.known = {units[i]: number for number, i in enumerate(kept.tolist())}

    def closed(self, numbers: np.ndarray, with_pairs: bool = True) -> Closed:
        sums = self.facts[numbers].sum(0).tolist()
        names = self.groups
        text = ";".join([names[i] for i in numbers.tolist()]) if not sums[4] else ""
        return Closed(*sums[:4], not sums[4], text, self.links(numbers) if with_pairs else np.empty(0, np.int64))

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """The linked pairs of the units, in order."""
        first = self.bounds[numbers]
        many = self.bounds[numbers + 1] - first
        ends = np.cumsum(many)
        return self.pairs[np.repeat(first - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _learn(self, units: list[bytes]) -> None:
        whole = [spelled(u) for u in units]
        words = [w.decode("utf-8") for w in whole]
        ids_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        # The second tokenizer sets a space before the text itself; before a line break it is a token of its own.
        ids_b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        ids_b = [ids if w[0] == " " else ids[1:] for w, ids in zip(words, ids_b)]
        good = self._given_back(whole, ids_a, ids_b)
        facts, names = np.zeros((len(units), 5), np.int64), [""] * len(units)
        facts[:, 4] = 1
        many = np.zeros(len(units), np.int64)
        if good:
            kept = (ids_a, ids_b) if len(good) == len(whole) else ([x[i] for i in good] for x in (ids_a, ids_b))
            pairs, groups, own = self._linked(*kept, np.array([len(whole[i]) for i in good], np.int64))
            facts[good] = own
            many[good] = own[:, 3]
            for i, text in zip(good, groups):
                names[i] = text
            self.pairs = np.concatenate([self.pairs, pairs])
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += names
        self.facts = np.concatenate([self.facts, facts])
        self.seen = np.concatenate([self.seen, np.zeros(len(units), np.int64)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(many)])

    def _given_back(self, whole: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[int]:
        """Which texts both sides spell byte for byte; all of them are compared as one row of bytes first."""
        sizes, text = np.array([len(w) for w in whole]), b"".join(whole)
        for table, lengths, ids in ((self.bytes_a, self.sizes_a, ids_a), (self.bytes_b, self.sizes_b, ids_b)):
            flat = list(chain.from_iterable(ids))
            spelled = np.bincount(np.repeat(np.arange(len(ids)), [len(x) for x in ids]), lengths[flat], len(ids))
            if (spelled != sizes).any() or self._spelled(table, flat) != text:
                return [i for i, w in enumerate(whole) if self._spelled(self.bytes_a, ids_a[i]) == w and self._spelled(self.bytes_b, ids_b[i]) == w]
        return list(range(len(whole)))

    @staticmethod
    def _spelled(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join([table[i] for i in ids])

    def _linked(self, ids_a: list[list[int]], ids_b: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(linked pairs, text of the groups of each unit, facts of each unit).  Every unit ends in a common byte, so all are one row of bytes."""
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b, unit_ends = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]), np.cumsum(sizes)
        # Between two neighbouring ends lie one token of each side, and every linked pair shares one such stretch.
        ends, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        pairs = a[np.searchsorted(ends_a, ends)] * PAIR + b[np.searchsorted(ends_b, ends)]
        each = lambda x: np.bincount(np.searchsorted(unit_ends, x), minlength=len(sizes))
        facts = np.stack([each(ends_a), each(ends_b), each(common), each(ends), np.zeros(len(sizes), np.int64)], axis=1)
        # Texts: a group's tokens of the first side, then those of the second; each token with the mark that follows it.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = common[group_a] == ends_a, common[group_b] == ends_b
        over = last_b & (unit_ends[np.searchsorted(unit_ends, ends_b)] == ends_b)
        marks = np.concatenate([np.where(last_a, 1, 0), np.where(over, 3, np.where(last_b, 2, 0))])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        spelled = np.concatenate([a, b])[order].tolist()
        text = "".join([self.marked[m][i] for m, i in zip(marks[order].tolist(), spelled)])
        return pairs, text.split("\n")[:-1], facts


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Fragment:
    """A byte range of a text: bytes up to its first cut, closed groups, bytes from its last cut on; without a cut all of it is ``head`` and
    ``body`` is None."""

    head: bytes = b""
    body: Closed | None = None
    tail: bytes = b""


def stretch(piece: bytes, align: Aligner) -> Closed:
    """The closed groups of text between two cuts."""
    return align.closed(align.numbers(piece))


def lift(piece: bytes, align: Aligner) -> Fragment:
    """The fragment of a byte range.  Cuts count only where enough bytes on both sides are seen to be sure of them."""
    found = [m.start() for m in _cut(piece).finditer(piece) if SEEN <= m.start() < len(piece) - SEEN]
    if not found:
        return Fragment(piece)
    first, last = found[0], found[-1]
    return Fragment(piece[:first], stretch(piece[first:last], align), piece[last:])


def join(x: Fragment, y: Fragment, align: Aligner) -> Fragment:
    """The fragment of two adjoining ranges.  Associative: any bracketing closes to the same groups; the empty fragment is the identity."""
    seam = lift((x.head if x.body is None else x.tail) + y.head, align)
    if x.body is None and y.body is None:
        return seam
    if seam.body is None:  # no cut at the seam
        if x.body is None:
            return Fragment(seam.head, y.body, y.tail)
        if y.body is None:
            return Fragment(x.head, x.body, seam.head)
        return Fragment(x.head, x.body + stretch(seam.head, align) + y.body, y.tail)
    head, body = (seam.head, seam.body) if x.body is None else (x.head, x.body + stretch(seam.head, align) + seam.body)
    return Fragment(head, body, seam.tail) if y.body is None else Fragment(head, body + stretch(seam.tail, align) + y.body, y.tail)


def close(x: Fragment, align: Aligner) -> Closed:
    """The groups of a whole text: its two ends are cuts."""
    head = stretch(x.head, align)
    return head if x.body is None else head + x.body + stretch(x.tail, align)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per pair of files and worker process.

    A task has one core: the tokenizer's own threads would only add the CPU time of handing them words.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]

# --- Spark ---------------------------------------------------------------------------------------


@dataclass
class Alignment:
    """documents: one row of facts per row of the input; groups: (id, place, groups) texts in order; pairs: (a, b, links, best) over the corpus."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


_FACTS = ["n_a", "n_b", "n_groups", "n_links"]
_LONGS = lambda *names: [st.StructField(n, st.LongType()) for n in names]
_PART = st.StructType([*_LONGS("uid", "place", *_FACTS), st.StructField("exact", st.BooleanType()), st.StructField("groups", st.StringType()),
                       st.StructField("pairs", st.ArrayType(st.LongType())), st.StructField("times", st.ArrayType(st.LongType()))])
_OPEN = st.StructType([*_LONGS("uid", "at"), st.StructField("head", st.BinaryType()), st.StructField("tail", st.BinaryType()), st.StructField("has_body", st.BooleanType())])
_EITHER = st.StructType([st.StructField("open", _OPEN), st.StructField("part", _PART)])
LAST = (1 << 62) - 1


def _part(uid: int, place: int, x: Closed) -> dict:
    pairs, times = np.unique(x.pairs, return_counts=True)
    return {"uid": uid, "place": place, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links, "exact": x.exact, "groups": x.groups,
            "pairs": pairs, "times": times}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _lifter(paths: tuple[str, str]):
    """Byte ranges to fragments: the open ends and the closed part of each."""
    schema = to_arrow_schema(_EITHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in batches:
            for uid, at, piece in zip(*(c.to_pylist() for c in batch.columns)):
                align.make_room()
                x = lift(piece, align)
                closed_part = None if x.body is None else _part(uid, 2 * at, x.body)
                yield _rows([{"open": {"uid": uid, "at": at, "head": x.head, "tail": x.tail, "has_body": x.body is not None}, "part": closed_part}], schema)

    return run


def _joiner(paths: tuple[str, str], last: bool):
    """Joins neighbouring fragments of one text.  Bodies stay where they are; what closes at the seam before range ``at`` takes place 2 at - 1."""
    schema = to_arrow_schema(_EITHER)

    def run(rows: pa.Table) -> pa.Table:
        align = aligner(*paths)
        align.make_room()
        found = sorted(rows.select(["uid", "at", "head", "tail", "has_body"]).to_pylist(), key=lambda r: r["at"])
        uid, out, whole = found[0]["uid"], [], None
        for r in found:
            x = Fragment(r["head"], Closed() if r["has_body"] else None, r["tail"])
            if whole is None:
                whole = x
                continue
            whole = join(whole, x, align)
            if whole.body is not None and whole.body.n_a + (not whole.body.exact):
                out.append({"part": _part(uid, 2 * r["at"] - 1, whole.body)})
                whole.body = Closed()
        if last:
            out.append({"part": _part(uid, -1, stretch(whole.head, align))})
            if whole.body is not None:
                out.append({"part": _part(uid, LAST, stretch(whole.tail, align))})
        else:
            out.append({"open": {"uid": uid, "at": found[0]["at"], "head": whole.head, "tail": whole.tail, "has_body": whole.body is not None}})
        return pa.Table.from_batches([_rows(out, schema)])

    return run


def _long_parts(texts: DataFrame, paths: tuple[str, str], chunk_bytes: int) -> DataFrame:
    """Closed parts, by (uid, place), of texts longer than a chunk: (uid, raw) dealt as byte ranges and joined as a tree."""
    size = F.lit(chunk_bytes)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / size).cast("int"))).alias("at")
    pieces = texts.select("uid", at, "raw").select("uid", F.col("at").cast("bigint").alias("at"), F.substring("raw", F.col("at") * size + 1, size).alias("piece"))
    lifted = stage(pieces.repartition("uid", "at").mapInArrow(_lifter(paths), _EITHER), "lifted")
    parts = [lifted.where("part is not null").select("part.*")]
    open_ = lifted.where("open is not null").select("open.*")
    ranges = (open_.agg(F.max("at")).first()[0] or 0) + 1
    width = 1
    while True:
        width *= FANOUT
        node = F.floor(F.col("at") / F.lit(width)).alias("node")
        joined = stage(open_.groupBy("uid", node).applyInArrow(_joiner(paths, width >= ranges), _EITHER), "joined")
        parts.append(joined.where("part is not null").select("part.*"))
        if width >= ranges:
            break
        open_ = joined.where("open is not null").select("open.*")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _batched(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, stretches) of bounded text; null and empty texts are empty stretches."""
    ids, stretches, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(key)
        stretches.append(b" " + text.encode("utf-8") if text else b"")
        held += len(stretches[-1])
        if held >= BATCH_BYTES:
            yield ids, stretches
            ids, stretches, held = [], [], 0
    if ids:
        yield ids, stretches


_SHORT = st.StructType([*_LONGS(*_FACTS), st.StructField("groups_sha256", st.StringType()), *_PART.fields[-2:]])
_SUMS = st.StructType([*_LONGS("uid", "n_best", "count_sum"), *_PART.fields[-2:]])


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode("ascii")).hexdigest() if groups else ""


def _whole_texts(paths: tuple[str, str]):
    """Facts, digest and links of texts that are one fragment."""
    types = to_arrow_schema(_SHORT).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in batches:
            for ids, stretches in _batched(batch):
                align.make_room()
                rows = []
                for x in align.all_numbers(stretches):
                    found = align.closed(x)
                    if found.exact:
                        pairs, times = np.unique(found.pairs, return_counts=True)
                        rows.append((found.n_a, found.n_b, found.n_groups, found.n_links, _digest(found.groups), pairs, times))
                    else:
                        rows.append((0, 0, 0, 0, "", [], []))
                columns = [pa.array(ids, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]]
                yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], *_SHORT.names])
        align.shrink()  # the worker lives on through stages that need no units

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by pair of lists (pairs, times), summed over some batches at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([t for _, t in held]), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["pair", "n"])

    for batch in batches:
        held.append((_flat(batch.column(0))[0], _flat(batch.column(1))[0]))
        size += len(held[-1][0])
        if size >= HELD_LINKS:
            yield from emit()
            held, size = [], 0
    if held:
        yield from emit()


def _summed(heavy):
    """Sums over the links of frequent pairs; links of all other pairs are listed."""
    types = to_arrow_schema(_SUMS).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = heavy.value
        for batch in batches:
            (pairs, row), (times, _) = _flat(batch.column(1)), _flat(batch.column(2))
            rows = batch.num_rows
            hit, counts, bests = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                hit = keys[at] == pairs
                counts, bests = np.where(hit, n[at] * times, 0), np.where(hit, best[at] * times, 0)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
            # Whole numbers throughout: prefix sums, so that no large sum goes through floats.
            over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            offsets = pa.array(np.concatenate([[0], np.cumsum(~hit)])[bounds], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over(bests)), pa.array(over(counts)), *[x.cast(t) for x, t in zip(lists, types[3:])]], _SUMS.names)

    return run


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, sha256) of group texts that arrive ordered by (uid, place)."""
    uid, state = None, None
    for batch in batches:
        out = []
        for key, groups in zip(*(c.to_pylist() for c in batch.columns)):
            if key != uid:
                if state is not None:
                    out.append((uid, state.hexdigest()))
                uid, state = key, hashlib.sha256()
            else:
                state.update(b";")
            state.update(groups.encode("ascii"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["uid", "groups_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([state.hexdigest()])], ["uid", "groups_sha256"])


def _group_texts(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in batches:
            for ids, stretches in _batched(batch):
                align.make_room()
                texts = [align.closed(x, with_pairs=False).groups for x in align.all_numbers(stretches)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array([0] * len(ids)), pa.array(texts, pa.string())], ["id", "place", "groups"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          heavy_bits: int = HEAVY_BITS) -> Alignment:
    """Alignment of every text of ``docs`` between a byte-level (A) and a SentencePiece (B) tokenizer.

    ``documents``: ``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of their B id, ties included), count_sum (pair
    counts summed over links), groups_sha256 (of ``a1,a2|b1;a3|b2``; '' without tokens).  ``groups`` has these texts, by place for long ones.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros.  Repeated rows count
    as often as they occur; a null id is kept; an empty table gives no rows.  Other columns are not read.
    """
    spark, paths = docs.sparkSession, (path_a, path_b)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_field = narrow.schema["id"]
    is_long = F.coalesce(F.octet_length("text") >= chunk_bytes, F.lit(False))
    short, long = narrow.where(~is_long), narrow.where(is_long)
    number = F.monotonically_increasing_id().alias("uid")
    whole = stage(short.mapInArrow(_whole_texts(paths), st.StructType([id_field, *_SHORT.fields])).select(number, "*"), "aligned")
    # Long texts have negative numbers.
    long = stage(long.select((-number - 1).alias("uid"), "id", F.concat(F.lit(" "), "text").cast("binary").alias("raw")), "long-texts")
    parts = _long_parts(long.select("uid", "raw"), paths, chunk_bytes)
    exact = parts.groupBy("uid").agg(F.min("exact").alias("exact")).where("exact").select("uid")
    parts = stage(parts.join(exact, "uid", "left_semi"), "long-parts")
    lists = whole.select("uid", "pairs", "times").unionByName(parts.select("uid", "pairs", "times"))

    links = lists.select("pairs", "times").mapInArrow(_pair_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    links = stage(links, "links").withColumn("b", F.col("pair").bitwiseAND(PAIR - 1))
    highest = F.broadcast(links.groupBy("b").agg(F.max("n").alias("highest")))  # as many rows as B has ids
    pairs = stage(links.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-counts")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    # Fewer than 2^heavy_bits pairs can be as frequent as this.
    hot = pairs.where(F.col("n") > F.lit(total >> heavy_bits)).toArrow()
    columns = [hot.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "n", "best")]
    order = np.argsort(columns[0])
    summed = stage(lists.mapInArrow(_summed(spark.sparkContext.broadcast([c[order] for c in columns])), _SUMS), "link-sums")

    listed = summed.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = listed.join(pairs, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed.select("uid", "n_best", "count_sum").unionByName(rare).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))

    in_order = parts.where("groups <> ''").select("uid", "place", "groups").repartition("uid").sortWithinPartitions("uid", "place")
    digests = in_order.select("uid", "groups").mapInArrow(_streamed_digests, "uid bigint, groups_sha256 string")
    facts = parts.groupBy("uid").agg(*[F.sum(c).alias(c) for c in _FACTS]).join(digests, "uid")
    long_facts = long.select("uid", "id").join(facts, "uid", "left").select("uid", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in _FACTS],
                                                                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    documents = whole.drop("pairs", "times").unionByName(long_facts).join(sums, "uid", "left").select(
        F.col("id").alias(id_col), *_FACTS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    texts = short.mapInArrow(_group_texts(paths), st.StructType([id_field, *_LONGS("place"), st.StructField("groups", st.StringType())]))
    long_texts = parts.where("groups <> ''").join(long.select("uid", "id"), "uid").select("id", "place", "groups")
    return Alignment(documents, texts.unionByName(long_texts).withColumnRenamed("id", id_col),
                     pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(PAIR - 1).alias("b"), F.col("n").alias("links"), "best"))
