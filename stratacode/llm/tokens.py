"""Token ids of whole texts inside a Python worker, with a bounded memory of words.

The tokenizer splits at white space and between letters, digits and marks before it merges, so the ids of a text are the ids of these
parts in a row.  A word or part seen before is looked up instead of merged again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[str, "WordEncoder"] = {}

# UTF-8 bytes of texts below U+0100: there lower-casing goes letter by letter and nothing composes.
_PLAIN_BYTES = bytes(range(0xC4))
SLICE_BYTES = 8 << 20
# A word of which the parts are known without the tokenizer: printable ASCII but for the apostrophe of contractions, Latin-1 small letters.
_SIMPLE = re.compile(r"[!-&(-@\[-~ß-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class _Memory:
    """A dictionary of two generations; entries not asked for while ``limit`` others came are forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit, self.fresh, self.old = limit, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Of distinct keys those to be learned; all others are in ``fresh`` afterwards."""
        fresh = self.fresh
        unknown = [k for k in keys if k not in fresh]
        if len(fresh) + len(unknown) > self.limit:
            self.old, self.fresh = fresh, {}
            fresh, unknown = self.fresh, keys
        if not self.old:
            return unknown
        out = []
        for key in unknown:
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                fresh[key] = value
        return out


class WordEncoder:
    """Ids of texts as the tokenizer gives them for whole texts, without special tokens.

    Two generations of at most ``words`` words and as many parts bound the memory, but for the words of one batch; forgetting costs time only.
    """

    def __init__(self, path: str, words: int = 400_000) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For parts of small letters neither normalising nor splitting does anything.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.parts = _Memory(words), _Memory(words)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        if "<|" in text:  # a special token's spelling depends on case
            words = text.encode("utf-8").split()
        else:  # lower-casing may change how other letters compose, so it is left to the tokenizer
            words = [w.lower() if w.isascii() else w for w in text.encode("utf-8").split()]
        words = [w.decode("utf-8") for w in words]
        known = self._known(list(dict.fromkeys(words)))
        return b"".join([known[w] for w in words])

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; nulls are empty.  Slices of bounded text are split and looked up column-wise."""
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
        for i, size in enumerate(sizes):
            held += size
            if held >= SLICE_BYTES or i + 1 == len(sizes):
                yield from self._slice(texts.slice(start, i + 1 - start))
                start, held = i + 1, 0

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        rows = pc.fill_null(texts, "").to_pylist()
        plain = np.array([not t.encode("utf-8").translate(None, _PLAIN_BYTES) and "<|" not in t for t in rows], bool)
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain))))
        flat = split.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        known = self._known(distinct)
        ids = [known[w] for w in distinct]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        pool = np.frombuffer(b"".join(ids), "<u4")
        at = flat.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        first = (np.cumsum(sizes) - sizes)[at]
        tokens = pool[np.repeat(first - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        bounds = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(split) else [0]
        spans = zip(bounds, bounds[1:])
        for text, ordinary in zip(rows, plain.tolist()):
            if ordinary:
                start, end = next(spans)
                yield tokens[4 * start : 4 * end]
            else:
                yield self(text)

    def _known(self, distinct: list[str]) -> dict[str, bytes]:
        """Ids of distinct words; the dictionary holds others too."""
        missing = self.words.missing(distinct)
        known = self.words.fresh
        split: dict[str, list[str]] = {}
        whole = []
        for word in missing:
            if _SIMPLE.fullmatch(word) and "<|" not in word:
                split[word] = _PARTS.findall(word)
            elif word:
                whole.append(word)
            else:
                known[word] = b""
        parts = self.parts.missing(list({p for found in split.values() for p in found}))
        fresh = self.parts.fresh
        fresh.update(self._merged(self.letters, [p for p in parts if p.isalpha()]))
        fresh.update(self._merged(self.tokenizer, [p for p in parts if not p.isalpha()]))
        for word, found in split.items():
            known[word] = fresh[found[0]] if len(found) == 1 else b"".join([fresh[p] for p in found])
        known.update(self._merged(self.tokenizer, whole))
        return known

    def forget(self) -> None:
        """Drops the words and parts; a worker that waits for its next task then holds the tokenizers only."""
        self.words, self.parts = _Memory(self.words.limit), _Memory(self.parts.limit)
        pa.default_memory_pool().release_unused()

    @staticmethod
    def _merged(tokenizer, ask: list[str]) -> dict[str, bytes]:
        if not ask:
            return {}
        found = tokenizer.encode(ask, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(ask)), side="right").tolist() if ids else [0] * len(ask)
        return {word: ids[4 * start : 4 * end] for word, start, end in zip(ask, [0, *ends], ends)}


def encoder(path: str) -> WordEncoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
