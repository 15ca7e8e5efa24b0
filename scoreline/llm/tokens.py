"""Token ids by the tokenizers library, through a cache of text pieces.

The library spends most of its time on pieces it has merged before. Both public vocabularies encode the
pieces between certain white space independently of each other, so a batch is split and
dictionary-encoded by Arrow. Both also part a word from the punctuation and the line break after it,
so the distinct pieces are cut there and dictionary-encoded again: sentences make many more pieces
than words. Each distinct part is looked up once, unseen ones go to the library many at a time, and
the ids are gathered by Arrow, of pieces first, then of texts. Texts where a cut could change the ids
go to the library whole. ``tests/llm/test_tokens.py`` holds all this against plain encoding.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 640_000  # parts kept by a worker (about 100 MB)
FRESH = 16  # beyond that the newest 1 / FRESH of them go: the first ones met are the frequent ones; all go after as many unseen ones as are kept
SLICE = 2 << 20  # bytes of text encoded at once (one longer text goes alone)
MARK = "<|endoftext|>"  # parts pieces that are sent as one text
_WORKER: dict = {}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Byte-level vocabulary, cut before spaces: a space between two white-space characters, or after one
# at the end, may belong to a longer run.
# Both: NUL, which marks the cuts.
ODD_SPACED = rf"{_WS} {_WS}|{_WS} \z|\x00"
# Vocabulary without white space, cut at it: separators on which Arrow and the vocabulary disagree.
ODD_DROPPED = r"[\x00\x1c-\x1f\x{180e}\x{200b}\x{2060}\x{feff}]"

# A piece is cut between a Latin letter and punctuation after it, and around one line break between these and a
# letter. Other letters, digits, marks and apostrophes (contractions) are not cut at; nor is U+0130, which a mark
# follows when lower-cased.
_LETTER, _POINTS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]", r"!-&(-/:-@\[-`{-~"
CUTS = ((rf"({_LETTER})([{_POINTS}])", "\\1\0\\2"), (rf"({_LETTER}|[{_POINTS}])\n({_LETTER})", "\\1\0\n\0\\2"))
PLAIN = {spaced: re.compile(f"{' ' if spaced else ''}{_LETTER}+") for spaced in (True, False)}


def _distinct(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct values, the place of each value there, where each list begins or ends among the values)."""
    bound = lists.offsets.to_numpy()
    bound = bound - bound[0] if len(bound) else np.zeros(1, np.int32)
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(), bound


def _joined(ids: pa.Array, code: np.ndarray, bound: np.ndarray) -> pa.Array:
    """The ids at ``code``, joined to one value from each bound to the next."""
    ids = ids.take(pa.array(code))
    end = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset:] if len(ids) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1,
                                 [None, pa.py_buffer(end[bound]), ids.buffers()[2] if len(ids) else pa.py_buffer(b"")])


class Encoder:
    """ids of texts as little-endian unsigned 16- or 32-bit values.

    ``spaced``: the vocabulary keeps white space (byte-level BPE); otherwise it drops it.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        # A second instance, in which one special token parts pieces that are sent as a single text.
        self.parted = Tokenizer.from_file(path)
        self.mark_id = self.parted.token_to_id(MARK)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.spaced = spaced
        # Tokens that begin a word with its space, or end a word.
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True
        self.seen: dict[str, bytes] = {}
        self.gone = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of short pieces, encoded as one long text that the mark parts."""
        joined = MARK.join(pieces)
        if joined.count(MARK) >= len(pieces):  # a piece holds the mark itself
            return self._library(pieces)
        whole = self.parted.encode_batch_fast([joined], add_special_tokens=False)[0]
        ids = np.array(whole.ids, dtype=self.dtype)
        cut = np.flatnonzero(ids == self.mark_id)
        raw, w = ids.tobytes(), self.dtype.itemsize
        return [raw[w * a:w * b] for a, b in zip([0, *(cut + 1)], [*cut, len(ids)])]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words (each begins with its space, if spaced), encoded as one text; tokens show where each begins or ends."""
        whole = self.lib.encode_batch_fast([("" if self.spaced else " ").join(words)], add_special_tokens=False)[0]
        ids = np.array(whole.ids, dtype=self.dtype)
        edge = np.flatnonzero(self.edge[ids])
        cut = [*edge, len(ids)] if self.spaced else [0, *(edge + 1)]
        if len(cut) != len(words) + 1 or cut[0] or cut[-1] != len(ids):
            return self._many(words)
        raw, w = ids.tobytes(), self.dtype.itemsize
        cut = [w * int(c) for c in cut]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _drop(self) -> None:
        """Make room in the cache."""
        n = len(self.seen) - MOST + MOST // FRESH
        self.gone += n
        if self.gone >= MOST:
            self.seen.clear()
            self.gone = 0
        else:
            for _ in range(n):
                self.seen.popitem()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > MOST:
            self._drop()
        found = list(map(seen.get, pieces))
        words, whole = [], []  # unseen words and other parts
        plain = PLAIN[self.spaced].fullmatch
        for piece, x in zip(pieces, found):
            if x is None:
                (words if plain(piece) else whole).append(piece)
        for encoded, unseen in ((self._words, words), (self._many, whole)):
            for at in range(0, len(unseen), 1024):
                part = unseen[at:at + 1024]
                seen.update(zip(part, encoded(part)))
        return [seen[p] if x is None else x for p, x in zip(pieces, found)]

    def encoded(self, texts: pa.Array):
        """Yield (first text, binary array with the ids of each text) for about ``SLICE`` bytes of texts at a time, null as empty."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.searchsorted(np.cumsum(size), np.arange(SLICE, size.sum() + SLICE, SLICE), side="left") + 1
        cut = sorted({0, len(texts), *(int(c) for c in cut if c < len(texts))})
        for a, b in zip(cut, cut[1:]):
            yield a, self._slice(texts.slice(a, b - a))

    def encode(self, texts: pa.Array) -> pa.Array:
        """A binary array: the ids of each text, null as empty."""
        parts = [ids for _, ids in self.encoded(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _slice(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, ODD_SPACED if self.spaced else ODD_DROPPED)
        if pc.any(odd).as_py():
            rest = iter(self._slice(texts.filter(pc.invert(odd))).to_pylist())
            return pa.array([self._library([t])[0] if o else next(rest)
                             for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.binary())
        if self.spaced:
            words = pc.split_pattern(texts, " ")
        else:
            words = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        pieces, code, bound = _distinct(words)
        if self.spaced:  # all but a text's first piece begin with the space they were cut at
            own, where = np.unique(code[bound[:-1]], return_inverse=True)
            code = code.copy()
            code[bound[:-1]] = len(pieces) + where.ravel()
            pieces = pa.concat_arrays([pc.binary_join_element_wise(" ", pieces, ""), pieces.take(pa.array(own))])
        for pattern, cut in CUTS:
            pieces = pc.replace_substring_regex(pieces, pattern, cut)
        parts, part, ends = _distinct(pc.split_pattern(pieces, "\0"))
        ids = pa.array(self._ids(parts.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        return _joined(_joined(ids, part, ends), code, bound)


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder; it and its cache live as long as the Python worker."""
    if (path, spaced) not in _WORKER:
        _WORKER[path, spaced] = Encoder(path, spaced)
    return _WORKER[path, spaced]
