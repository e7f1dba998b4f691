"""Token ids of whole texts, with every distinct word encoded once per worker.

The pre-tokenizers of both vocabularies never let a token cross from a visible
character to a following blank, nor from a letter to a following ASCII sign other
than a digit or an apostrophe, so a text is the concatenation of the units cut there. The texts of a slice
are cut together as one Arrow array, whose dictionary holds the distinct units. Units
met before come from a table; the new ones of a slice are encoded with few calls of
the tokenizers library. Plain words go to the same model without the steps that find
words. Texts with other white space than blanks and line feeds, or with the string of
an added token, which the library turns into that token, go to the library as they are.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa

# Units a worker learns before its table becomes the old one, which is asked next and then dropped.
MAX_WORDS = 200_000
# Bytes of texts worth cutting at once: few enough for a task, enough for most units to recur.
TEXT_BYTES = 4 << 20


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        if self.library.normalizer and any(token.normalized for token in added):
            self.added = [""]  # looked for in normalized text: every text goes as it is
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.drops_blanks = ids("a b") == ids("a") + ids("b")
        self.lowers = ids("A") == ids("a")
        mark = "\x01" if self.drops_blanks else "\n"
        self.mark, self.mark_ids = (f" {mark} " if self.drops_blanks else mark), ids(mark)
        self.dtype = np.uint16 if self.library.get_vocab_size() < 1 << 16 else np.uint32
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        names = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        # Bytes of a plain word that each id stands for.
        self.spans = np.array([len((name or "").removesuffix(suffix)) for name in names], np.int64)
        self.is_word = (_LOOSE_WORD if self.drops_blanks else _WORD).fullmatch
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        tried = [" the", "qzx", " Übermaß", "éàÿ", "Ab"]
        self._learn_words(tried)
        if any(self.words.get(w) != np.array(ids(w), self.dtype).tobytes() for w in tried):
            self.is_word = lambda word: None  # not a byte-level vocabulary
            self.words = {}

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def of(path: str) -> WordEncoder:
        return WordEncoder(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without special tokens at its ends."""
        return [np.frombuffer(raw, self.dtype) for raw in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of an array of ``dtype``."""
        if len(self.words) > MAX_WORDS:
            self.old, self.words = self.words, {}
        plain = [self._plain(text) for text in texts]
        found = iter(self._joined([raw for raw in plain if raw is not None]))
        return [
            np.array(self._batch([text])[0], dtype=self.dtype).tobytes() if raw is None else next(found)
            for text, raw in zip(texts, plain)
        ]

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that may be cut, as bytes."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        edges = _edges(np.frombuffer(data := b"".join(texts), np.uint8), ends)
        offsets = pa.py_buffer(edges.astype(np.int32))
        units = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, offsets, pa.py_buffer(data)])
        units = units.dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._learned(distinct), pa.large_binary()).take(units.indices)
        _, at, raw = ids.buffers()
        at = np.frombuffer(at, np.int64) if len(ids) else np.zeros(1, np.int64)
        last = at[np.searchsorted(edges, ends)].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip([0, *last], last)] if len(ids) else [b""] * len(texts)

    def units(self, units: Collection[str]) -> list[bytes]:
        """Ids of each unit by itself, as the bytes of an array of ``dtype``; none holds white space."""
        if len(self.words) > MAX_WORDS:
            self.old, self.words = self.words, {}
        return self._learned(list(units))

    def _plain(self, text: str) -> bytes | None:
        """The text as bytes that may be cut, or None if it goes to the library as it is."""
        lowered = text.lower() if self.lowers and _latin(text) else text
        # Lowering may make such a string, which the library sees only where it stands in the text.
        if _other_blanks(text) or any(token in text or token in lowered for token in self.added):
            return None
        return lowered.encode()

    def _learned(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        found = list(map(self.words.get, units))
        new = [unit for unit, raw in zip(units, found) if raw is None]
        if not new:
            return found
        self._learn(new)
        learned = map(self.words.__getitem__, new)
        return [next(learned) if raw is None else raw for raw in found]

    def _learn(self, new: list[str]) -> None:
        known, old = self.words, self.old
        if old:
            known.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in known]
        plain = [w for w in new if self.is_word(w)]
        ascii_words = [w for w in plain if w.isascii()]
        self._learn_words(ascii_words)
        if len(ascii_words) < len(plain):
            self._learn_words([w for w in plain if not w.isascii()])
        rest = [w for w in new if w not in known]
        if self.drops_blanks:
            joined = [w for w in rest if "\x01" not in w]
        else:
            joined = [w for w in rest if "\n" not in w and w[:2] != "  " and w != " "]
        if joined:
            text = self.mark + self.mark.join(joined)
            self._put(joined, self._batch([text])[0], self.mark_ids)
        apart = [w for w in rest if w not in known]
        for word, ids in zip(apart, self._batch(apart)):
            known[word] = np.array(ids, dtype=self.dtype).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Encode words of Latin letters, written in the alphabet that stands for their bytes."""
        if not words:
            return
        text = "\n".join([w.lstrip(" \n") for w in words] if self.drops_blanks else words)
        if self.lowers:
            text = text.lower()
        if not text.isascii():
            text = text.translate(_AS_BYTES)
        text = text.replace(" ", _ALPHABET[32])
        ids = np.array(self._batch([text], self.bare)[0], dtype=self.dtype)
        # A word ends where as many bytes are passed as it and those before it hold.
        sizes = text.split("\n")
        ends, passed = np.cumsum(np.fromiter(map(len, sizes), np.int64, len(words))), np.cumsum(self.spans[ids])
        last = np.searchsorted(passed, ends)
        if len(passed) and passed[-1] == ends[-1] and (passed[last] == ends).all():
            raw, cuts = ids.tobytes(), ((last + 1) * ids.itemsize).tolist()
            self.words.update(zip(words, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def _put(self, words: list[str], found: list[int], mark: list[int]) -> None:
        """Cut ids at the marks before each word; nothing is learned if the marks do not show."""
        ids = np.array(found, dtype=self.dtype)
        cuts = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else ids[:0]
        if len(cuts) == len(words):
            raw, width = ids.tobytes(), ids.itemsize
            spans = map(slice, ((cuts + 1) * width).tolist(), (cuts[1:] * width).tolist() + [len(raw)])
            self.words.update(zip(words, map(raw.__getitem__, spans)))

    def _batch(self, texts: list[str], library=None) -> list[list[int]]:
        found = (library or self.library).encode_batch_fast(texts, add_special_tokens=False)
        return [x.ids for x in found]


def _byte_alphabet() -> list[str]:
    """Signs for the 256 bytes in byte-level vocabularies: printable ones stand for themselves,
    the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_ALPHABET = _byte_alphabet()
# Latin letters beyond ASCII as the signs of their bytes.
_AS_BYTES = {c: "".join(_ALPHABET[b] for b in chr(c).encode()) for c in range(192, 256)}


# Signs that no token holds together with a letter before them.
_STOPS = np.zeros(256, bool)
_STOPS[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = True


def _edges(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places between the units of texts laid end to end, 0 and the end included."""
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    if len(data):
        blank = (data == 32) | (data == 10)
        stop = _STOPS[data[1:]]
        before = data[:-1]
        letter = ((before | 32) - np.uint8(97)) < 26
        edge[1:-1] = (blank[1:] > blank[:-1]) | (stop & letter)
        # A single line feed stands apart from the visible signs around it.
        edge[2:-1] |= (data[1:-1] == 10) & ~blank[:-2] & ~blank[2:]
        # Letters from \u00c0 to \u00ff are two bytes, the first of them 0xc3.
        wide = np.flatnonzero(stop & (before >= 128))
        wide = wide[(data[wide - 1] == 0xC3) & (data[wide] != 0x97) & (data[wide] != 0xB7)]
        edge[wide + 1] = True
        edge[ends] = True
    return np.flatnonzero(edge)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LOOSE_WORD = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ASCII_BLANKS = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f]").search
_OTHER_BLANKS = re.compile(r"[^\S \n]").search


def _other_blanks(text: str) -> bool:
    return bool(_ASCII_BLANKS(text) if text.isascii() else _OTHER_BLANKS(text))
