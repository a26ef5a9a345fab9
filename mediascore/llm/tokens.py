"""Exact tokenisation of whole texts through a cache of text segments.

A byte-pair tokenizer first splits a text into pretokens and then encodes each
pretoken by itself, so a text may be cut wherever a pretoken is sure to begin
and the parts' ids joined.  The cuts used here are at ASCII white space (for
the byte-level tokenizer: before a single space that a word follows) and
between a Latin letter and a following run of ASCII punctuation.  Every part
is encoded by the tokenizers library once and kept; words repeat, so most of a
text is a lookup.  A text with any other white space, or with the string of a
special token, is encoded whole by the library.  Where white space is dropped,
whole columns are cut, looked up and joined by Arrow, and Python sees the words
that are not kept yet.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space and separators beyond the six ASCII ones: such texts are encoded whole.
_ODD = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_ODD_ASCII = "\x00\x1c\x1d\x1e\x1f"
#: A space before other white space is not the space of a word.
_RUNS = ("  ", " \t", " \n", " \r", " \x0b", " \x0c")
#: A run of white space up to the last character before a word; a word with the one space before it; a lone white space.
_SPACED = re.compile("[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])| ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]")
#: The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}
_MARKS = ".,;:!?%&$#*|)"


def _odd(text: str) -> bool:
    """Whether a text has to be encoded whole."""
    if "<|" in text:
        return True
    return any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text) is not None


def _ends_in_letter(part: str) -> bool:
    last = part[-1]
    return "a" <= last <= "z" or "A" <= last <= "Z" or "\xc0" <= last <= "\xff" and last not in "\xd7\xf7"


class _Words(dict):
    """Ids of the parts that follow a space, by the part without it."""

    def __init__(self, encoder: SegmentEncoder):
        super().__init__()
        self.encoder = encoder
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.encoder.fresh(" " + word)
            else:
                # words with marks or line ends are many and rare: their parts are kept, not they
                head = word.rstrip(_MARKS)
                if head != word and head and head.isalpha() and _ends_in_letter(head):
                    return self[head] + self.encoder[word[len(head) :]]
                parts = _SPACED.findall(" " + word)
                if len(parts) > 1:
                    return self[parts[0][1:]] + b"".join(map(self.encoder.__getitem__, parts[1:])) if len(parts[0]) > 1 else b"".join(map(self.encoder.__getitem__, parts))
                ids = self.encoder.fresh(" " + word)
        self[word] = ids
        return ids


class SegmentEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; as a dict, the
    ids of parts.

    ``path``: a tokenizer file of the tokenizers library.  ``spaced``: whether
    its pretokens carry the space before a word (byte-level) or white space is
    dropped.  ``keep``: parts held in each of two cache generations, which
    bounds the memory; parts that fall out are encoded anew.
    """

    def __init__(self, path: str, spaced: bool, keep: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.bytes = spaced and self.tokenizer.normalizer is None
        # without odd white space, str.split cuts at the six ASCII ones only
        self.split = _SPACED.findall if spaced else str.split
        self.keep = keep
        self.old: dict[str, bytes] = {}
        self.words = _Words(self)

    def _library(self, part: str) -> bytes:
        """Ids of any text."""
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def fresh(self, part: str) -> bytes:
        """Ids of a part that is not kept yet."""
        head = part.rstrip(_MARKS)
        if head is not part and head and head != part and _ends_in_letter(head):
            return self[head] + self[part[len(head) :]]
        letters = part[1:] if part[0] == " " else part
        if self.bytes and letters.isalpha() and not letters.isascii() and max(letters) < "\u0180":
            # one pretoken of Latin letters, its bytes as the characters that stand for them
            return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        if not self.spaced and part.isalpha() and not part.isascii() and max(part) < "\u0180" and "\u0130" not in part:
            # the same, in lower case; the capital I with a dot becomes two characters
            return array("I", [t.id for t in self.model.tokenize(part.lower().encode().decode("latin-1").translate(_BYTES))]).tobytes()
        if letters.isascii() and letters.isalpha():
            # one pretoken of ASCII letters, with or without the space before it
            word = "Ġ" + letters if letters is not part else part if self.spaced else part.lower()
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return self._library(part)

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.fresh(part)
        self[part] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        out = []
        ids, after_space = self.__getitem__, self.words.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif _odd(text):
                out.append(self._library(text))
            elif not self.spaced or text[-1] == " " or any(r in text for r in _RUNS):
                out.append(b"".join(map(ids, self.split(text))))
            else:
                # every space begins a word
                first, *words = text.split(" ")
                head = b"".join(map(ids, self.split(first)))
                out.append(head + b"".join(map(after_space, words)))
            if len(self) + len(self.words) > self.keep:
                for kept in (self, self.words):
                    kept.old = dict(kept)
                    kept.clear()
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow column; a null text is empty."""
        for k in range(0, len(texts), 256):
            yield from self.encode(texts.slice(k, 256).to_pylist())


class WordEncoder(SegmentEncoder):
    """Ids of Arrow columns of text, for a tokenizer that drops white space.

    A column's distinct words are found by Arrow and looked up at once in the
    kept words, two Arrow columns with the last used first; the ids are taken
    for all words from there.  ``keep``: words held from column to column, each
    of ``LONGEST`` bytes at most, which bounds the memory.
    """

    LONGEST = 64

    def __init__(self, path: str, keep: int = 400_000):
        super().__init__(path, False)
        self.most = keep
        self.kept_words = pa.array([], pa.string())
        self.kept_ids = pa.array([], pa.large_binary())

    def _new_ids(self, words: list[str]) -> pa.Array:
        """The ids of words that are not kept; the dictionary holds them and their parts for a while."""
        ids = pa.array([self[w] if w else b"" for w in words], pa.large_binary())
        self.clear()
        return ids

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, which are kept before those of earlier columns."""
        at = pc.index_in(words, value_set=self.kept_words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        unknown = words.filter(pa.array(new))
        ids = [self._new_ids(unknown.slice(k, 50_000).to_pylist()) for k in range(0, len(unknown), 50_000)]
        at = at.fill_null(0).to_numpy().astype(np.int64)
        unused = np.ones(len(self.kept_words), bool)
        unused[at[~new]] = False
        at[new] = len(self.kept_words) + np.arange(len(unknown))
        found = pa.concat_arrays([self.kept_ids, *ids]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(words), self.LONGEST)
        rest = pa.array(np.flatnonzero(unused)[: self.most])
        self.kept_words = pa.concat_arrays([words.filter(short), self.kept_words.take(rest)])[: self.most]
        self.kept_ids = pa.concat_arrays([found.filter(short), self.kept_ids.take(rest)])[: self.most]
        return found

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        strings = ((k, text.as_py()) for k, text in enumerate(texts))
        whole = {k: self._library(text) for k, text in strings if text and _odd(text)}
        empty = texts.is_null().to_numpy(zero_copy_only=False).copy()
        empty[list(whole)] = True
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(empty), "", texts.cast(pa.string())))
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        del words  # as large as the texts
        ids = self._ids_of(coded.dictionary).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[bounds].tolist()
        data = memoryview(data)
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            yield whole.get(k) or bytes(data[a:b])


_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder(path: str, spaced: bool) -> SegmentEncoder:
    """The process's encoder for a tokenizer file: Python workers serve many tasks."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentEncoder(path, True) if spaced else WordEncoder(path)
    return _ENCODERS[key]
