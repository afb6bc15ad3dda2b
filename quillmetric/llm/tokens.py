"""Byte-level BPE ids by the tokenizers library, with the work shared between equal words.

A text is cut before every space that another visible character follows. The tokenizer's own splitting pattern always
has a boundary there, so the ids of a text are the ids of its chunks in a row. Chunks recur; the ids of recent
ones are kept in a bounded table per Python worker. A chunk with marks or a line break is put together from its words,
so that the model meets a word once, whatever marks follow it. Chunks and texts where the argument does not hold (runs of white space, control
characters, letters outside the Latin blocks, added tokens such as ``<|endoftext|>``) go through ``Tokenizer.encode`` as they are.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
KEPT_CHUNKS = 500_000
KEPT_WORDS = 50_000
LONGEST_KEPT = 64

# the letters, numbers and white space of plain chunks; ASCII marks that begin no contraction
_L, _N, _S, _M = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\n\t\r\x20", r"!-&(-/:-@\[-`{-~"

#: Fixed value: the splitting pattern of the byte-level vocabulary, for plain chunks.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

# chunks in which all pattern libraries agree on letters, digits and white space
_PLAIN_CHUNK = re.compile(r"[\n\t\r\x20-\x7e\xa1-ɏ]*\Z")
_PLAIN_WORD = re.compile(rf"[{_L}]+\Z")
_MARKED_WORDS = re.compile(rf"([{_L}]+)([{_M}]*)(?:\n([{_L}]+)([{_M}]*))?\Z")
_WORDS = re.compile(SPLIT)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _RunOfBlanks(Exception):
    """White space follows a blank, or nothing does: the text cannot be cut there."""


class Recent(dict):
    """Results of a function of a string, for the strings met of late: two generations of at most ``limit`` each."""

    def __init__(self, function, limit: int) -> None:
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit values, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.alphabet = self._byte_alphabet()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.chunks = Recent(self._after_blank, kept)
        self.words = Recent(self._word, KEPT_WORDS)

    @staticmethod
    def _byte_alphabet() -> str:
        """The printable letters that stand for the bytes of plain text, in the order of the bytes, learnt from the library's own
        pre-tokenizer. Other bytes have a letter that cannot be decoded."""
        splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {}
        for code in range(0x80):
            letters[code] = splitter.pre_tokenize_str(chr(code))[0][0]
        for code in range(0x80, 0x800):
            for byte, letter in zip(chr(code).encode(), splitter.pre_tokenize_str(chr(code))[0][0]):
                letters[byte] = letter
        return "".join(letters.get(byte, "\ufffe") for byte in range(256))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.model.tokenize(charmap_decode(word.encode(), "strict", self.alphabet)[0])])

    def _after_blank(self, chunk: str) -> bytes:
        """Ids of a blank and what follows it up to the next blank."""
        if chunk.isalpha() and (chunk.isascii() or _PLAIN_WORD.match(chunk)):
            return self._word(" " + chunk)
        marked = _MARKED_WORDS.match(chunk)
        if marked:
            word, marks, line, line_marks = marked.groups()
            ids, words = self.chunks[word], self.words
            if marks:
                ids += words[marks]
            if line:
                ids += words["\n"] + words[line]
                if line_marks:
                    ids += words[line_marks]
            return ids
        if not chunk or chunk[0].isspace():
            raise _RunOfBlanks
        return self._any(" " + chunk)

    def _any(self, chunk: str) -> bytes:
        if _PLAIN_CHUNK.match(chunk):
            chunks, words = self.chunks, self.words
            return b"".join([chunks[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w] for w in _WORDS.findall(chunk)])
        return self._whole(chunk)

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._whole(text)
        first, *chunks = text.split(" ")
        try:
            return self._any(first) + b"".join(map(self.chunks.__getitem__, chunks))
        except _RunOfBlanks:
            return self._whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
