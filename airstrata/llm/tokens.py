"""Token ids of a public byte-level vocabulary, by the tokenizers library, within Arrow batches.

A byte-level vocabulary never merges across the start of a run of white space that follows something else, nor between
a letter or digit and a comma or full stop after it. Texts are cut there; each distinct chunk is encoded once for each
worker and its ids are kept. Texts with white space beyond ASCII, where runs of different kinds can meet, are encoded
whole. The ids are those of encoding each text in one call.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import public_tokenizers

from .common import WS

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Chunks kept in a worker; beyond it the store is emptied and fills again.
MOST_CHUNKS = 1_000_000
#: New chunks that are encoded as one text.
_JOINED = 64
_S = r" \t\n\r\x0b\x0c"
#: Latin letters and digits, after which a comma or a full stop always starts a piece.
_PLAIN = "A-Za-z0-9" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
#: Nothing is ever given back in a match, so that each character is looked at once.
_CHUNK = re.compile(rf"[{_S}]*+(?:[^{_S}.,]++(?:(?![.,])|(?<=[{_PLAIN}])|[^{_S}]*+)|[.,][^{_S}]*+)|[{_S}]++")
#: Separators and other white space beyond ASCII.
_ODD_CODES = [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        sizes = self.tokenizer.get_vocab()
        #: Bytes of each id's piece: a byte-level vocabulary writes each as one character.
        self.width = np.zeros(max(sizes.values()) + 1, np.int64)
        self.width[list(sizes.values())] = list(map(len, sizes))

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that start a run of white space and do not end in one: many are encoded as one text, which
        is told apart by the bytes of its ids. Where an id would reach over the end of a chunk, each is encoded alone."""
        own = self.direct(["".join(chunks[at : at + _JOINED]) for at in range(0, len(chunks), _JOINED)])
        data = b"".join(own)
        upto = np.cumsum(self.width[np.frombuffer(data, "<u4")])
        ends = np.cumsum(list(map(len, map(str.encode, chunks))))
        stops = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[stops] != ends).any():
            return self.direct(chunks)
        stops = ((stops + 1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if _ODD.search(t) else _CHUNK.findall(t) for t in texts]
        if len(self.known) > MOST_CHUNKS:
            self.known = {}
        known, new, out = self.known, set(), []
        for c in cut:
            codes = None if c is None else list(map(known.get, c))
            if codes and None in codes:
                new.update(compress(c, map(not_, codes)))
                codes = None
            out.append(None if codes is None else b"".join(codes))
        plain = [c for c in new if c[0] in WS and c[-1] not in WS]
        for some, ids_of in ((plain, self.joined), (list(new.difference(plain)), self.direct)):
            for at in range(0, len(some), 4096):
                known.update(zip(some[at : at + 4096], ids_of(some[at : at + 4096])))
        return [o if o is not None else self.direct([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c, o in zip(texts, cut, out)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each worker and file; the public one where no path is given, found on the worker's own machine."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: Iterable[str | None], bytes_at_once: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in lists of bounded size, one text at least; null is the empty text."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= bytes_at_once:
            yield held
            held, size = [], 0
    if held:
        yield held
