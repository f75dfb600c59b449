"""Splitting and encoding text with a public byte-level BPE vocabulary, on the executors.

Texts are not taken out of their Arrow arrays. Their UTF-8 bytes are cut, some megabytes
at a time and with numpy, where the vocabulary's own pattern cuts in any case:

- before white space that follows something else (no token holds both);
- behind white space other than the space itself (only a space joins what follows);
- before a mark that follows an ASCII letter or digit (letters, digits and marks are separate classes).

What lies between two cuts goes through Arrow's dictionary coding, each distinct piece
is looked up once in a bounded cache, or cut further by the pattern and encoded, and numpy lays the ids
out in the order of the texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Entries in each of the two generations of a cache; pieces longer than CACHE_BYTES are never kept.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 48
#: Bytes of texts that are encoded at once; a longer text is encoded by itself.
SLAB = 4 << 20

_MARK, _WORD, _SPACE = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORD
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def cuts(data: np.ndarray) -> np.ndarray:
    """True at the bytes before which no token goes on; the first byte is not told."""
    kind = _CLASS[data]
    rare = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(rare):
        tail = np.concatenate((data, np.zeros(2, np.uint8)))
        for space in _WIDE_SPACES:
            at = rare[data[rare] == space[0]]
            for i, byte in enumerate(space[1:], 1):
                at = at[tail[at + i] == byte]
            for i in range(len(space)):
                kind[at + i] = _SPACE
    out = np.zeros(len(data), bool)
    space = kind == _SPACE
    out[1:] = space[1:] & ~space[:-1]
    out[1:] |= space[:-1] & ~space[1:] & (data[:-1] != 32)
    out[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _WORD)
    return out


class PieceCache(dict):
    """piece (UTF-8) -> its ids as little-endian unsigned 32-bit integers; ``encode`` is asked for what is missing.

    When the cache is full, its content becomes the older generation, of which
    what is used again comes back; memory is bounded at two generations.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.decode())
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Texts to ids, given the ids of one match of the pattern."""

    def __init__(self, word: Callable[[str], bytes]):
        import regex
        from public_tokenizers import PATTERN

        self.split = regex.compile(PATTERN).findall
        self.word, self.cache = word, PieceCache(self._piece)

    def _piece(self, piece: str) -> bytes:
        if (piece[1:] if piece[:1] == " " else piece).isalpha():
            return self.word(piece)
        return b"".join(map(self.word, self.split(piece)))

    #: Texts that hold one of these are encoded by :meth:`whole`.
    added: tuple[str, ...] = ()

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other as unsigned 32-bit integers, the end of each text's); a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out, counts, i = [], np.zeros(len(texts), np.int64), 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(places, places[i] + SLAB, side="right")) - 1)
            part = whole[places[i] : places[j]]
            own = part.tobytes() if self.added else b""
            odd = {int(np.searchsorted(places[i + 1 : j + 1] - places[i], at, side="right")) + i for token in self.added for at in _found(own, token.encode())}
            at = i
            for k in [*sorted(odd), j]:  # the library's own tokens in a text are rare
                if k > at:
                    ids, ends = self._slab(whole[places[at] : places[k]], places[at : k + 1] - places[at])
                    out.append(ids)
                    counts[at:k] = np.diff(ends, prepend=0)
                if k < j:
                    out.append(np.frombuffer(self.whole(texts[k].as_py()), "<u4"))
                    counts[k] = len(out[-1])
                at = k + 1
            i = j
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.cumsum(counts)

    def _slab(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the end of each text's) of texts whose UTF-8 stands in ``data`` between ``places``."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(places) - 1, np.int64)
        new = cuts(data)
        new[places[:-1][places[:-1] < len(data)]] = True
        begin = np.flatnonzero(new)
        offsets = np.append(begin, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = words.indices.to_numpy()
        told = list(map(self.cache.__getitem__, words.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(told), "<u4")
        sizes = np.fromiter(map(len, told), np.int32, len(told)) >> 2
        counts = sizes[which]
        ends = np.cumsum(counts, dtype=np.int64)
        first = (np.cumsum(sizes, dtype=np.int64) - sizes)[which] - (ends - counts)
        ids = flat[np.repeat(first, counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(begin, places[1:])]


def _found(data: bytes, token: bytes) -> Iterator[int]:
    at = data.find(token)
    while at >= 0:
        yield at
        at = data.find(token, at + len(token))


class LibraryEncoder(PieceEncoder):
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library gives them.

    The library finds its added tokens (``<|endoftext|>``) in a text whatever this flag says; texts
    that hold such a string are encoded by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.largest_id = max(self.library.get_vocab(with_added_tokens=True).values())
        self.letters, self.tokenize = _byte_letters(), self.library.model.tokenize
        super().__init__(self._word)

    def _word(self, word: str) -> bytes:
        letters = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*printed}))}


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker and vocabulary file."""
    return LibraryEncoder(path)


def encoded_rows(batches, encoder: PieceEncoder, step: int = 2048) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, ends) of up to ``step`` rows at a time of Arrow batches with doc_id and text."""
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            doc_ids, texts = (part.column(part.schema.get_field_index(name)) for name in ("doc_id", "text"))
            yield doc_ids.to_pylist(), *encoder.encode_all(texts)
