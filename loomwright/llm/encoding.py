"""Token ids through the tokenizers library, with a memo of pieces that encode alone.

Both vocabularies split a text into pieces before their merges, and no piece spans the places used here to cut: for the
lower-casing word vocabulary every white space (it is dropped), for the byte-level one a single space or line feed
between two other characters (the space goes with what follows; texts with any other white space are not cut). So a text's ids are its pieces' ids in order, and each
distinct piece is encoded once a worker. A piece of plain Latin letters (and a run of ASCII punctuation behind it) is one
unit (or two) of that split and goes to the library's merge model at once; every other piece goes through the whole
tokenizer. Tests compare the results with the library's on whole texts.

``encode_array`` does so for a batch of texts at once: the pieces are slices of their bytes, and each distinct one is looked
up once a batch.

The library reads the string of a special token in a text as that token; such a text goes to it whole.
``specials_as_text`` takes these strings for ordinary text instead.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

from .common import CACHES, enter

#: Pieces remembered a worker (about 230 bytes each; when it is full, the first met half stays, so all frequent ones), and
#: the longest piece that is remembered.
MEMO, LONGEST = 600_000, 48
#: White space, or what Python alone takes for it when it splits.
_WHITE = re.compile(r"[\s\x1c-\x1f]")
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ENDS = frozenset(",.;:!?")


class _Whole(Exception):
    """A text that can't be cut, for some white space or a special token in it."""


class _Memo(dict):
    """Ids of pieces; ``lead`` stands before each (a space, or nothing)."""

    def __init__(self, lib, lead: str, lower: bool, limit: int) -> None:
        super().__init__()
        self.limit = limit
        self.lib, self.model, self.lead, self.lower = lib, lib.model, lead, lower
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.mark = lead.translate(self.letters)
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.ids(piece)
        return self._keep(piece, out) if len(piece) <= LONGEST else out

    def ids(self, piece: str) -> bytes:
        if len(piece) <= LONGEST and piece.isascii():  # the most frequent forms, without the pattern
            if piece.isalpha():
                return self._word(piece)
            if piece[-1:] in _ENDS and (head := piece[:-1]).isalpha():
                return self[head] + self._tail(piece[-1])
        plain = _PLAIN.fullmatch(piece) if len(piece) <= LONGEST else None
        if plain is None:
            if not piece or _WHITE.search(piece):
                raise _Whole
            return self.whole(self.lead + piece)
        if marks := plain[2]:
            return self[plain[1]] + self._tail(marks)
        return self._word(piece)

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters: one unit of the split, in the letters that stand for its bytes."""
        if self.lower:
            word = word.lower()
        mapped = self.mark + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self.whole(marks)
        return self.tails[marks]

    def _keep(self, piece: str, out: bytes) -> bytes:
        if len(self) >= self.limit:
            core = list(islice(self.items(), self.limit // 2))
            self.clear()
            self.update(core)
        self[piece] = out
        return out


class _Units(_Memo):
    """Ids of pieces that begin with their space, where they have one; None for those that can't be cut."""

    def __init__(self, first: _Memo, after: _Memo) -> None:
        super().__init__(after.lib, "", False, after.limit)
        self.first, self.after, self.tokenize, self.mark = first, after, after.model.tokenize, after.mark

    def __missing__(self, piece: str) -> bytes | None:
        word = piece[1:]
        if piece[0] != " ":
            out = self._try(self.first, piece)
        elif word.isascii() and word.isalpha() and len(word) <= LONGEST:
            out = array("I", [t.id for t in self.tokenize(self.mark + word)]).tobytes()
        else:
            out = self._try(self.after, word)
        return self._keep(piece, out) if len(word) <= LONGEST else out

    def _try(self, memo: _Memo, piece: str) -> bytes | None:
        if piece == "\n":
            return self.whole(piece)
        try:
            return memo.ids(piece)
        except _Whole:
            return None


#: Letters, and marks before which a word ends.
_LETTERS, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS[[ord(c) for c in _ENDS]] = True


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, spaces_matter: bool, memo: int = MEMO, specials_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = specials_as_text
        self.specials = () if specials_as_text else tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.spaces_matter = spaces_matter
        self.first = _Memo(self.lib, "", lower=not spaces_matter, limit=memo)
        self.after = _Memo(self.lib, " ", lower=False, limit=memo)
        self.units = _Units(self.first, self.after)
        self.line_feed = self.first.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            if any(s in text for s in self.specials):
                raise _Whole
            if not self.spaces_matter:
                if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python splits there, the vocabulary doesn't
                    raise _Whole
                return b"".join(map(self.first.__getitem__, text.split()))
            out, after = [], self.after.__getitem__
            for line in text.split("\n"):
                words = iter(line.split(" "))
                out.append(self.first[next(words)])
                out.extend(map(after, words))
                out.append(self.line_feed)
            out.pop()
            return b"".join(out)
        except _Whole:
            return self.whole(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def encode_array(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Lists of ids, ``end_id`` behind each, of a string array without nulls.

        The cuts of ``encode``, and those between a letter and a mark behind it, are found in the bytes of all texts at once.
        Each distinct piece (with the space before it) is looked up once.
        """
        if not self.spaces_matter:
            end, ids = np.int32(end_id), [np.frombuffer(x, np.int32) for x in self.encode_many(texts.to_pylist())]
            counts = [len(x) + 1 for x in ids]
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *[np.append(x, end) for x in ids]])))
        bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds.astype(np.int64) - bounds[0]
        filled = bounds[1:] > bounds[:-1]
        heads, lasts = bounds[:-1][filled], bounds[1:][filled] - 1
        feeds = data == 10
        white = feeds | (data == 32)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = white
        cut[1:] |= feeds
        cut[1:-1] |= _LETTERS[data[:-1]] & _MARKS[data[1:]]
        cut[bounds] = True
        # Texts with white space at an end or beside another one, or with the string of a special token, go to the library whole.
        odd = np.zeros(len(data), bool)
        odd[:-1] = white[:-1] & white[1:]
        odd[heads] |= white[heads]
        odd[lasts] |= white[lasts]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        if any(data.tobytes().find(x.encode()) >= 0 for x in self.specials):
            whole |= [any(x in t for x in self.specials) for t in texts.to_pylist()]
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        found = list(map(self.units.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        which = pieces.indices.to_numpy()
        if None in found:
            refused = np.array([x is None for x in found], bool)
            whole[np.searchsorted(bounds, at[:-1][refused[which]], "right") - 1] = True
            found = [x or b"" for x in found]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(found))]))
        flat = lists.take(pieces.indices).flatten().to_numpy()
        starts = np.append(0, np.cumsum(sizes[which], dtype=np.int64))[np.searchsorted(at, bounds)]
        counts, out, done = np.diff(starts) + 1, [np.zeros(0, np.int32)], 0
        for k in np.flatnonzero(whole).tolist():
            ids = np.frombuffer(self.whole(texts[k].as_py()), np.int32)
            out += [_ended(flat, starts[done : k + 1], end_id), np.append(ids, np.int32(end_id))]
            counts[k], done = len(ids) + 1, k + 1
        out.append(_ended(flat, starts[done:], end_id))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate(out)))


def _ended(flat: np.ndarray, starts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of texts that follow one another, the end id behind each."""
    return np.insert(flat[starts[0] : starts[-1]], starts[1:] - starts[0], np.int32(end_id))


@lru_cache(maxsize=1)
def _encoder(path: str, spaces_matter: bool, memo: int, specials_as_text: bool) -> Encoder:
    return Encoder(path, spaces_matter, memo, specials_as_text)


def encoder(path: str, spaces_matter: bool, memo: int = MEMO, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder; another vocabulary takes its place."""
    enter("encoding")
    return _encoder(path, spaces_matter, memo, specials_as_text)


CACHES.append(("encoding", _encoder.cache_clear))
