"""Cached encoding of texts cut where no token can cross.

In the byte-level pre-tokenisation pattern a blank can only open a match or lie in a run of white
space, so a text may be cut before every blank that a non-blank character follows. It may also be cut
between a letter or digit and the full stop or comma that ends a word, and around a line end between
characters. Each piece, seen alone, gives the matches that it gives inside the text. Words repeat, so
nearly all pieces are answered from a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Python's white space contains that of both tokenizer libraries, so the character after a cut is no white space for any of them.
_CUT = re.compile(r"(?= \S)")
#: A blank before white space or the end; the cuts at all blanks would be others.
_ODD = re.compile(r" (?!\S)")
#: A full stop or comma at a word's end that follows neither letter nor digit: it may belong to a longer run. A line end before white space.
_RUN = re.compile(r"[.,](?:(?<![^\W_][.,])[ \n]|\n(?!\S))")
_MARK = "\x00"


class PieceCache:
    """Maps pieces to the packed ids of their tokens; ``encode`` is asked for what is not cached.

    The cache has two generations of at most ``size`` pieces, so that what is used goes on living; max_chars
    bounds the pieces kept. Texts that hold ``whole`` (a special token may start so) are cut at blanks only.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = 400_000, max_chars: int = 48, whole: str = "<|"):
        self.encode, self.size, self.max_chars, self.whole = encode, size, max_chars, whole
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _marked(self, text: str) -> str:
        """The text with a mark at each cut."""
        if _ODD.search(text):
            return _CUT.sub(_MARK, text)
        if self.whole not in text and not _RUN.search(text):
            text = text.replace(", ", "\x00, ").replace(". ", "\x00. ").replace(".\n", "\x00.\x00\n\x00")
        return text.replace(" ", "\x00 ")

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if _MARK in text else self._marked(text).split(_MARK)

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of distinct pieces; those that no cache holds are encoded together."""
        out = list(map(self.new.get, pieces))
        if None in out:
            missing = [i for i, x in enumerate(out) if x is None]
            unknown = []
            for i in missing:
                out[i] = self.old.get(pieces[i])
                if out[i] is None:
                    unknown.append(i)
            for i, v in zip(unknown, self.encode([pieces[i] for i in unknown]) if unknown else ()):
                out[i] = v
            if len(self.new) + len(missing) > self.size:
                self.new, self.old = {"": b""}, self.new
            most = self.max_chars
            self.new.update((pieces[i], out[i]) for i in missing if len(pieces[i]) <= most)
        return out

    def pack(self, text: str) -> bytes:
        return self.pack_all([text])[0]

    def pack_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. Arrow cuts the texts and finds the distinct pieces, so that each is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(["" if _MARK in t else self._marked(t) for t in texts], pa.large_string()), _MARK)
        coded = split.values.dictionary_encode()
        ids = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        out = [bytes(raw[a:b]) for a, b in zip(at, at[1:])]
        for i, t in enumerate(texts):
            if _MARK in t:  # the mark itself: cut without marks
                pieces = _CUT.split(t)
                found = dict(zip(own := list(dict.fromkeys(pieces)), self.lookup(own)))
                out[i] = b"".join([found[p] for p in pieces])
        return out
