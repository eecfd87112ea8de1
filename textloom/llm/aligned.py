"""Texts folded character by character, with the way back to offsets in the stored text."""

from __future__ import annotations

import re
import unicodedata

from textloom.llm.lookalike import _FOLD, _TO_LATIN, CharMap


def _plain(ch: str) -> str:
    """The plain form of a character, letters that look Latin as Latin ones; invisible characters become nothing."""
    return "".join(_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFC", _FOLD[ord(ch)]))


_ALIGNED = CharMap(_plain)
_PLAIN = re.compile("[^ -~\\n一-鿿、。「」『』《》〈〉ぁ-ヺー“”…]")


class Aligned:
    """``text`` folded for matching; ``at(i)`` is the offset in the stored text of folded character ``i``.

    Folding is by single characters, so sequences stay decomposed or composed as stored.
    """

    __slots__ = ("text", "_map")

    def __init__(self, stored: str):
        self._map = None
        self.text = stored
        if stored.isascii() or not _PLAIN.search(stored):
            return
        self.text = stored.translate(_ALIGNED)
        forms = {c: f for c in set(stored) if len(f := _ALIGNED[ord(c)]) != 1}
        if forms:
            self._map = [i for i, c in enumerate(stored) for _ in forms.get(c, c)]

    def at(self, i: int) -> int:
        return i if self._map is None else self._map[i]

    def end(self, i: int) -> int:
        """The stored end (exclusive) of a span whose folded end (exclusive) is ``i``."""
        return self.at(i - 1) + 1
