"""Encoding each distinct piece of a text once.

Byte-level BPE never merges over the start of a pre-token, and a space between
two characters that are no white space always starts one.  So texts are cut at
such spaces, and a task encodes each distinct piece once; punctuation after a
letter or digit starts a pre-token too and is cut off: a stop or comma in all
texts, other marks from pieces that are new.  So is a line feed between
characters that are no white space.
Texts in which some space is followed by white space, or that end in a space or
hold a zero byte, are rare: there a run of white space is cut by what follows it, and the text is
encoded as one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Longer pieces are not kept, so that a piece and its ids take 200 bytes, and 850 at most.
LONGEST = 64
#: Distinct pieces that a worker keeps the ids of in a generation; it has two.
KEPT = 220_000
_odd_space = re.compile(r" (?:\s|\Z)").search
_lines = re.compile(r"\S+(?:\n\S+)+\Z").match
_odd_line = re.compile(r"\n(?:(?<=\s\n)|(?<=\A\n)|(?=\s|\Z))").search
_stops = re.compile(r"[.,](?<=[^\W_][.,])(?= |\Z)").sub
_END = "\0"  # before an end of a word that is a piece of its own
_tail = ".,;:!?%$&*#|)\"'"


class PieceEncoder:
    """``encode(text)`` joins the encodings of pieces, which ``encode_many`` makes for a list of texts.

    A line feed between characters that are no white space is a pre-token, too, so pieces with some
    are joined from lines; later lines, like the first piece of a text, have no space before them.
    Pieces are kept in two generations: a full one becomes the old one, from which pieces that
    occur again come back.  A generation is full at ``most`` pieces; first pieces and ends have an
    eighth of that each.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = KEPT) -> None:
        self.encode_many = encode_many
        self.most = most
        self.kept: dict[str, bytes] = {}  # of a piece without the space before it
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.bare: dict[str, bytes] = {}  # of a piece with no space before it

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _odd_space(text) or _END in text:
            return self.encode_many([text])[0]
        if "\n" in text and not _odd_line(text):
            text = text.replace("\n", " \n")  # a piece that starts with a line feed
        text = _stops(r" \0\g<0>", text)
        first, *pieces = text.split(" ")
        if len(self.kept) > self.most:
            self.old, self.kept = self.kept, {}
        new = set(pieces).difference(self.kept)
        if new:
            self._learn(new)
        ids = self._first(first) + b"".join(map(self.kept.__getitem__, pieces))
        if new and len(max(new, key=len)) > LONGEST:
            for piece in new:
                if len(piece) > LONGEST:
                    del self.kept[piece]
        return ids

    def _first(self, piece: str) -> bytes:
        if not piece:
            return b""
        if _lines(piece):
            return self._tail("\n").join(map(self._first, piece.split("\n")))
        if piece not in self.bare:
            if len(self.bare) > self.most // 8:
                self.bare = {}
            core = piece.rstrip(_tail)
            cut = len(core) < len(piece) and core and core[-1].isalnum()
            ids = self.encode_many([core])[0] + self._tail(piece[len(core) :]) if cut else self.encode_many([piece])[0]
            if len(piece) > LONGEST:
                return ids
            self.bare[piece] = ids
        return self.bare[piece]

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            ids = self.encode_many([marks])[0]
            if len(marks) > LONGEST:
                return ids
            if len(self.tails) > self.most // 8:
                self.tails = {"": b""}
            self.tails[marks] = ids
        return self.tails[marks]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, a space before each."""
        return self.encode_many([" " + w for w in words])

    def _learn(self, new: set[str]) -> None:
        """Fill ``kept`` for pieces that it lacks."""
        kept, old = self.kept, self.old
        if old and (again := new & old.keys()):
            for piece in again:
                kept[piece] = old[piece]
            new = new - again
        cut: list[tuple[str, str, str]] = []
        words, others, lines = [], [], []
        for piece in new:
            if piece.isalpha():
                words.append(piece)
                continue
            if piece[0] == _END:
                kept[piece] = self._tail(piece[1:])
                continue
            if piece[0] == "\n":
                kept[piece] = self._tail("\n") + self._first(piece[1:])
                continue
            core = piece.rstrip(_tail)
            if "\n" in piece and _lines(piece):
                lines.append(piece)
                core = piece[: piece.index("\n")]
            elif len(core) == len(piece) or not core or not core[-1].isalnum():
                others.append(piece)
                continue
            else:
                cut.append((piece, core, piece[len(core) :]))
            if core not in kept and core not in new:
                if core in old:
                    kept[core] = old[core]
                else:
                    kept[core] = b""
                    (words if core.isalpha() else others).append(core)
        if words:
            kept.update(zip(words, self.encode_words(words), strict=True))
        if others:
            kept.update(zip(others, self.encode_many([" " + p for p in others]), strict=True))
        for piece, core, tail in cut:
            kept[piece] = kept[core] + self._tail(tail)
        feed = self._tail("\n") if lines else b""
        for piece in lines:
            first, *rest = piece.split("\n")
            kept[piece] = feed.join([kept[first], *map(self._first, rest)])
