"""Byte-pair encoding by a tokenization automaton, compiled from the rank file of a public tokenizer.

The automaton reads tokens: its paths are exactly the token sequences that the merges
make of some text, one for each text. It starts with one state that every byte leads
back to. The merge ``u v -> w`` adds a gadget: the state that ``u`` leads to is split, ``u`` leads to the
part that ``v`` no longer leaves, and wherever an arc ``u`` leaves, an arc ``w`` is
laid to where ``v`` led.

Where an arc leads depends on its label alone, so a table by token holds it. A split state differs from
the one it came of by the arcs it has lost: ``v``, the arcs laid for tokens that begin with ``v`` since, and those that
would be laid later. Arcs are numbered along the tree of tokens and the tokens that begin with them, the
latest first, which makes what one split takes away a range of numbers. A state's row is the list of its
ranges, so some 15,000 states of 50,000 arcs take a few megabytes.

A second table, of byte transitions, holds the labels of all arcs. A pre-split word is
encoded by following both tables from each place that is reached: an arc whose label stands there and that the state's row does not exclude
leads to the place after it. The automaton is deterministic, so each place is reached by one arc at most and the arcs back from the word's
end are its tokens. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_right
from itertools import accumulate
from pathlib import Path

import numpy as np
import regex

#: White space as Unicode has it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A text's pieces: a run of anything but white space with the blank before it, or white space up to that blank.
pieces = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def _words() -> regex.Pattern:
    """The split into words that comes before any merge; the tokenizers' own pattern, with white space spelt out."""
    return regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


class MergeAutomaton:
    """The automaton of one tokenizer, compiled from its rank file (token in base64, rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        merges = self._merges(ranks)
        #: Label of each arc; where it leads; its number.
        self.labels = {rank: token for token, rank in ranks.items()}
        self.leads = {ranks[t]: 0 for t in ranks if len(t) == 1}
        self.number, ends = self._numbers(list(self.leads), merges)
        #: For each state the bounds of the ranges of arcs that don't leave it, in order: an odd place is within one.
        self.rows = self._rows(merges, ends)
        #: Byte transitions: (node, byte) to node, and the arc whose label ends at a node.
        self.step: dict[int, int] = {}
        self.ends_at = array("i", [-1])
        for token, rank in ranks.items():
            if rank in self.leads:
                self._spell(token, rank)

    @staticmethod
    def _numbers(roots: list[int], merges: list[tuple[int, int, int]]) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
        """Numbers of arcs along the tree of left parts, the latest first, and for each arc (time, end) of what was laid on it, the latest first."""
        laid: dict[int, list[tuple[int, int]]] = {}
        for time, (u, _, w) in enumerate(merges):
            laid.setdefault(u, []).append((time, w))
        number: dict[int, int] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        stack = [(root, -1, -1) for root in reversed(roots)]
        while stack:
            arc, on, time = stack.pop()
            if arc < 0:  # all that was laid on ~arc is numbered
                ends.setdefault(on, []).append((time, len(number)))
                continue
            number[arc] = len(number)
            if on >= 0:
                stack.append((-1, on, time))
            stack += [(w, arc, t) for t, w in laid.get(arc, ())]  # the latest on top
        return number, ends

    def _rows(self, merges: list[tuple[int, int, int]], ends: dict[int, list[tuple[int, int]]]) -> dict[int, array]:
        """Lays the gadgets one after another; returns the rows of the states that arcs lead to in the end."""
        came_of, lost = [-1], [(0, 0)]
        leads = self.leads
        for time, (u, v, w) in enumerate(merges):
            first = self.number[v]
            past = first + 1
            for laid, end in ends.get(v, ()):
                if laid < time:
                    break
                past = end
            came_of.append(leads[u])
            lost.append((first, past))
            leads[w] = leads[v]  # where v led before the split, also where u is v
            leads[u] = len(lost) - 1
        rows = {}
        for state in set(leads.values()):
            ranges, at = [], state
            while at > 0:
                ranges.append(lost[at])
                at = came_of[at]
            row: list[int] = []
            for lo, hi in sorted(ranges):
                if row and lo <= row[-1]:
                    row[-1] = max(row[-1], hi)
                else:
                    row += (lo, hi)
            rows[state] = array("i", row)
        return rows

    def _spell(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            key = node << 8 | byte
            node = self.step.get(key, -1)
            if node < 0:
                node = self.step[key] = len(self.ends_at)
                self.ends_at.append(-1)
        self.ends_at[node] = rank

    @staticmethod
    def load(path: str | Path) -> MergeAutomaton:
        lines = Path(path).read_bytes().splitlines()
        return MergeAutomaton({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    @staticmethod
    def _merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
        """The merges in order, each as (left, right, made): the two parts that earlier merges leave of a token."""
        out = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out.append((ranks[parts[0]], ranks[parts[1]], rank))
        return out

    def arc(self, x: int, y: int) -> bool:
        """Whether an arc ``y`` leaves the state that ``x`` leads to."""
        return not bisect_right(self.rows[self.leads[x]], self.number[y]) & 1

    def encode(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word."""
        step, ends_at, rows, leads, number = self.step.get, self.ends_at, self.rows, self.leads, self.number
        length = len(word)
        last = [-1] * (length + 1)  # at each place the arc that reaches it
        size = [0] * (length + 1)
        for start in range(length):
            if start and not size[start]:
                continue
            row = rows[leads[last[start]]] if start else ()
            node = 0
            for at in range(start, length):
                node = step(node << 8 | word[at], -1)
                if node < 0:
                    break
                token = ends_at[node]
                if token >= 0 and not size[at + 1] and not bisect_right(row, number[token]) & 1:
                    last[at + 1], size[at + 1] = token, at + 1 - start
        out, at = [], length
        while at:
            if not size[at]:
                raise ValueError(f"no token ends at byte {at} of {word[:80]!r}: the rank file lacks a byte or a merge")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class _Encoded(dict):
    """Strings seen by this worker with their ids as bytes of int32; emptied when it holds ``most``, which changes no result."""

    most = 150_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.make(text)
        if len(text) <= 128:
            self[text] = ids
        return ids


class Encoder:
    """Encodes whole texts. No special tokens: their strings are ordinary text.

    A text is split twice: into pieces that end where white space begins, which is always the end of a word too, then,
    unless the worker has met the piece before, into the words within which the merges work.
    """

    def __init__(self, path: str | Path):
        self.automaton = MergeAutomaton.load(path)
        self.words = _words().findall
        word = _Encoded(lambda w: np.array(self.automaton.encode(w.encode("utf-8")), np.int32).tobytes()).__getitem__
        self.ids_of = _Encoded(lambda piece: b"".join(map(word, self.words(piece)))).__getitem__
        self.count_of = _Encoded(lambda piece: sum(map(len, map(word, self.words(piece)))) // 4).__getitem__

    def encode(self, text: str | None) -> bytes:
        """Ids as bytes of int32; none for an empty or null text."""
        return b"".join(map(self.ids_of, pieces(text))) if text else b""

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and all ids of several texts."""
        parts = [self.encode(t) for t in texts]
        offsets = np.fromiter(accumulate((len(p) // 4 for p in parts), initial=0), np.int32, len(parts) + 1)
        return offsets, np.frombuffer(b"".join(parts), np.int32)

    def count(self, parts: list[str]) -> int:
        """Number of ids of a text given as its pieces."""
        return sum(map(self.count_of, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, compiled once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
