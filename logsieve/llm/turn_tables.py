"""Least-cost repair of a sequence of turns by tables over blocks of fixed length (Four Russians).

A turn that need not go is one of eight symbols: the initial of its role (user, assistant, system, other) and whether
its text is cut off. Costs to the end are a vector over four states; less their least value only a few vectors occur,
and one symbol, or a block of them, takes each to another. The tables hold these transitions, and for each state in
which a block is entered the state in which the cheapest edits leave it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbol that stands for no turn and fills the last block.
PAD = 8
_SYMBOLS = 9
_FAR = 1 << 20
#: State after a turn of user or assistant that is made or given a new role.
MADE = (USER, USER, ASSISTANT, USER)
#: State after a kept turn by its initial (user, assistant, system, other); no entry where it cannot stand.
KEPT = {
    (START, 0): USER, (SYSTEM, 0): USER, (ASSISTANT, 0): USER, (USER, 1): ASSISTANT, (START, 2): SYSTEM,
}
#: Costs after the last turn, and the edits that end a conversation there.
ENDED, CLOSING = (0, 6, 3, 0), ("", "II", "I", "")


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a turn from those after it; turns may be inserted in front of it."""
    if symbol == PAD:
        return after
    initial, cut = symbol >> 1, CUT * (symbol & 1)
    taken = []
    for state in range(4):
        kept = KEPT.get((state, initial))
        taken.append(min(
            DELETE + after[state], REROLE + cut + after[MADE[state]],
            _FAR if kept is None else KEEP + cut + after[kept],
        ))
    return tuple(min(taken[s], INSERT + taken[MADE[s]], 2 * INSERT + taken[MADE[MADE[s]]]) for s in range(4))


def _edits(symbol: int, before: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The cheapest edits up to and with this turn, of equal ones the least in ASCII order, and the state after them."""
    if symbol == PAD:
        return "", state
    initial, cut, made = symbol >> 1, CUT * (symbol & 1), ""
    while True:
        if DELETE + after[state] == before[state]:
            return made + "D", state
        if INSERT + before[MADE[state]] == before[state]:
            made, state = made + "I", MADE[state]
            continue
        kept = KEPT.get((state, initial))
        if kept is not None and KEEP + cut + after[kept] == before[state]:
            return made + "K", kept
        return made + "R", MADE[state]


@dataclass(frozen=True)
class Tables:
    """Transitions of one symbol (``dest, off, end, edits``) and of a block of ``length`` symbols (``b_*``).

    ``dest[symbol, v]`` is the vector before, ``off`` what its least cost adds, ``end[symbol, v, state]`` the state after.
    """

    length: int
    vectors: np.ndarray
    dest: np.ndarray
    off: np.ndarray
    end: np.ndarray
    edits: list[list[list[str]]]
    b_dest: np.ndarray
    b_off: np.ndarray
    b_end: np.ndarray

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Block numbers of a sequence, filled up at its end."""
        filled = np.full(-(-len(symbols) // self.length) * self.length, PAD, np.int64)
        filled[: len(symbols)] = symbols
        weights = _SYMBOLS ** np.arange(self.length - 1, -1, -1)
        return filled.reshape(-1, self.length) @ weights

    def passed(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The transition of a whole sequence for every vector at its end: ``dest, off, end``, looked up block by block."""
        codes, n = self.codes(symbols), len(self.vectors)
        at, cost = np.arange(n), np.zeros(n, np.int64)
        held = np.empty((len(codes), n), np.uint8)
        for i in range(len(codes) - 1, -1, -1):
            held[i] = at
            cost += self.b_off[codes[i], at]
            at = self.b_dest[codes[i], at].astype(np.int64)
        state = np.broadcast_to(np.arange(4), (n, 4))
        for code, after in zip(codes, held, strict=True):
            state = np.take_along_axis(self.b_end[code, after], state, 1)
        return at, cost, np.asarray(state)

    def traced(self, symbols: np.ndarray, after: int, state: int) -> list[str]:
        """Edits of every symbol, given the vector after the last one and the state before the first.

        The vectors between blocks come by lookup. Each block is then expanded backward, symbol by symbol, so that
        the way forward can choose the least of equally cheap edits.
        """
        codes = self.codes(symbols)
        held = [0] * len(codes)
        for i in range(len(codes) - 1, -1, -1):
            held[i] = after
            after = int(self.b_dest[codes[i], after])
        found = []
        given = symbols.tolist()
        for i, at in enumerate(held):
            block = given[i * self.length : (i + 1) * self.length]
            behind = []
            for symbol in reversed(block):
                behind.append(at)
                at = int(self.dest[symbol, at])
            for symbol, v in zip(block, reversed(behind), strict=True):
                found.append(self.edits[symbol][v][state])
                state = int(self.end[symbol, v, state])
        return found


@lru_cache
def tables(length: int = 4) -> Tables:
    """Tables for blocks of ``length`` symbols, made from the costs; nine to that power blocks times a few vectors."""
    vectors, dest, off = [ENDED], [], []
    at = {ENDED: 0}
    for v in vectors:  # grows as new vectors are met
        for symbol in range(_SYMBOLS):
            cost = _before(symbol, v)
            least = min(cost)
            plain = tuple(c - least for c in cost)
            if plain not in at:
                at[plain] = len(vectors)
                vectors.append(plain)
            dest.append(at[plain])
            off.append(least)
    n = len(vectors)
    dest = np.array(dest, np.int64).reshape(n, _SYMBOLS).T.copy()
    off = np.array(off, np.int64).reshape(n, _SYMBOLS).T.copy()
    told = [[[_edits(s, _before(s, v), v, state) for state in range(4)] for v in vectors] for s in range(_SYMBOLS)]
    edits = [[[e for e, _ in states] for states in rows] for rows in told]
    end = np.array([[[after for _, after in states] for states in rows] for rows in told], np.int64)
    b_dest, b_off, b_end = np.arange(n)[None], np.zeros((1, n), np.int64), np.tile(np.arange(4), (1, n, 1))
    for _ in range(length):  # one symbol more in front of every block
        parts = [(dest[s][b_dest], b_off + off[s][b_dest], np.take_along_axis(b_end, end[s][b_dest], 2)) for s in range(_SYMBOLS)]
        b_dest, b_off, b_end = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Tables(length, np.array(vectors), dest, off, end, edits, b_dest, b_off, b_end)
