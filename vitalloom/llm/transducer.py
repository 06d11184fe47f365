"""Minimal acyclic transducer over byte strings: recognises a sorted set of terms and gives each its ordinal.

States are merged as soon as no later term can change them (terms come in byte order), so the automaton is minimal
while it is built. A transition carries the number of terms that come before those behind it; the sum along a term's
path is its ordinal. Transitions lie in one sorted array of (state, byte), so many words are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """Sorted keys (state * 256 + byte) with target state and output, final states, and the first state."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    finals: np.ndarray
    root: int
    terms: int


def build(terms: Iterable[bytes]) -> Transducer:
    """Transducer of distinct ``terms`` in ascending byte order."""
    register: dict[tuple, int] = {}
    below: list[int] = []  # terms behind a state
    edges: list[tuple[int, int, int]] = []
    finals: list[bool] = []
    final, arcs = [False], [[]]  # the open path
    last, number = b"", 0

    def close(depth: int) -> None:
        """Settle all open states deeper than ``depth``."""
        while len(arcs) - 1 > depth:
            state = settle(final.pop(), arcs.pop())
            arcs[-1].append((last[len(arcs) - 1], state))

    def settle(is_final: bool, out: list[tuple[int, int]]) -> int:
        key = (is_final, *out)
        state = register.get(key)
        if state is None:
            state = register[key] = len(below)
            finals.append(is_final)
            before = int(is_final)
            for byte, target in out:
                edges.append((state * 256 + byte, target, before))
                before += below[target]
            below.append(before)
        return state

    for term in terms:
        if number and term <= last:
            raise ValueError("terms must be distinct and in byte order")
        shared = 0
        for a, b in zip(term, last, strict=False):
            if a != b:
                break
            shared += 1
        close(shared)
        for _ in range(shared, len(term)):
            final.append(False)
            arcs.append([])
        final[-1] = True
        last, number = term, number + 1
    close(0)
    root = settle(final[0], arcs[0])
    table = np.array(edges, np.int64).reshape(-1, 3)
    return Transducer(table[:, 0], table[:, 1], table[:, 2], np.array(finals, bool), root, number)


def joined(parts: list[Transducer]) -> tuple[Transducer, np.ndarray]:
    """One table of several transducers, and the first state of each."""
    shift = np.cumsum([0] + [len(p.finals) for p in parts])
    pick = lambda name: [getattr(p, name) for p in parts]
    table = Transducer(np.concatenate([k + 256 * s for k, s in zip(pick("keys"), shift, strict=False)]), np.concatenate([t + s for t, s in zip(pick("targets"), shift, strict=False)]),
                       np.concatenate(pick("outputs")), np.concatenate(pick("finals")), -1, sum(pick("terms")))
    return table, shift[:-1] + np.array(pick("root"))


def ordinals(table: Transducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ordinal of each word ``data[start:end]`` from its first state, -1 if it is no term. Walks all words byte by byte."""
    out = np.full(len(starts), -1, np.int64)
    word, state, at, total = np.arange(len(starts)), first.astype(np.int64), starts.astype(np.int64), np.zeros(len(starts), np.int64)
    keys = np.append(table.keys, np.int64(2**63 - 1))
    while len(word):
        done = at == ends[word]
        if done.any():
            good = done & table.finals[state]
            out[word[good]] = total[good]
            go = ~done
            word, state, at, total = word[go], state[go], at[go], total[go]
            if not len(word):
                break
        want = state * 256 + data[at]
        arc = np.searchsorted(keys, want)
        hit = np.flatnonzero(keys[arc] == want)
        arc = arc[hit]
        word, state, at, total = word[hit], table.targets[arc], at[hit] + 1, total[hit] + table.outputs[arc]
    return out


def term_at(table: Transducer, root: int, ordinal: int) -> bytes:
    """The term of an ordinal."""
    state, left, out = root, ordinal, bytearray()
    while not (table.finals[state] and left == 0):
        a, b = np.searchsorted(table.keys, [state * 256, state * 256 + 256])
        arc = a + int(np.searchsorted(table.outputs[a:b], left, side="right")) - 1
        out.append(int(table.keys[arc]) & 255)
        left -= int(table.outputs[arc])
        state = int(table.targets[arc])
    return bytes(out)
