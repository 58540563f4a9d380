"""A minimal acyclic transducer: strings to id sequences, read from a memory-mapped file.

The automaton shares prefixes and suffixes. Every arc carries the number of
accepted strings that come before it, so the sum along a path is the string's
rank in the sorted lexicon; the rank finds the ids. Arcs lie in one comb
(base[state] + byte, checked by owner), so a lookup is two reads per byte and a
batch of strings is walked in lockstep.

File: eight little-endian uint64 (magic, states, arcs' slots, words, ids, 0, 0,
0), then int32 base, owner, next, sum, int8 final and counts, int64 offsets,
uint16 or uint32 ids, as laid out in ``_parts``.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x314C584E4B4E49


def _automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and final flags of the minimal automaton of sorted, distinct, non-empty words."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word, not yet merged

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            if (known := register.setdefault(key, child)) != child:
                arcs[parent][byte] = known
                free.append(child)

    last = b""
    for word in words:
        common = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            if free:
                child = free.pop()
                arcs[child], final[child] = {}, False
            else:
                child = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)
    return arcs, final


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of distinct non-empty ``words`` with their ``ids``; any order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    arcs, final = _automaton([words[i] for i in order])
    # keep what the root reaches, the root first; count the words that each state accepts
    below: dict[int, int] = {}
    stack = [(0, False)]
    reached: list[int] = []
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
        elif state not in below:
            below[state] = -1
            reached.append(state)
            stack.append((state, True))
            stack.extend((t, False) for t in arcs[state].values() if t not in below)
    number = {s: i for i, s in enumerate(reached)}
    base = np.zeros(len(reached), np.int32)
    size = sum(len(arcs[s]) for s in reached) + 512
    used = bytearray(8 * size + 4096)
    owner, goal, add = ([-1] * len(used), [0] * len(used), [0] * len(used))
    # widest states first; each width goes on where it last found room, and single arcs fill the holes
    lowest = 0
    hint: dict[int, int] = {}
    for s in sorted(reached, key=lambda s: -len(arcs[s])):
        out = sorted(arcs[s].items())
        if not out:
            continue
        first = out[0][0]
        if len(out) == 1:
            while used[lowest] or lowest < first:
                lowest += 1
            at = lowest - first
        else:
            begin = at = hint.get(len(out), 0)
            spare = [byte for byte, _ in out]
            while True:
                for byte in spare:
                    if used[at + byte]:
                        break
                else:
                    break
                at += 1
            hint[len(out)] = at if at - begin > 16 else begin
        base[number[s]] = at
        total = int(final[s])
        for byte, t in out:
            slot = at + byte
            used[slot], owner[slot], goal[slot], add[slot] = 1, number[s], number[t], total
            total += below[t]
    slots = max((i for i, u in enumerate(used) if u), default=0) + 257
    flat = [ids[i] for i in order]
    count = np.fromiter(map(len, flat), np.int64, len(flat))
    stream = np.fromiter((x for seq in flat for x in seq), np.uint32, int(count.sum()))
    head = np.array([MAGIC, len(reached), slots, len(flat), len(stream), 0, 0, 0], "<u8")
    fit = lambda x: np.array(x[:slots] + [-1] * (slots - len(x)), "<i4")
    finals = np.fromiter((final[s] for s in reached), np.int8, len(reached))
    pad = b"\0" * (-len(reached) % 8)
    return b"".join([head.tobytes(), np.r_[0, np.cumsum(count)].astype("<i8").tobytes(), stream.astype("<u4").tobytes(), base.astype("<i4").tobytes(), fit(owner).tobytes(), fit(goal).tobytes(), fit(add).tobytes(), finals.tobytes(), pad])


class Lexicon:
    """A compiled lexicon in a memory-mapped file."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        head = self.map[:64].view("<u8")
        if int(head[0]) != MAGIC:
            raise ValueError("not a lexicon file")
        states, slots, words, ids = map(int, head[1:5])
        at = 64

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            at += size
            return self.map[at - size : at].view(kind)

        self.offsets, self.ids = part("<i8", words + 1), part("<u4", ids)
        self.base, self.owner, self.goal, self.add, self.final = part("<i4", states), part("<i4", slots), part("<i4", slots), part("<i4", slots), part("i1", states)

    def ranks(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The rank of each string ``data[start : start + size]``, -1 for those not in the lexicon."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(size > 0)
        at, end = start[live], (start + size)[live]
        state = np.zeros(len(live), np.int32)
        total = np.zeros(len(live), np.int32)
        while len(live):
            slot = self.base[state] + data[at]
            ok = self.owner[slot] == state
            if not ok.all():
                live, at, end, state, total, slot = live[ok], at[ok], end[ok], state[ok], total[ok], slot[ok]
            state, total = self.goal[slot], total + self.add[slot]
            at = at + 1
            done = at == end
            if done.any():
                hit = done & (self.final[state] == 1)
                out[live[hit]] = total[hit]
                rest = ~done
                live, at, end, state, total = live[rest], at[rest], end[rest], state[rest], total[rest]
        return out

    def words_ids(self, rank: int) -> np.ndarray:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]]
