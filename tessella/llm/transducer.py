"""Byte-pair merging compiled to a deterministic transducer whose transitions emit token counts.

A sequence of tokens is what merging by rank gives exactly if every two neighbours stay apart when they are merged by
themselves. So each prefix of a word has one last token, and what comes later can only depend on the places where a
token may still be open. A state is the set of these places: for each the node of the vocabulary's trie that was reached
from it, the last token before it, and its token count less the present one. Reading a symbol moves every node on; of
those that then spell a token exactly one fits its last token. The transition emits by how many tokens the count
changes; the symbol that ends a word leads back to the start state.

Transitions are compiled when they are first met and kept; with `MAX_STATES` states the table starts anew, which only
costs time. Counts of words are sums along a walk, linear in the word's length.
"""

from __future__ import annotations

START = 0
SYMBOLS = 512  # 256 bytes inside a word, 256 that end it
SHIFT = 20
CHUNK = 4096
#: What is walked before a chunk to guess the state that it starts in.
LOOK_BACK = 48
#: Chunks whose maps are composed together, for bounded memory on very long words.
GROUP = 16
MAX_STATES = 120_000
TOP = 1 << 60


class Transducer:
    """The merge rules of a vocabulary, compiled."""

    def __init__(self, tokens: list[tuple[int, ...]], merges: list[tuple[int, int, int]]):
        """tokens: the symbols of each; merges: (left, right, made) in the order of rank."""
        self.merge_rank = {a << SHIFT | b: r for r, (a, b, _) in enumerate(merges)}
        self.parts = {made: (a, b, r) for r, (a, b, made) in enumerate(merges)}
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        whole = set()
        for t in sorted(range(len(tokens)), key=lambda t: self.parts.get(t, (0, 0, -1))[2]):
            if not tokens[t] or (len(tokens[t]) > 1 and t not in self.parts):
                continue
            if t in self.parts:
                a, b, rank = self.parts[t]
                if a not in whole or b not in whole or self._first_across(a, b) != rank:
                    continue  # merging its own symbols doesn't give it
            whole.add(t)
            node = 0
            for s in tokens[t]:
                self.inner[node] = True
                key = node * SYMBOLS + s
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = t
        self.stays: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all compiled states but the start."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: START}
        self.step: dict[int, tuple[int, int]] = {}
        if len(self.stays) > 8 * MAX_STATES:
            self.stays.clear()

    def number(self, state: tuple) -> int:
        """The number of a state."""
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _edge(self, held: dict, token: int, side: int) -> list:
        """(token, rank at which it is merged on) along the right or left edge of a token's merges."""
        if (edge := held.get(token)) is None:
            edge, until, at = [], TOP, token
            while True:
                edge.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            held[token] = edge
        return edge

    def _first_across(self, a: int, b: int) -> int:
        """The least rank of a merge across the border of two tokens that comes before both sides are merged on, or TOP.

        Of equal ranks the leftmost goes first: before a merge on the right of the border, after one on its left.
        """
        best = TOP
        for x, x_until in self._edge(self.right_edges, a, 1):
            for y, y_until in self._edge(self.left_edges, b, 0):
                rank = self.merge_rank.get(x << SHIFT | y, TOP)
                if rank < best and rank < x_until and rank <= y_until:
                    best = rank
        return best

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when their symbols are merged as one text."""
        key = a << SHIFT | b
        if (out := self.stays.get(key)) is None:
            out = self.stays[key] = self._first_across(a, b) == TOP
        return out

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the token count) of a transition that is new."""
        ahead, last, change = [], -1, 0
        for node, before, count in self.states[state]:
            to = self.child.get(node * SYMBOLS + symbol)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and last < 0 and (before < 0 or self.apart(before, t)):
                last, change = t, count + 1
            if self.inner[to]:
                ahead.append((to, before, count))
        if last < 0:
            raise ValueError("the vocabulary has no token for a byte")
        if symbol >= SYMBOLS // 2:
            out = START, change
        else:
            out = self.number((*((node, before, count - change) for node, before, count in ahead), (0, last, 0))), change
        self.step[state * SYMBOLS + symbol] = out
        return out

    def walk(self, symbols, state: int = START) -> tuple[int, int]:
        """(end state, emitted count) from a state along symbols."""
        known, total = self.step.get, 0
        for s in symbols:
            state, change = known(state * SYMBOLS + s) or self.compiled(state, s)
            total += change
        return state, total

    def count(self, word: bytes) -> int:
        """The number of tokens of a word."""
        if len(self.states) > MAX_STATES:
            self.reset()
        if len(word) <= CHUNK:
            state, total = self.walk(word[:-1])
            return total + self.walk([SYMBOLS // 2 + word[-1]], state)[1]
        return self._count_long(word)

    def _count_long(self, word: bytes) -> int:
        """Of a long word: maps of its chunks, composed."""
        state, total = START, 0
        for at in range(0, len(word) - 1, GROUP * CHUNK):
            if len(self.states) > MAX_STATES:
                held = self.states[state]
                self.reset()
                state = self.number(held)
            end = min(at + GROUP * CHUNK, len(word) - 1)
            chunks = [word[i : min(i + CHUNK, end)] for i in range(at, end, CHUNK)]
            state, change = composed(self.chunk_maps(chunks, state), state)
            total += change
        return total + self.walk([SYMBOLS // 2 + word[-1]], state)[1]

    def chunk_maps(self, chunks: list[bytes], first: int) -> list[dict[int, tuple[int, int]]]:
        """For each chunk a map from start state to (end state, count).

        Each map begins with a guess, the state behind the symbols before the chunk; then every end state of a chunk becomes
        a start state of the next until nothing is missing, so the maps hold all starts that can be reached.
        """
        held: dict[tuple[bytes, int], tuple[int, int]] = {}

        def of(chunk: bytes, start: int) -> tuple[int, int]:
            if (out := held.get((chunk, start))) is None:
                out = held[chunk, start] = self.walk(chunk, start)
            return out

        starts = [first, *(self.walk(before[-LOOK_BACK:])[0] for before in chunks[:-1])]
        maps = [{s: of(c, s)} for c, s in zip(chunks, starts, strict=True)]
        missing = True
        while missing:
            missing = False
            for before, now, chunk in zip(maps, maps[1:], chunks[1:], strict=False):
                for end, _ in before.values():
                    if end not in now:
                        now[end], missing = of(chunk, end), True
        return maps


def composed(maps: list[dict[int, tuple[int, int]]], first: int) -> tuple[int, int]:
    """(end state, count) of a row of chunk maps from a state, by a parallel prefix scan.

    In each round every map is joined with the one `reach` before it, so a row of n maps takes log2(n) rounds.
    """
    import numpy as np

    states = np.array(sorted({s for m in maps for s in m} | {e for m in maps for e, _ in m.values()}))
    place = {s: i for i, s in enumerate(states.tolist())}
    ends = np.full((len(maps), len(states)), -1)
    counts = np.zeros((len(maps), len(states)), np.int64)
    for k, m in enumerate(maps):
        for start, (end, n) in m.items():
            ends[k, place[start]], counts[k, place[start]] = place[end], n
    reach = 1
    while reach < len(maps):
        left, right = ends[:-reach], ends[reach:]
        via = np.maximum(left, 0)
        counts[reach:] = counts[:-reach] + np.take_along_axis(counts[reach:], via, 1)
        ends[reach:] = np.where(left < 0, -1, np.take_along_axis(right, via, 1))
        reach *= 2
    return int(states[ends[-1, place[first]]]), int(counts[-1, place[first]])
