"""Token counts by a compiled finite-state tokenizer.

The pre-tokenizer of the vocabulary is compiled to a deterministic transducer over kinds of characters. Its states are
where a word stands (between words, in letters, in marks, after an apostrophe that may begin a contraction ...); its
transitions say where words begin. A text is cut into chunks of equal length. For every chunk all start states advance
together, which gives a map from start state to end state; a parallel prefix scan composes the maps, and so every chunk
learns its true start state without waiting for the one before.

The merge rules are compiled to a second transducer, over the bytes of a word, whose transitions carry emitted token
counts (`transducer`). A word leads from its start state back to it, so the map of a word is one number, which the worker
keeps, and maps of words compose by addition. A long word is cut into chunks; their maps from start state to (end state,
count) are composed by a prefix scan. Time is linear in the length of a text and of a word.

What is a letter, a number, a blank, and what lower case and NFC make of a character, is read from the library's own
tables when the tokenizer is compiled (on the driver, as ranges), since versions of Unicode differ.
Strings of special tokens in a text count as one token each, as the library's default has it.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Every row is counted by itself, so repeated rows, null
ids and ties need no rule. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.llm.transducer import Transducer

LIMIT = 2048
CHUNK = 256
#: Known words a worker keeps; beyond, it starts anew.
MEMORY = 600_000
# Kinds of characters; the letters of contractions are kinds of their own.
BLANK, LETTER, NUMBER, MARK, APOSTROPHE, S, T, M, D, R, E, V, L = range(13)
KINDS = 13
# States: between words, in letters, after a number, in marks, after a word's first apostrophe, after 'r 'v 'l, after a contraction.
GAP, IN_LETTERS, IN_NUMBER, IN_MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(9)
STATES = 9
# What a transition emits: nothing, a word begins here, a word begins here and another one began at the character before.
STAY, BEGINS, BEGAN_BEFORE = range(3)
_COUNTERS: dict[str, Counter] = {}


def transducer():
    """(next state, emission) by state * KINDS + kind."""
    import numpy as np

    step, emit = np.zeros(STATES * KINDS, np.uint8), np.zeros(STATES * KINDS, np.uint8)
    fresh = {BLANK: GAP, NUMBER: IN_NUMBER, MARK: IN_MARKS, APOSTROPHE: QUOTED} | {k: IN_LETTERS for k in (LETTER, S, T, M, D, R, E, V, L)}
    letters = {LETTER, S, T, M, D, R, E, V, L}
    ends = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for state in range(STATES):
        for kind in range(KINDS):
            to, out = fresh[kind], BEGINS if kind != BLANK else STAY
            if state == IN_LETTERS and kind in letters:
                to, out = IN_LETTERS, STAY
            elif state == IN_MARKS and kind in (MARK, APOSTROPHE):
                to, out = IN_MARKS, STAY
            elif state == QUOTED and kind in (MARK, APOSTROPHE):
                to, out = IN_MARKS, STAY
            elif state == QUOTED and kind in (S, T, M, D):
                to, out = CONTRACTED, STAY
            elif state == QUOTED and kind in (R, V, L):
                to, out = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], STAY  # it depends on the next character
            elif state in ends:
                if kind == ends[state]:
                    to, out = CONTRACTED, STAY
                elif kind in letters:
                    to, out = IN_LETTERS, BEGAN_BEFORE  # the letter before began a word, this one is in it
                else:
                    out = BEGAN_BEFORE if kind == BLANK else BEGAN_BEFORE + BEGINS
            step[state * KINDS + kind], emit[state * KINDS + kind] = to, out
    return step, emit


@cache
def tables(path: str) -> tuple[bytes, tuple[tuple[int, str], ...]]:
    """The kinds of all code points as runs (first code point, kind), and the characters that the library normalizes otherwise."""
    import numpy as np
    from tokenizers import Regex, Tokenizer
    from tokenizers.pre_tokenizers import Split

    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]  # the other planes have no letters, numbers or blanks
    every = "".join(map(chr, points))
    kinds = np.full(0x110000, MARK, np.uint8)
    for pattern, kind in ((r"\p{N}", NUMBER), (r"\p{L}", LETTER), (r"\s", BLANK)):
        inside = np.ones(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
            inside[a:b] = False
        kinds[np.array(points)[inside]] = kind
    for c, kind in zip("'stmdrevl", (APOSTROPHE, S, T, M, D, R, E, V, L), strict=True):
        kinds[ord(c)] = kind
    first = np.flatnonzero(np.diff(kinds, prepend=255))
    normal = Tokenizer.from_file(path).normalizer.normalize_str
    odd = tuple((c, made) for c in points if kinds[c] != BLANK and (made := normal(chr(c))) != plain_normal(chr(c)))
    return np.stack([first, kinds[first]]).astype("<i4").tobytes(), odd


def plain_normal(text: str) -> str:
    """NFC and lower case, character by character."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Counter:
    """A tokenizer file, compiled."""

    def __init__(self, path: str, known_tables: tuple | None = None):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        runs, odd = known_tables or tables(path)
        first, kind = np.frombuffer(runs, "<i4").reshape(2, -1)
        self.kinds = np.repeat(kind.astype(np.uint8), np.diff(first, append=0x110000))
        self.odd = dict(odd)
        self.has_odd = re.compile("[" + "".join(map(re.escape, map(chr, self.odd))) + "]") if odd else None
        self.step, self.emit = transducer()
        byte, spare = {}, 256  # of the printable character that stands for each byte
        for b in range(256):
            printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
            byte[chr(b if printable else spare)], spare = b, spare + (not printable)
        symbols: list[tuple[int, ...]] = [()] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            ends = name.endswith(suffix)
            spelled = [byte.get(c, -1) for c in (name[: -len(suffix)] if ends else name)]
            if spelled and min(spelled) >= 0 and name not in special:
                symbols[i] = (*spelled[:-1], spelled[-1] + 256 * ends)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = Transducer(symbols, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.known: dict[str, int] = {}

    def begins(self, points):
        """Where words begin (offsets), and the kinds: by chunk state maps and a prefix scan."""
        import numpy as np

        n = len(points)
        kinds = self.kinds[points]
        chunks = -(-n // CHUNK)
        grid = np.zeros(chunks * CHUNK, np.uint8)  # blanks fill up the last chunk
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None], chunks, 0)  # chunk, start state -> end state
        for row in grid:
            maps = self.step[maps * np.uint8(KINDS) + row[:, None]]
        reach = 1
        while reach < chunks:  # each map becomes that of all chunks up to it, twice as many in a round
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), 1)
            reach *= 2
        state = np.concatenate([np.zeros(1, np.uint8), maps[:-1, GAP]])
        out = np.empty_like(grid)
        for k, row in enumerate(grid):
            at = state * np.uint8(KINDS) + row
            out[k], state = self.emit[at], self.step[at]
        out = out.T.ravel()[:n]
        before = np.flatnonzero(out >= BEGAN_BEFORE) - 1
        mark = (out & 1).astype(bool)
        mark[before] = True
        if n and state.size and kinds[-1] in (R, V, L):  # the text ends where a contraction might have gone on
            tail = self._state_at_end(kinds, maps, state, n)
            mark[n - 1] |= tail in (QUOTED_R, QUOTED_V, QUOTED_L)
        return np.flatnonzero(mark), kinds

    def _state_at_end(self, kinds, maps, state, n) -> int:
        start = (n - 1) // CHUNK
        now = int(maps[start - 1, GAP]) if start else GAP
        for k in kinds[start * CHUNK : n].tolist():
            now = int(self.step[now * KINDS + k])
        return now

    def learn(self, words: list[str]) -> None:
        """Walk the transducer of the merges over new words."""
        if len(self.known) + len(words) > MEMORY:
            self.known.clear()
        for w in words:
            self.known[w] = self.words.count(w.encode())

    def normal(self, text: str) -> str:
        """NFC and lower case as the library has them."""
        if self.has_odd and not text.isascii() and self.has_odd.search(text):
            text = unicodedata.normalize("NFC", text).translate(self.odd)
        return plain_normal(text)

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        import numpy as np

        special = [0] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            t = t or ""
            if self.special and "<|" in t:
                special[i] = len(self.special.findall(t))
                t = "\n".join(self.normal(x) for x in self.special.split(t))
            else:
                t = self.normal(t)
            plain.append(t)
        joined = "\n".join([*plain, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, kinds = self.begins(points)
        blank = np.concatenate([kinds == BLANK, [True]])
        stop = np.flatnonzero(blank)
        ends = np.minimum(np.concatenate([starts[1:], [len(points)]]), stop[np.searchsorted(stop, starts)]) if len(starts) else starts
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set(words)
        self.learn(sorted(new))
        counts = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for w in [w for w in new if len(w) > CHUNK]:  # the memory is bounded by the number of words, so it keeps short ones
            del self.known[w]
        bounds = np.cumsum([len(t) + 1 for t in plain])
        doc = np.searchsorted(bounds, starts, "right")
        return (np.bincount(doc, counts, len(texts)).astype(np.int64) + np.array(special, np.int64)).tolist() if len(texts) else []


def counter(path: str, known_tables: tuple | None = None) -> Counter:
    """The compiled tokenizer of a file; a worker keeps it."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, known_tables)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""

    shipped = tables(path)

    def run(batches):
        import pyarrow as pa

        c = counter(path, shipped)
        for part in slices(batches, 250):
            texts = part.column(1).to_pylist()
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
