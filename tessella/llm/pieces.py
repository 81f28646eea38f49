"""SentencePiece encoding and decoding: batched numpy Viterbi over words of equal length.

A text is cut into units at spaces (a unit keeps the spaces before it), newlines, and before marks that follow a letter in
no piece; no piece reaches over such a cut. The distinct units of a batch that aren't known yet are encoded together, those of equal length in one matrix that
advances character by character: hashes of all substrings that end there probe the sorted keys of the pieces, and the
vectorised maximum over them is stored as a back-pointer.

The score of a path is the sum of its pieces' scores. For a model of the kind "bpe" a step is allowed only if its two
pieces stay apart when merged by themselves and the piece itself comes out whole; exactly one path of a word has this at
every step, and it is the one that merging by rank gives (so the maximum has one candidate there). Plain piece sums would
not give a BPE model's ids. Whether two
pieces stay apart is found by replaying merges, batched as well, once for each pair of pieces. Characters outside the
vocabulary become byte pieces. `decode` is the inverse.

A unit of more than WINDOW characters is cut into windows that overlap by half; they advance together like words. Two
neighbouring windows are joined where both paths have the same piece: every two neighbours of the joined path are
neighbours in one of the windows, so all stay apart, and only one path has that. Where no such piece exists, windows of
twice the length are taken. Time is linear in the length of a unit unless windows never meet.

Defined cases: null and empty texts have no pieces and decode to null and the empty text. U+2581, which the format uses
for spaces, is encoded as a space (round_trip is then false). Repeated rows, null ids and other columns are no matter:
every row is encoded by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices

#: Fixed values of the format.
SPACE, UNKNOWN = "▁", 0
#: Known words a worker keeps; beyond, it starts anew.
MEMORY = 600_000
#: Text that is encoded at once.
SLICE_BYTES = 3 << 20
#: Characters of a window of a long unit.
WINDOW = 256
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?%*#&$|\")]"
_TABLES: dict[tuple[str, str], Table] = {}


class Table:
    """The pieces of a model in arrays, and the words that were encoded with them."""

    def __init__(self, path: str, kind: str = "bpe"):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.kind, self.size = kind, n
        self.byte_ids = np.full(256, -1, np.int64)
        real = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                real.append(i)
        self.score = np.full(n + 1, -np.inf)
        self.score[real] = [model.get_score(i) for i in real]
        self.score[n] = min(self.score[real]) - 10  # at n: a character that is no piece
        self.longest = max(len(names[i]) for i in real)
        self.points = np.zeros((n + 1, self.longest), np.uint32)
        self.length = np.zeros(n + 1, np.int64)
        self.length[n] = 1
        for i in real:
            at = [ord(c) for c in names[i]]
            self.points[i, : len(at)], self.length[i] = at, len(at)
        self.base = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash
        keys = np.zeros(n, np.uint64)
        for k in range(self.longest):
            more = self.length[:n] > k
            keys[more] = keys[more] * self.base + self._mix(self.points[:n][more, k])
        self.maybe = np.zeros(1 << 20, bool)  # by the top bits of a hash: nothing is there
        self.maybe[(keys[real] >> np.uint64(44)).astype(np.int64)] = True
        # a word also ends before a mark that follows a letter in no piece
        marks = [m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", names[i]) for i in real)]
        self.units = re.compile((f"{SPACE}*[{LETTERS}]+(?=[{re.escape(''.join(marks))}])|" if marks else "") + f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        order = np.array(sorted(real, key=lambda i: int(keys[i])))
        self.keys, self.ids = keys[order], order
        by_name = {names[i]: i for i in real}
        splits = {}
        for name, i in by_name.items():
            for k in range(1, len(name)):
                if (a := by_name.get(name[:k])) is not None and (b := by_name.get(name[k:])) is not None:
                    splits[a * (n + 1) + b] = i
        self.merge_keys = np.array(sorted(splits), np.int64)
        self.merge_ids = np.array([splits[k] for k in self.merge_keys.tolist()], np.int64)
        self.whole = np.ones(n + 1, bool)
        if kind == "bpe":
            for size in range(2, self.longest + 1):
                some = np.array([i for i in real if self.length[i] == size], np.int64)
                if len(some):
                    self.whole[some] = self._merged(self._chars(self.points[some, :size]))[:, 1] < 0
        raw = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.pair_keys, self.pair_answers = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, bool)
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}  # of units
        self.words: dict[str, bytes] = {}  # of words as `encode` cuts them

    @staticmethod
    def _mix(points):
        import numpy as np

        x = points.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))

    def _find(self, hashes, points):
        """The piece of each substring (rows of points), or -1. hashes: the substrings' keys."""
        import numpy as np

        found = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        wanted = hashes[likely]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        likely, at = likely[hit := self.keys[at] == wanted], at[hit]
        if len(likely):  # a hash may collide: the characters decide
            k, ids = points.shape[1], self.ids[at]
            same = (self.length[ids] == k) & (self.points[ids, :k] == points[likely]).all(1)
            found[likely[same]] = ids[same]
        return found

    def _chars(self, points):
        """The pieces of single characters, n for a character that is none."""
        import numpy as np

        flat = points.reshape(-1, 1)
        found = self._find(self._mix(flat[:, 0]), flat)
        return np.where(found < 0, self.size, found).reshape(points.shape)

    def _merged(self, parts):
        """Merge neighbours, best score first and leftmost first, until none can be; rows are filled up with -1."""
        import numpy as np

        parts = parts.astype(np.int64)
        live = np.arange(len(parts))
        while len(live) and parts.shape[1] > 1:
            p = parts[live]
            keys = p[:, :-1] * (self.size + 1) + p[:, 1:]
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            ok = (self.merge_keys[at] == keys) & (p[:, 1:] >= 0)
            made = self.merge_ids[at]
            score = np.where(ok, self.score[made], -np.inf)
            best = score.argmax(1)
            go = np.flatnonzero(ok[np.arange(len(p)), best])
            live, p, best, made = live[go], p[go], best[go], made[go]
            cols = np.arange(p.shape[1] - 1)
            rest = np.take_along_axis(p, cols[None] + (cols[None] > best[:, None]), 1)
            rest[np.arange(len(p)), best] = made[np.arange(len(p)), best]
            parts[live, :-1], parts[live, -1] = rest, -1
        return parts

    def _slots(self, keys):
        """The slot of each pair in the open hash table: its own, or the empty one where it belongs."""
        import numpy as np

        size = len(self.pair_keys)
        at = ((keys.astype(np.uint64) * self.base) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        todo = np.flatnonzero((self.pair_keys[at] != keys) & (self.pair_keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % size
            held = self.pair_keys[at[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return at

    def _remember(self, keys, answers) -> None:
        """Put distinct new pairs into the table."""
        import numpy as np

        if self.n_pairs + len(keys) > len(self.pair_keys) // 2:
            old = np.flatnonzero(self.pair_keys >= 0) if self.n_pairs < 8 * MEMORY else np.zeros(0, np.int64)
            keys, answers = np.concatenate([self.pair_keys[old], keys]), np.concatenate([self.pair_answers[old], answers])
            size = max(len(self.pair_keys), 1 << (4 * len(keys)).bit_length())
            self.pair_keys, self.pair_answers, self.n_pairs = np.full(size, -1, np.int64), np.zeros(size, bool), 0
        self.n_pairs += len(keys)
        while len(keys):
            at = self._slots(keys)
            _, first = np.unique(at, return_index=True)  # two of them may want one slot
            self.pair_keys[at[first]], self.pair_answers[at[first]] = keys[first], answers[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, answers = keys[left], answers[left]

    def _stay_apart(self, left, right):
        """Whether the pieces of each pair stay as they are when they are merged as one text."""
        import numpy as np

        keys = left * (self.size + 1) + right
        at = self._slots(keys)
        apart = self.pair_answers[at]
        if (missing := self.pair_keys[at] < 0).any():
            new = np.unique(keys[missing])
            a, b = new // (self.size + 1), new % (self.size + 1)
            la = self.length[a]
            both = la + self.length[b]
            answer = (a == self.size) | (b == self.size)
            for n in np.unique(both[~answer]).tolist():
                rows = np.flatnonzero((both == n) & ~answer)
                col, cut = np.arange(n)[None], la[rows][:, None]
                points = np.where(col < cut, self.points[a[rows][:, None], np.minimum(col, self.longest - 1)], self.points[b[rows][:, None], np.clip(col - cut, 0, self.longest - 1)])
                end = self._merged(self._chars(points))
                answer[rows] = (end[:, 0] == a[rows]) & (end[:, 1] == b[rows]) & (end[:, 2] < 0 if n > 2 else True)
            apart[missing] = answer[np.searchsorted(new, keys[missing])]
            self._remember(new, answer)  # may drop pairs of this call: it isn't asked again
        return apart

    def _viterbi(self, points):
        """The best path of each row of characters: (rows, ends) of pieces, -1 where no piece of the path ends."""
        import numpy as np

        n, length = points.shape
        hashes = np.zeros((n, length + 1), np.uint64)
        mixed = self._mix(points)
        for j in range(length):
            hashes[:, j + 1] = hashes[:, j] * self.base + mixed[:, j]
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.longest, self.base))])
        total = np.full((n, length + 1), -np.inf)
        total[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        for j in range(1, length + 1):
            steps = []  # all pieces that end here, by length
            for k in range(1, min(self.longest, j) + 1):
                piece = self._find(hashes[:, j] - hashes[:, j - k] * powers[k], points[:, j - k : j])
                if k == 1:
                    piece[piece < 0] = self.size
                rows = np.flatnonzero(piece >= 0)
                steps.append((rows, piece[rows], np.full(len(rows), j - k)))
            rows, piece, start = (np.concatenate(x) for x in zip(*steps, strict=True))
            ok = np.isfinite(total[rows, start]) & self.whole[piece]
            if self.kind == "bpe":
                inside = np.flatnonzero(ok & (start > 0))
                ok[inside] = self._stay_apart(last[rows[inside], start[inside]], piece[inside])
            rows, piece, start = rows[ok], piece[ok], start[ok]
            sums = total[rows, start] + self.score[piece]
            np.maximum.at(total[:, j], rows, sums)
            best = sums == total[rows, j]
            last[rows[best], j] = piece[best]
        path = np.full((n, length), -1, np.int64)
        at = np.full(n, length)
        while (live := np.flatnonzero(at > 0)).size:
            ends = at[live]
            path[live, ends - 1] = last[live, ends]
            at[live] = ends - self.length[last[live, ends]]
        return path

    def _long(self, unit: str, window: int = WINDOW):
        """The path of a long unit, from windows."""
        import numpy as np

        points = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        n = len(points)
        while 2 * window < n:
            starts = [*range(0, n - window, window // 2), n - window]
            step = max(1, 400_000 // window)
            paths = np.concatenate([self._viterbi(np.stack([points[s : s + window] for s in starts[at : at + step]])) for at in range(0, len(starts), step)])
            out = np.full(n, -1, np.int64)
            out[:window] = paths[0]
            for before, at, path in zip(starts, starts[1:], paths[1:], strict=False):
                end = before + window
                shared = np.flatnonzero((out[at:end] == path[: end - at]) & (path[: end - at] >= 0))
                shared = shared[self.length[path[shared]] <= shared + 1]
                if not len(shared):
                    break
                cut = at + int(shared[len(shared) // 2]) + 1
                out[cut:end] = -1
                out[cut : at + window] = path[cut - at :]
            else:
                return out
            window *= 2
        return self._viterbi(points[None])[0]

    def learn(self, units: list[str]) -> None:
        """Encode distinct units; known[unit] holds the ids as little-endian int32."""
        import numpy as np

        by_length: dict[int, list[str]] = {}
        for w in units:
            if len(w) > 2 * WINDOW and self.kind == "bpe":
                self.known[w] = self._with_bytes(self._long(w), w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, 400_000 // length)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                path = self._viterbi(points)
                used = path >= 0
                ids, counts = path[used].astype("<i4"), used.sum(1)
                odd = np.zeros(len(part), bool)
                odd[np.nonzero(used)[0][ids == self.size]] = True
                blob, ends = ids.tobytes(), np.cumsum(counts) * 4
                start = 0
                for w, end, strange, row in zip(part, ends.tolist(), odd.tolist(), range(len(part)), strict=True):
                    self.known[w] = self._with_bytes(path[row], w) if strange else blob[start:end]
                    start = end

    def _with_bytes(self, row, word: str) -> bytes:
        import numpy as np

        out = []
        for j in np.flatnonzero(row >= 0).tolist():
            if row[j] == self.size:
                spelled = self.byte_ids[list(word[j].encode())].tolist()
                out += spelled if min(spelled) >= 0 else [UNKNOWN]
            else:
                out.append(int(row[j]))
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32.

        A word is what stands between blanks, with a blank before it, or after a newline, with that before it. Texts with
        blanks in a row or at their ends are cut into units at once.
        """
        out: list[bytes] = []
        held: list[tuple[bool, list[str]]] = []
        new, raw = set(), set()
        for t in texts:
            t = (t or "").replace(SPACE, " ")
            words = t.replace("\n", " \n").split(" ") if t else []
            if plain := "" not in words:
                new.update(set(words).difference(self.words))
            else:
                words = self.units.findall(SPACE + t.replace(" ", SPACE))
                raw.update(set(words).difference(self.known))
            held.append((plain, words))
            if len(new) + len(raw) > MEMORY // 8:
                self._flush(held, new, raw, out)
        self._flush(held, new, raw, out)
        return out

    def _flush(self, held: list, new: set, raw: set, out: list) -> None:
        if len(self.words) + len(self.known) + 2 * len(new) + len(raw) > MEMORY:
            self.words.clear()
            self.known.clear()
            for plain, words in held:
                (new if plain else raw).update(words)
        cut = {w: ["\n", *self.units.findall(w[1:])] if w[0] == "\n" else self.units.findall(SPACE + w) for w in new}
        raw.update(u for units in cut.values() for u in units)
        self.learn(sorted(raw.difference(self.known)))
        known = self.known.__getitem__
        self.words.update((w, known(units[0]) if len(units) == 1 else b"".join(map(known, units))) for w, units in cut.items())
        own = self.words.__getitem__
        out.extend(b"".join(map(own if plain else known, words)) for plain, words in held)
        for w in [w for w in (*cut, *raw) if len(w) > 2 * WINDOW]:  # the memory is bounded by the number of words, so it keeps short ones
            self.words.pop(w, None)
            self.known.pop(w, None)
        for x in (held, new, raw):
            x.clear()

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The UTF-8 of each text from its ids."""
        import numpy as np

        ids = np.frombuffer(b"".join(encoded), "<i4").astype(np.int64)
        size = self.raw_length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        blob = self.raw[np.repeat(self.raw_start[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes() if len(ids) else b""
        bounds = ends[np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int64)].tolist()
        return [blob[a + (blob[a : a + 1] == b" " and a < b) : b] for a, b in zip(bounds, bounds[1:], strict=False)]


def by_bytes(batch, column: int, most: int = SLICE_BYTES):
    """Parts of a batch with about `most` bytes of text each: large enough to encode many new words together."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def table(path: str, kind: str = "bpe") -> Table:
    """The table of a model file; a worker keeps it."""
    if (path, kind) not in _TABLES:
        _TABLES[path, kind] = Table(path, kind)
    return _TABLES[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe", doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_sha256, decoded_sha256, round_trip, ids): ids only if asked for.

    ids_sha256 is over the little-endian int32 ids; decoded_sha256 over the UTF-8 that decoding them gives.
    """

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        t = table(path, kind)
        for b in batches:
            for part in by_bytes(b, 1):
                texts = part.column(1).to_pylist()
                coded = t.encode(texts)
                decoded = t.decode(coded)
                raw = [x.encode() if x else b"" for x in texts]
                cols = [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64())]
                cols += [pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array([d == r for d, r in zip(decoded, raw, strict=True)], pa.bool_())]
                if ids:
                    flat = np.frombuffer(b"".join(coded), "<i4")
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * ids]
    schema = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give a null text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = table(path)
        for b in slices(batches):
            rows = b.column(1).to_pylist()
            texts = t.decode([np.array(r or [], "<i4").tobytes() for r in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if r is None else x.decode("utf-8", "replace") for r, x in zip(rows, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
