"""Token counts by a compiled finite-state tokenizer.

The pre-tokenizer's pattern and the byte-pair merges are compiled, transition by transition as texts need
them, into one deterministic transducer over characters. A state holds all that the future can depend on:
what kind of piece is open, and for each place in it from which a token could still be running, the node of
the vocabulary trie reached, the token that ends at that place and how many tokens lie between it and now.
Each transition is annotated with the change in the number of tokens if the text ended there.

A token t ends at a place iff it is itself a result of the merges and stands next to the token u before it
in the merges' result for the two; one such t exists at each place, so the automaton is deterministic.

Texts are cut into chunks. A chunk's map takes an entry state to an exit state and a change in the number of tokens.
A chunk that begins where a piece surely begins has a constant map; the map of any other is kept for the entries it
can have: one guessed from the characters before it, and the exits of the map before it. Maps are composed in a
doubling prefix scan, which gives each text's count. All chunks of a block advance together in numpy, one character a
step. A long text is taken in slices that hand their last state on, and the compiled part of the automaton is
forgotten when it has grown to a fixed size, so memory is bounded whatever the texts hold.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.charclass import LETTER, NUMBER, OTHER, SPACE, classes

#: Characters of a chunk, of a block and of the shortest slice of a long text, columns of the transition table (further
#: characters go through a dictionary), states at which the table starts anew, and rounds in which maps are widened.
_CHUNK, _BLOCK, _SLICE, _COLUMNS, _STATES, _ROUNDS = 256, 1_500_000, 16_384, 128, 300_000, 8
_SHIFT, _BIAS = 8, 128

# What may follow an apostrophe that begins a piece.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary, trie and merge results of a tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE with the standard pattern is supported")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        text = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.text = text
        vocab = model["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = {text[i][0]: i for i in text if len(text[i]) == 1}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, t in sorted(text.items()):
            if self.encode(t) != [i]:
                continue
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][b]
            self.token[node] = i
        self.beside: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> list[int]:
        """Merges of a short piece, lowest rank and leftmost first."""
        ids = [self.single[b] for b in piece]
        while len(ids) > 1:
            best = min(((self.merge.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(ids, ids[1:], strict=False))), key=lambda x: (x[0][0], x[1]))
            (rank, new), k = best
            if rank == 1 << 60:
                break
            ids[k : k + 2] = [new]
        return ids

    def adjacent(self, u: int, t: int) -> bool:
        """Whether u and t stay as they are when their bytes are encoded together."""
        key = (u, t)
        known = self.beside.get(key)
        if known is None:
            known = self.beside[key] = self.encode(self.text[u] + self.text[t]) == [u, t]
        return known


#: The merge state of an empty piece: at the root of the trie, no token before, no tokens since.
_EMPTY = ((0, -1, 0),)
#: Kinds of states: at a piece's beginning; in letters, numbers or others; after an apostrophe that began a piece, or it and r, v or l; in white space.
_BEGIN, _RUN, _QUOTE, _QUOTED, _BLANKS = range(5)


class _Full(Exception):
    """The compiled part of the automaton has reached its bound."""


class Transducer:
    """The lazily compiled automaton; states are numbered as they are met."""

    def __init__(self, raw: bytes):
        self.merges = Merges(raw)
        self.kinds = classes()
        self.column = np.full(0x110000, -1, np.int32)
        self.columns = 0
        self.bounded = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((1 << 12, _COLUMNS), -1, np.int32)
        self.rare: dict[tuple[int, int], int] = {}
        if len(self.merges.beside) > 4 * _STATES:
            self.merges.beside.clear()
        self.begin = self._intern((_BEGIN,))

    def _intern(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        return k

    def _read(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The merge state after more characters of a piece, and the change in its number of tokens."""
        m, change = self.merges, 0
        for b in char.encode():
            found = None
            moved = []
            for node, before, since in state:
                node = m.trie[node].get(b)
                if node is None:
                    continue
                t = m.token[node]
                if found is None and t >= 0 and (before < 0 or m.adjacent(before, t)):
                    found = (t, since)
                if m.trie[node]:
                    moved.append((node, before, since))
            t, since = found
            grown = 1 - since
            change += grown
            state = (*((node, before, s + grown) for node, before, s in moved), (0, t, 0))
        return state, change

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The next state, and the change in the number of tokens if the text ended after char."""
        kind = int(self.kinds[ord(char)])
        what = state[0]
        if what == _QUOTE:
            if char in SHORT_ENDINGS:
                _, change = self._read(state[1], char)
                return (_BEGIN,), change
            if any(e[0] == char for e in LONG_ENDINGS):
                inner, alone = self._read(_EMPTY, char)
                joined, change = self._read(state[1], char)
                return (_QUOTED, char, inner, joined, change - alone), alone
            state = (_RUN, OTHER, state[1])
        elif what == _QUOTED:
            if state[1] + char in LONG_ENDINGS:
                _, change = self._read(state[3], char)
                return (_BEGIN,), state[4] + change
            state = (_RUN, LETTER, state[2])
        if kind == SPACE:
            # Of a run of blanks: its merge state, whether the last is a space, what the last added, and its own tokens.
            whole, change = self._read(state[1] if state[0] == _BLANKS else _EMPTY, char)
            _, alone = self._read(_EMPTY, char)
            return (_BLANKS, whole, char == " ", change, alone), change
        if state[0] == _RUN and state[1] == kind:
            inner, change = self._read(state[2], char)
            return (_RUN, kind, inner), change
        settled = 0
        if state[0] == _BLANKS:
            _, _, led, added, alone = state
            settled = alone - added
            if led:
                inner, change = self._read(self._read(_EMPTY, " ")[0], char)
                return (_RUN, kind, inner), settled + change
        inner, change = self._read(_EMPTY, char)
        if char == "'":
            return (_QUOTE, inner), settled + change
        return (_RUN, kind, inner), settled + change

    def columns_of(self, points: np.ndarray) -> np.ndarray:
        """Table columns of characters; those past the last column are numbered on from there."""
        new = np.unique(points[self.column[points] < 0]) if len(points) else points
        for p in new.tolist():
            self.column[p] = self.columns
            self.columns += 1
        return self.column[points]

    def _fill(self, states: np.ndarray, columns: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(states), np.int32)
        memo: dict[tuple[int, int], int] = {}
        for k, (s, c, p) in enumerate(zip(states.tolist(), columns.tolist(), points.tolist(), strict=True)):
            packed = self.rare.get((s, c)) if c >= _COLUMNS else memo.get((s, c))
            if packed is None:
                state, change = self.step(self.states[s], chr(p))
                packed = self._intern(state) << _SHIFT | (change + _BIAS)
                if c >= _COLUMNS:
                    self.rare[s, c] = packed
                else:
                    memo[s, c] = packed
                    self.table[s, c] = packed
            out[k] = packed
        return out

    def run(self, points: np.ndarray, columns: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and token changes of chunks, all advanced together; longest first inside."""
        order = np.argsort(-length, kind="stable")
        at, left, state = start[order], length[order], entry[order].astype(np.int64)
        count = np.zeros(len(at), np.int64)
        active = len(at)
        for j in range(int(left[0]) if len(left) else 0):
            while active and left[active - 1] <= j:
                active = int(np.searchsorted(-left[:active], -j, side="left"))
            here = at[:active] + j
            c = columns[here]
            s = state[:active]
            packed = np.where(c < _COLUMNS, self.table[s, np.minimum(c, _COLUMNS - 1)], -1)
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                packed[missing] = self._fill(s[missing], c[missing], points[here[missing]])
                if self.bounded and max(len(self.states), len(self.rare)) > _STATES:
                    raise _Full
            state[:active] = packed >> _SHIFT
            count[:active] += (packed & ((1 << _SHIFT) - 1)) - _BIAS
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special token's string is one token, and the parts around it are texts by themselves."""
        parts, owner, total = texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
        if any(s in text for text in texts for s in self.merges.specials):
            parts, owners = [], []
            for k, text in enumerate(texts):
                pieces = [text]
                for special in self.merges.specials:
                    pieces = [q for p in pieces for q in p.split(special)]
                total[k] = len(pieces) - 1
                parts += pieces
                owners += [k] * len(pieces)
            owner = np.array(owners)
        held, size = [], 0
        for k, part in enumerate(parts):
            if len(part) > _BLOCK:
                total[owner[k]] += self._count_long(part)
                continue
            if size + len(part) > _BLOCK:
                np.add.at(total, owner[held], self._count_all([parts[h] for h in held]))
                held, size = [], 0
            held.append(k)
            size += len(part)
        np.add.at(total, owner[held], self._count_all([parts[h] for h in held]))
        return total

    def _count_all(self, parts: list[str]) -> np.ndarray:
        """Tokens of each of some short texts, in halves where they need more states than are kept."""
        joined = "".join(parts)
        if not joined:
            return np.zeros(len(parts), np.int64)
        try:
            return self._count(joined, np.fromiter(map(len, parts), np.int64, len(parts)), (_BEGIN,))[0]
        except _Full:
            self._forget()
        if len(parts) == 1:
            return np.array([self._count_long(joined)])
        half = len(parts) // 2
        return np.concatenate((self._count_all(parts[:half]), self._count_all(parts[half:])))

    def _count_long(self, text: str) -> int:
        """Tokens of one text, slice by slice; the state, not its number, is handed on."""
        state, total, at, size = (_BEGIN,), 0, 0, min(_BLOCK, max(len(text) // 2, _SLICE))
        while at < len(text):
            part = text[at : at + size]
            self.bounded = size > _SLICE
            try:
                counts, state = self._count(part, np.array([len(part)]), state)
                total, at = total + int(counts[0]), at + size
            except _Full:
                size = max(size // 2, _SLICE)
                self._forget()
            finally:
                self.bounded = True
            if max(len(self.states), len(self.rare)) > _STATES:
                self._forget()
        return total

    def _count(self, joined: str, sizes: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        """Changes in the number of tokens over each text, the first of which begins in a state, and the last state."""
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        n = len(points)
        columns = self.columns_of(points)
        begins = np.cumsum(sizes) - sizes
        # Chunk borders: text starts, and near each multiple of the chunk length the next sure beginning of a piece.
        blank = points == 0x20
        sure = np.zeros(n + 1, bool)
        sure[1:n] = blank[1:] & (self.kinds[points[:-1]] != SPACE)
        sure_at = np.flatnonzero(sure)
        marks = np.arange(_CHUNK, n, _CHUNK)
        nearest = np.append(sure_at, n)[np.searchsorted(sure_at, marks)]
        border = np.where(nearest - marks < _CHUNK, nearest, marks)
        first = np.unique(np.concatenate((begins[sizes > 0], border[border < n])))
        length = np.diff(np.append(first, n))
        text = np.searchsorted(begins, first, side="right") - 1
        opens = np.zeros(n + 1, bool)
        opens[begins] = True
        constant = sure[first] | opens[first]
        entry = np.full(len(first), self.begin, np.int64)
        entry[0] = self._intern(state)
        loose = np.flatnonzero(~constant)
        if len(loose):  # guess from some characters before
            back = np.minimum(first[loose] - begins[text[loose]], 32)
            entry[loose], _ = self.run(points, columns, first[loose] - back, back, entry[loose])
        maps = Maps(text, constant, lambda k, e: self.run(points, columns, first[k], length[k], e))
        exits, totals = maps.prefixes(entry)
        out = np.zeros(len(sizes), np.int64)
        last = np.append(text[1:] != text[:-1], True)
        out[text[last]] = totals[last]
        return out, self.states[exits[-1]]


class Maps:
    """State maps of chunks: rows of chunk, entry, exit and change in tokens; a constant map has the entry -1."""

    def __init__(self, text: np.ndarray, constant: np.ndarray, run):
        self.text, self.constant, self.run = text, constant, run
        self.chunk = self.entry = self.exit = self.change = np.zeros(0, np.int64)

    @staticmethod
    def _key(chunk: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return chunk << 32 | (entry + 1)

    def _add(self, chunk: np.ndarray, entry: np.ndarray) -> None:
        """Runs chunks from entries and adds the rows."""
        exits, change = self.run(chunk, entry)
        chunk, entry = np.concatenate((self.chunk, chunk)), np.concatenate((self.entry, np.where(self.constant[chunk], -1, entry)))
        order = np.argsort(self._key(chunk, entry))
        self.chunk, self.entry = chunk[order], entry[order]
        self.exit, self.change = np.concatenate((self.exit, exits))[order], np.concatenate((self.change, change))[order]

    def _missing(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries that the maps before can lead to and the maps do not have."""
        row = np.flatnonzero(self.chunk + 1 < len(self.text))
        row = row[~self.constant[self.chunk[row] + 1]]
        wanted = np.unique(self._key(self.chunk[row] + 1, self.exit[row]))
        wanted = wanted[~np.isin(wanted, self._key(self.chunk, self.entry))]
        return wanted >> 32, (wanted & 0xFFFFFFFF) - 1

    def prefixes(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk, the state after it and the change in tokens from its text's beginning.

        Maps get the guessed entries first and are widened, all chunks at once, by what the maps before lead to. Should
        that not end in some rounds, the chunks at which the composed maps stop are run from their true entries.
        """
        self._add(np.arange(len(self.text)), entry)
        for _ in range(_ROUNDS):
            chunk, needed = self._missing()
            if not len(chunk):
                break
            self._add(chunk, needed)
        while True:
            known, exits, totals = self._composed()
            open_ = np.flatnonzero(~known)
            if not len(open_):
                return exits, totals
            front = open_[known[open_ - 1]]  # a text's first chunk is always known
            self._add(front, exits[front - 1])

    def _composed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composes maps in doubling steps; a segment that ends at a chunk grows by the segment that ends before it."""
        n = len(self.text)
        begin = np.searchsorted(self.text, self.text)
        low, constant = np.arange(n), self.constant.copy()
        chunk, entry, exit_, change = self.chunk, self.entry, self.exit, self.change
        while True:
            grow = np.flatnonzero(low > begin)
            if not len(grow):
                break
            left = low[grow] - 1
            a, b = np.searchsorted(chunk, left), np.searchsorted(chunk, left, side="right")
            size = b - a
            row = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            at = np.repeat(grow, size)
            key, wanted = self._key(chunk, entry), self._key(at, np.where(constant[at], -1, exit_[row]))
            found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[found] == wanted
            row, at, found = row[hit], at[hit], found[hit]
            stay = np.flatnonzero(~np.isin(chunk, grow))
            parts = [(chunk[stay], at), (entry[stay], entry[row]), (exit_[stay], exit_[found]), (change[stay], change[row] + change[found])]
            chunk, entry, exit_, change = (np.concatenate(p) for p in parts)
            order = np.argsort(self._key(chunk, entry), kind="stable")
            chunk, entry, exit_, change = chunk[order], entry[order], exit_[order], change[order]
            low[grow], constant[grow] = low[left], constant[left]
        known, exits, totals = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        known[chunk], exits[chunk], totals[chunk] = True, exit_, change
        return known, exits, totals


_LOADED: dict[str, Transducer] = {}


def loaded(raw: bytes) -> Transducer:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(raw)
    return _LOADED[key]


def _decoded(column: pa.Array) -> Iterable[tuple[str, int]]:
    for at in range(0, len(column), 256):
        for value in column.slice(at, 256).cast(pa.large_binary()).to_pylist():
            value = value or b""
            yield value.decode("utf-8", "replace"), len(value)


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is empty: no bytes, no tokens. A null doc_id stays null, repeated rows stay, other columns are not
    read, an empty table gives an empty table. The tokenizer file is broadcast: its size is bounded.
    """
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        machine = loaded(spec.value)
        for batch in batches:
            sizes, counts, held, size = [], [], [], 0
            for text, n in _decoded(batch.column(1)):
                if held and size + n > _BLOCK:
                    counts.append(machine.count(held))
                    held, size = [], 0
                held.append(text)
                sizes.append(n)
                size += n
            counts.append(machine.count(held))
            tokens = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
