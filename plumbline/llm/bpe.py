"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece holds, at each live token start, the rank of the pair that
begins there; its root is the leftmost minimum. A merge updates three leaves (the merged start, the start that
disappears, the live neighbour before), each in logarithmic time, so a piece of n bytes takes O(n log n).
Encodings of short pieces are remembered per worker up to a fixed number, since words repeat.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bytewords import lanes, same_spans, span_hashes
from plumbline.llm.charclass import SPACE, classes

_NONE, _FAR = 1 << 62, 1 << 40
#: Pieces remembered, bytes of those whose trees are stepped together, and bytes of text encoded together.
_REMEMBERED, _SHORT, _TOGETHER = 500_000, 64, 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece: the whole piece if it is a token, else merges by lowest rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n == 0:
        return ()
    size = 1
    while size < n:
        size *= 2
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    following, before = list(range(1, n + 2)), list(range(-1, n))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            a = a if a < b else b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    def pair(i: int) -> int:
        j = following[i]
        if j >= n:
            return _NONE
        rank = get(piece[i : following[j]])
        return _NONE if rank is None else rank * size + i

    while tree[1] < _NONE:
        i = tree[1] % size
        j = following[i]
        k = following[j]
        following[i] = k
        if k < n:
            before[k] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : following[i]]])
        i = following[i]
    return tuple(ids)


class PairRanks:
    """Ranks of token pairs for whole arrays: a hash table with linear probing over (left id, right id)."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (ranks[token[:cut]] << 20 | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.bits = max(4, (4 * len(found) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _FAR, np.int64)
        keys = np.array([k for k, _ in found], np.int64)
        values = np.array([r for _, r in found], np.int64)
        at = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            slot = at[waiting]
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[waiting[free]]  # of equal slots the last writer stays
            won = free & (self.keys[slot] == keys[waiting])
            self.ranks[slot[won]] = values[waiting[won]]
            waiting = waiting[~won]
            at[waiting] = (at[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        slot = self._slot(keys)
        out = np.full(len(keys), _FAR, np.int64)
        seen = self.keys[slot]
        hit = seen == keys
        out[hit] = self.ranks[slot[hit]]
        look = np.flatnonzero(~hit & (seen >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[look]]
            hit = seen == keys[look]
            out[look[hit]] = self.ranks[slot[look[hit]]]
            look = look[~hit & (seen >= 0)]
        return out


def encode_forest(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> list[tuple[int, ...]]:
    """As encode_piece for each of many short pieces: one segment tree a piece, all stepped together.

    Level 0 of the trees is the root; a step takes the root's leftmost minimum of every live piece, merges
    there and updates three leaves and the nodes above them.
    """
    size = 1
    while size < max(map(len, pieces)):
        size *= 2
    m, levels = len(pieces), size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    padded = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    ids = single[padded]
    column = np.arange(size)
    following = np.tile(column + 1, (m, 1))
    before = np.tile(column - 1, (m, 1))
    tree = np.full((m, 2 * size), _NONE, np.int64)
    if size > 1:
        rank = pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, size - 1)
        rank[column[1:] >= lengths[:, None]] = _FAR
        tree[:, size : 2 * size - 1] = np.where(rank < _FAR, rank * size + column[:-1], _NONE)
    for level in range(levels - 1, -1, -1):
        lo = 1 << level
        below = tree[:, 2 * lo : 4 * lo]
        tree[:, lo : 2 * lo] = np.minimum(below[:, ::2], below[:, 1::2])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[rows, node] = value
        for _ in range(levels):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        j = following[rows, leaf]
        inside = j < lengths[rows]
        value = np.full(len(rows), _NONE, np.int64)
        rank = pairs.of(ids[rows[inside], leaf[inside]], ids[rows[inside], j[inside]])
        value[inside] = np.where(rank < _FAR, rank * size + leaf[inside], _NONE)
        return value

    live = np.flatnonzero(tree[:, 1] < _NONE)
    gone = np.zeros((m, size), bool)
    while len(live):
        rank, i = np.divmod(tree[live, 1], size)
        j = following[live, i]
        k = following[live, j]
        ids[live, i] = rank
        gone[live, j] = True
        following[live, i] = k
        more = k < size
        before[live[more], k[more]] = i[more]
        put(live, j, np.full(len(live), _NONE, np.int64))
        put(live, i, pair(live, i))
        left = before[live, i]
        has = left >= 0
        put(live[has], left[has], pair(live[has], left[has]))
        live = live[tree[live, 1] < _NONE]
    keep = ~gone & (column < lengths[:, None])
    flat = ids[keep].tolist()
    ends = np.cumsum(keep.sum(axis=1)).tolist()
    out, start = [], 0
    for piece, end in zip(pieces, ends, strict=True):
        whole = ranks.get(piece)
        out.append(tuple(flat[start:end]) if whole is None else (whole,))
        start = end
    return out


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Which code points begin a piece of the pattern in SPLIT_RULES, over texts joined at doc_starts."""
    n = len(points)
    kind = classes()[points]
    space = kind == SPACE
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    last = first[1:]
    first = first[:n]
    previous = np.empty(n, np.uint8)
    previous[0] = SPACE
    previous[1:] = kind[:-1]
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    next_space = np.ones(n, bool)
    next_space[:-1] = space[1:]
    # A run of white space is a piece but for its last character, which stands alone or leads the run after it.
    start = space & (first | (previous != SPACE) | (~next_space & ~last))
    run = ~space & (first | (previous != kind))
    start |= run & ~after_blank
    quote = np.flatnonzero(run & ~after_blank & (points == 0x27))
    for ends in CONTRACTIONS:
        k = len(ends)
        at = quote[quote + k < n]
        for j, c in enumerate(ends, 1):
            at = at[(points[at + j] == ord(c)) & ~first[at + j]]
        start[at + 1] = False
        beyond = at + k + 1
        start[beyond[beyond < n]] = True
    return start


# The pattern that piece_starts follows, and what may follow an apostrophe in it.
SPLIT_RULES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated spans."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


class ByteBpe:
    """Encoder and decoder of one rank file.

    Encodings are remembered by the bytes of a piece, in three flat arrays and a dictionary; a full memory starts
    anew, so it is bounded whatever the texts hold. Pieces of a block are grouped by hash, and bytes decide.
    """

    def __init__(self, raw: bytes, pattern: str):
        if pattern != SPLIT_RULES:
            raise ValueError("only the byte-level pattern in SPLIT_RULES is supported")
        self.ranks = parse_ranks(raw)
        self.pairs = PairRanks(self.ranks)
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.fromiter(map(len, tokens), np.int64, size)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        named = [b"%d," % i for i in range(size)]
        self.name_length = np.fromiter(map(len, named), np.int64, size)
        width = int(self.name_length.max(initial=1))
        self.names = np.frombuffer(b"".join(x.ljust(width) for x in named), np.uint8).reshape(size, width)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.filled = self.held = 0

    def _learn(self, pieces: list[bytes]) -> None:
        by_size: dict[int, list[int]] = {}
        ids: list[tuple[int, ...]] = [()] * len(pieces)
        for k, piece in enumerate(pieces):
            if len(piece) <= _SHORT:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(k)
            else:
                ids[k] = encode_piece(piece, self.ranks)
        for same in by_size.values():
            for at in range(0, len(same), 8192):
                part = same[at : at + 8192]
                for k, found in zip(part, encode_forest([pieces[k] for k in part], self.ranks, self.pairs), strict=True):
                    ids[k] = found
        new = np.fromiter(chain.from_iterable(ids), np.int32)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        n, m = len(self.slots), len(ids)
        while len(self.flat) < self.filled + len(new):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.begin) < n + m:
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
        self.flat[self.filled : self.filled + len(new)] = new
        self.begin[n : n + m] = self.filled + np.cumsum(counts) - counts
        self.count[n : n + m] = counts
        self.filled += len(new)
        self.slots.update(zip(pieces, range(n, n + m), strict=True))
        self.held += sum(map(len, pieces))

    def encode_block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts one after the other, and the n + 1 places where each text's ids begin."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        joined = b"".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(joined, np.uint8)
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        doc_at = bounds[:-1][sizes > 0]
        first = lead[piece_starts(points, np.searchsorted(lead, doc_at))]
        end = np.append(first[1:], len(raw))
        _, where, which = np.unique(span_hashes(raw, first, end), return_index=True, return_inverse=True)
        own, size = lanes(raw), end - first
        other = np.flatnonzero(~same_spans(own, first, size, own, first[where][which], size[where][which]))
        if len(other):  # pieces that only share the hash of another stand for themselves
            which[other] = len(where) + np.arange(len(other))
            where = np.concatenate((where, other))
        if len(self.slots) > _REMEMBERED or self.filled > 8 * _REMEMBERED or self.held > 32 * _REMEMBERED:
            self._forget()
        pieces = [joined[a:b] for a, b in zip(first[where].tolist(), end[where].tolist(), strict=True)]
        slot = list(map(self.slots.get, pieces))
        if None in slot:
            self._learn(list(dict.fromkeys(p for p, s in zip(pieces, slot, strict=True) if s is None)))
            slot = list(map(self.slots.get, pieces))
        slots = np.array(slot, np.int64)[which]
        counts = self.count[slots]
        ids = self.flat[gathered(self.begin[slots], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(first, bounds)]

    def decode_block(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after the other, and the n + 1 places where each text's bytes begin."""
        length = self.token_length[ids]
        out = self.token_bytes[gathered(self.token_start[ids], length)]
        return out, np.concatenate(([0], np.cumsum(length)))[bounds]

    def listed(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma after it, and the n + 1 places where each text's begin."""
        length = self.name_length[ids]
        out = self.names[ids][np.arange(self.names.shape[1]) < length[:, None]]
        return out, np.concatenate(([0], np.cumsum(length)))[bounds]

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Token ids of each UTF-8 text; some megabytes are encoded together and longer texts are cut where a piece surely begins."""
        for held in blocks(texts):
            if isinstance(held, bytes):
                yield np.concatenate([self.encode_block([part])[0] for part in cut(held)])
            else:
                ids, bounds = self.encode_block(held)
                yield from (ids[bounds[k] : bounds[k + 1]] for k in range(len(held)))

    def encode(self, raw: bytes) -> np.ndarray:
        return next(self.encode_all([raw]))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_block(ids, np.array([0, len(ids)]))[0].tobytes()


def blocks(texts: Iterable[bytes]) -> Iterator[list[bytes] | bytes]:
    """Lists of texts of some megabytes in all; a longer text comes by itself, not in a list."""
    held, size = [], 0
    for raw in texts:
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        if held and size + len(raw) > _TOGETHER:
            yield held
            held, size = [], 0
        if len(raw) > _TOGETHER:
            yield raw
        else:
            held.append(raw)
            size += len(raw)
    if held:
        yield held


def cut(raw: bytes) -> Iterator[bytes]:
    """Parts of a long text: a blank after a letter or digit of ASCII begins a piece whatever stands around it."""
    at = 0
    for found in _CUT.finditer(raw):
        if found.start() + 1 - at >= _TOGETHER:
            yield raw[at : found.start() + 1]
            at = found.start() + 1
    yield raw[at:]


_CUT = re.compile(rb"[0-9A-Za-z](?= )")


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(raw: bytes, pattern: str) -> ByteBpe:
    """The worker's own coder for a rank file, made once."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(raw, pattern)
    return _LOADED[key]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; a null is empty."""
    for at in range(0, len(column), 256):
        for value in column.slice(at, 256).cast(pa.large_binary()).to_pylist():
            yield value or b""


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ok boolean"


def vocabulary(spark: SparkSession, path: str):
    """The rank file, broadcast: a vocabulary file has a bounded size, and executors need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_digests(spark: SparkSession, docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, ok (the round trip gave the text back).

    Encodes each whole text, decodes the ids again. A null text is empty: no tokens. A null doc_id stays null,
    repeated rows stay, other columns are not read, an empty table gives an empty table.
    """
    ranks = vocabulary(spark, vocabulary_path)

    def run(batches):
        coder = loaded(ranks.value, pattern)
        sha = lambda part: hashlib.sha256(part).hexdigest()
        for batch in batches:
            counts, ids_out, decoded_out, ok = [], [], [], []
            for held in blocks(raw_texts(batch.column(1))):
                if isinstance(held, bytes):
                    held = [held]
                    ids = coder.encode(held[0])
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = coder.encode_block(held)
                names, name_at = coder.listed(ids, bounds)
                text, text_at = coder.decode_block(ids, bounds)
                names, text = names.tobytes(), text.tobytes()
                counts += np.diff(bounds).tolist()
                for k, raw in enumerate(held):
                    ids_out.append(sha(names[name_at[k] : max(name_at[k + 1] - 1, name_at[k])]))
                    decoded = text[text_at[k] : text_at[k + 1]]
                    decoded_out.append(sha(decoded))
                    ok.append(decoded == raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_out, pa.string()), pa.array(decoded_out, pa.string()), pa.array(ok, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ok"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, _DIGEST)


def encode_ids(spark: SparkSession, docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) for each row of ``docs``, with the same rules as encode_digests."""
    ranks = vocabulary(spark, vocabulary_path)

    def run(batches):
        coder = loaded(ranks.value, pattern)
        for batch in batches:
            ids = list(coder.encode_all(raw_texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(spark: SparkSession, encoded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, text for each row of ``encoded(doc_id, ids)``; null ids give a null text."""
    ranks = vocabulary(spark, vocabulary_path)

    def run(batches):
        coder = loaded(ranks.value, pattern)
        for batch in batches:
            texts = [None if ids is None else coder.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id long, text string")
