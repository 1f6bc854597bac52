"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's texts are cut before the last blank of every run, as no piece has a blank behind another
character; the distinct words that a task hasn't met yet are written one after another and indexed by a
suffix array (ordered by as many characters as the longest piece has). Every piece of the vocabulary is
found by binary search, all pieces at once, which gives the range of suffixes that begin with it; each
occurrence is an edge from where it begins to where it ends. Edges are sorted by their end and relaxed in
that order. For BPE, an edge is taken if its piece may follow the piece that ends where it begins: undoing
the later of the merges on either side of their border, step by step, must not show a pair there that would
have merged before. Exactly one edge into each position is taken, and following them back gives the ids
that merging by score gives. Characters without a piece become their UTF-8 bytes.

Pieces of blanks alone share one lowest score; what is left of a run of blanks once words are merged is
merged pair by pair from the left.

Defined results: a null text encodes to null, an empty one to no ids. Decoding gives the text back, but
U+2581 comes back as a blank, which it is to this vocabulary. Repeated rows give equal ids; other columns
pass through, and a column of the name that is added is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import ship

BLANK = "▁"
#: Words kept per task with their ids.
CACHE = 600_000
NO_PIECE = -1


class Vocabulary:
    """The pieces of a SentencePiece BPE model, read through its public library, as plain arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = []
        self.bytes_first = model.piece_to_id("<0x00>")
        usable, score = [], []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            self.pieces.append(p)
            usable.append(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
            score.append(model.get_score(i))
        self.usable = np.array(usable)
        ids = {p: i for i, p in enumerate(self.pieces) if self.usable[i]}
        self.runs = {p: i for p, i in ids.items() if not p.strip(BLANK)}
        if any(BLANK in p[1:] for p in ids if p not in self.runs):
            raise ValueError("a piece has a blank behind another character")
        # Single characters rank before all merges, merges by score.
        order = sorted(ids.values(), key=lambda i: (len(self.pieces[i]) > 1, -score[i], i))
        self.rank = np.full(len(self.pieces), -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.arange(len(self.pieces)), np.arange(len(self.pieces))
        pairs = {}
        for p, i in ids.items():
            if len(p) > 1 and p not in self.runs:
                parts = [ids.get(c, NO_PIECE) for c in p]
                last = None
                while len(parts) > 1 and NO_PIECE not in parts:
                    best = min(((self.rank[j], k, j) for k in range(len(parts) - 1) if (j := ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])) is not None), default=None)
                    if best is None:
                        break
                    last = parts[best[1] : best[1] + 2]
                    parts[best[1] : best[1] + 2] = [best[2]]
                if len(parts) == 1 and last:
                    self.left[i], self.right[i] = last
                    pairs[last[0] * len(self.pieces) + last[1]] = i
                else:
                    self.usable[i] = False  # no merges lead to it
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys], np.int64)
        self.matched = np.array([i for p, i in ids.items() if p not in self.runs or len(p) == 1 if self.usable[i]])
        self.longest = max(len(self.pieces[i]) for i in self.matched)
        chars = np.zeros((len(self.matched), self.longest), np.uint32)
        for r, i in enumerate(self.matched):
            chars[r, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.chars = chars
        self.lengths = np.array([len(self.pieces[i]) for i in self.matched])
        self.bytes_of = [bytes([i - self.bytes_first]) if 0 <= i - self.bytes_first < 256 and self.bytes_first > 0 else self.pieces[i].replace(BLANK, " ").encode() if self.usable[i] or self.pieces[i] in self.runs else b"" for i in range(len(self.pieces))]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand right behind piece a in merged text."""
        key, back = np.unique(a * len(self.pieces) + b, return_inverse=True)
        x, y = key // len(self.pieces), key % len(self.pieces)
        out = np.ones(len(key), bool)
        live = np.arange(len(key))
        # A pair at the border merges before what was undone last: ranks below it, and on the left border equal ones too.
        limit = np.full(len(key), 2 * len(self.pieces), np.int64)
        while len(live):
            k = x[live] * len(self.pieces) + y[live]
            at = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
            merged = self.pair_keys[at] == k
            early = merged & (2 * self.rank[self.pair_ids[at]] < limit[live])
            out[live[early]] = False
            live = live[~early]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            can_x, can_y = self.left[x[live]] != x[live], self.left[y[live]] != y[live]
            undo_x = can_x & (~can_y | (rx > ry))
            undo_y = can_y & ~undo_x
            # Of equal merges the left one is first: the pair may equal the rank of what was undone on its right.
            limit[live] = np.where(undo_x, 2 * rx, np.where(undo_y, 2 * ry + 1, 0))
            x[live] = np.where(undo_x, self.right[x[live]], x[live])
            y[live] = np.where(undo_y, self.left[y[live]], y[live])
            live = live[undo_x | undo_y]
        return out[back]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text ordered by the `depth` characters from there, by doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    h = 1
    while True:
        later = np.zeros(len(rank), np.int64)
        if h < depth:
            later[:-h] = rank[h:] if h < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + later
        order = np.argsort(key, kind="stable")
        if h >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_[1:] != sorted_[:-1])])
        h *= 2


def occurrences(text: np.ndarray, order: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every pattern (a row of chars, of its length) the range of suffixes in order that begin with it."""
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(order), np.int64)
    padded = np.concatenate([text, np.zeros(chars.shape[1], text.dtype)])

    def bound(live: np.ndarray, d: int, after: bool) -> np.ndarray:
        lo, hi, c = low[live], high[live], chars[live, d]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
            right = open_ & ((seen <= c) if after else (seen < c))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    for d in range(chars.shape[1]):
        live = np.flatnonzero((lengths > d) & (low < high))
        if not len(live):
            break
        first, end = bound(live, d, False), bound(live, d, True)
        low[live], high[live] = first, end
    return low, high


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}  # 32-bit ids

    def run(self, n: int) -> list[int]:
        """Ids of n blanks by themselves: the leftmost pair whose union is a piece merges first, again and again."""
        sizes, parts = {len(p) for p in self.v.runs}, []
        # Left of the next blank nothing merges any more, so what merges first is always the last two parts.
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in sizes:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.v.runs[BLANK * x] for x in parts]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word with one blank before it."""
        v = self.v
        joined = BLANK + BLANK.join(words)
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(text)
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])[: len(words) + 1]
        order = suffix_order(text, v.longest)
        low, high = occurrences(text, order, v.chars, v.lengths)
        size = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(size)), size)
        start = order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        bare = np.ones(n, bool)  # characters without a piece
        bare[start[v.lengths[piece] == 1]] = False
        start = np.concatenate([start, np.flatnonzero(bare)])
        end = start + np.concatenate([v.lengths[piece], np.ones(int(bare.sum()), np.int64)])
        piece = np.concatenate([v.matched[piece], np.full(int(bare.sum()), NO_PIECE)])
        word_begin = np.repeat(begin[:-1], np.diff(begin))  # of each position
        local = end - word_begin[start]
        by_end = np.argsort(local, kind="stable")
        start, end, piece, local = start[by_end], end[by_end], piece[by_end], local[by_end]
        last, came = np.full(n + 1, NO_PIECE, np.int64), np.zeros(n + 1, np.int64)
        cuts = np.searchsorted(local, np.arange(1, int(local[-1]) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            before = np.where(s == word_begin[s], NO_PIECE, last[s])
            good = (before == NO_PIECE) | (p == NO_PIECE)
            ask = np.flatnonzero(~good)
            if len(ask):
                good[ask] = v.follows(before[ask], p[ask])
            last[e[good]], came[e[good]] = p[good], s[good]
        # Back from the end of every word, all words at once.
        at, live = begin[1:].copy(), np.arange(len(words))
        steps = []
        while len(live):
            e = at[live]
            steps.append((live, last[e], came[e]))
            at[live] = came[e]
            live = live[at[live] > begin[live]]
        w = np.concatenate([a for a, _, _ in steps])
        p = np.concatenate([b for _, b, _ in steps])
        s = np.concatenate([c for _, _, c in steps])
        by = np.lexsort((s, w))
        w, p, s = w[by], p[by], s[by]
        if (p == NO_PIECE).any():
            split = [[int(x)] if x != NO_PIECE else [v.bytes_first + b for b in joined[c].encode()] for x, c in zip(p, s)]
            p, w = np.array([y for x in split for y in x]), np.repeat(w, [len(x) for x in split])
        data, cuts = p.astype("<i4").tobytes(), [0, *(4 * np.searchsorted(w, np.arange(1, len(words)))).tolist(), 4 * len(p)]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [self._units(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        fresh = list(dict.fromkeys(u for x in units for u in x if u not in known))
        words = [u for u in fresh if u[0] != " "] + [u.lstrip(" ") for u in fresh if u[0] == " " and u.strip(" ")]
        words = [u for u in dict.fromkeys(words) if u not in known]
        if words:
            known.update(zip(words, self._encode_words(words)))
        lone = np.int32(self.v.runs[BLANK]).tobytes()
        for u in fresh:
            if u[0] == " ":
                word = u.lstrip(" ")
                own, n = known[word] if word else b"", len(u) - len(word)
                if own[:4] == lone:  # the word's own blank merged with nothing, so it belongs to the run
                    own, n = own[4:], n + 1
                known[u] = np.array(self.run(n), "<i4").tobytes() + own
        return [np.frombuffer(b"".join([known[u] for u in x]), "<i4") for x in units]

    @staticmethod
    def _units(text: str) -> list[str]:
        """Words, each to be read with a blank before it; further blanks of a run stand before its word."""
        if not text:
            return []
        parts = text.replace(BLANK, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        return out + [" " * run] if run else out

    def decode(self, ids: np.ndarray) -> str:
        table = self.v.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with a column piece_ids (array<int>) of the ids of `text`."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(held.value)
        for batch in column:
            found = iter(codec.encode([x for x in batch if x is not None]))
            yield pd.Series([None if x is None else next(found) for x in batch], dtype=object)

    return docs.withColumn("piece_ids", ids("text"))


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows with a column decoded (string) of the text that piece_ids stand for."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(held.value)
        for batch in column:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x)) for x in batch], dtype=object)

    return rows.withColumn("decoded", text("piece_ids"))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip: whether decoding gives the
    text back. Ids stay in the task that makes them. A null text counts as empty."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = codec.encode(texts)
            same = [codec.decode(i) == t.replace(BLANK, " ") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
