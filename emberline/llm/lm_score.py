"""A hierarchical Pitman-Yor language model, its seating sampled by Gibbs, over words and their contexts.

Tokens are a text's words, A-Z lowered, and one end. A token's context is the whole word before it, or the
beginning. Every context is a restaurant, however rare; its parent is that of all contexts with the same
last byte (0 at the beginning), and all of those share one parent, the root. The customers of a parent are
the tables of the restaurants below it. The root's base is an open vocabulary, so every known word has one
table there and what the root keeps for new tables is the probability of any unknown word. Probabilities
of known words and of the unknown add up to 1 in every context. A context that was never seen has the
probabilities of its parent.

A Gibbs sweep takes, for each dish of each restaurant, all its customers out and seats them anew one by one,
given the tables of all others; a customer opens a table with the probability of the Chinese restaurant
process. From the 2 * BLOCK-th customer of a dish on, they are seated in blocks of a share of 1 / BLOCK of those
before, by a binomial draw with the middle one's probability. A sweep seats the words' contexts given the sweep before, then ABOVE times the restaurants
above; tasks see the totals of the draw before. Probabilities are averaged over the sweeps after the first
BURN. Discounts are n1 / (n1 + 2 n2) of the counts of counts. Draws depend on the words and the number of the
sweep alone, so that every task which needs a dish's tables draws the same ones, also when it runs again.

The corpus is cut into pieces of about PIECE tokens, each one row: its distinct words and pairs, and its
texts as numbers of pairs. A piece deals the keys of its pairs to parts by their hash, so no word is a hot key;
a part adds up their counts over all pieces and answers each piece in the order it asked, once: from then on they
are one block of the piece's own. In every sweep a
piece draws the tables of its pairs, and of what it counts (one of the pieces that hold a pair does) hands
on the sums of each word to the word's range, which seats the restaurants above and answers likewise. What a
task holds is bounded by PIECE, PART and RANGE; only 256 totals of a draw go to the driver. A single text is
never cut, so a piece is as long as its longest text at least.

Defined results: a null, empty or blank text is its end alone. Without training tokens all words are
unknown. A null doc_id counts as not held out. Repeated rows count and score each for itself. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import bytewords as bw
from emberline.llm.blocks import ascending, cuts_of, gaps, joined, numbered, order_of, pack, pack_sorted, unpack, unpack_all, unpack_sorted
from emberline.llm.common import Scratch, ship

#: Tokens of a piece, and for each part of the pairs and each range of the words.
PIECE, PART, RANGE = 1_000_000, 1_000_000, 1_000_000
SWEEPS, BURN, ABOVE = 3, 1, 1
BLOCK = 8
#: The pieces are swept and scored in so many waves.
WAVES = 3
#: Bytes of text that are cut into tokens at once (unless one text is longer), and pairs that are seated at once.
TEXTS, SEATED = 1 << 18, 1 << 16
#: How Scratch keeps rows of blocks: they are compressed already, and a row group ends after a few of them, so that
#: neither who writes nor who reads holds a whole task's blocks.
BLOCKS = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
STRENGTH = 1.0
END = np.int64(0x7E57AB1E0E0D1CE5)
#: The word before the first.
BEGIN = np.int64(0)
#: Kinds of rows.
REQUEST, COUNTS, KNOWN, TABLES, WORDS = 0, 1, 2, 100, 200
_ROW = "kind int, part int, piece long, block binary"


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and parents' contexts (the last byte before) of all tokens, and the first token of each text (n + 1 values)."""
    keys, first, starts, ends = bw.word_keys(raw, offsets)
    n, docs = len(keys), len(offsets) - 1
    last = bw.LOWER[raw[ends - 1]] if n else np.zeros(0, np.uint8)
    out, u = np.full(n + docs, END, np.int64), np.zeros(n + docs, np.uint8)
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(first))
    out[at] = keys.view(np.int64)
    u[at + 1] = last  # a word's last byte is the context of what follows it, be it a word or the end
    return out, u, first + np.arange(docs + 1)


def before(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The key of the word before each token."""
    v = np.empty_like(keys)
    v[1:] = keys[:-1]
    v[first[:-1]] = BEGIN
    return v


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return bw.mix(bw.mix(v.view(bw.U)) * bw.BASE + w.view(bw.U))


def trimmed(f: Callable) -> Callable:
    """f of one or two tables, after which the allocators give back what it has freed: workers stay, and would hold
    it while others run."""

    def one(x: pa.Table) -> pa.Table:
        try:
            return f(x)
        finally:
            trim()

    def two(x: pa.Table, y: pa.Table) -> pa.Table:
        try:
            return f(x, y)
        finally:
            trim()

    return two if f.__code__.co_argcount == 2 else one  # Spark counts arguments


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        give_back(0)


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by place."""
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)[:n]


# --- Pieces.


def ranks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words by falling number of training tokens, and the place of each among them: small numbers are common."""
    by = falling(n)
    rank = np.empty(len(n), np.int64)
    rank[by] = np.arange(len(n))
    return by, rank


def by_last(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words by their last bytes, and the place of each among them."""
    by = np.argsort(last, kind="stable")
    place = np.empty(len(last), np.int64)
    place[by] = np.arange(len(last))
    return by, place


def _piece(number: int, held: list) -> pa.RecordBatch:
    """One row for texts (ids, held out, keys, parents' contexts, first tokens), which are taken out of the list."""
    ids = pa.concat_arrays([x[0] for x in held])
    out = np.concatenate([x[1] for x in held])
    size = np.concatenate([np.diff(x[4]) for x in held])
    first = np.concatenate([[0], np.cumsum(size)])
    k, u = np.concatenate([*(x[2] for x in held), [BEGIN]]), np.concatenate([x[3] for x in held])
    held.clear()
    words, w = numbered(k.view(bw.U))
    begin, w = w[-1], w[:-1]
    v = k[:-1]  # the words before are written over the keys
    v[1:] = w[:-1]
    v[first[:-1]] = begin
    last = np.zeros(len(words), np.uint8)
    last[v] = u
    by, place = by_last(last)
    v = place[v]
    del k
    v += w * len(words)
    pairs, of = numbered(v)
    del v
    learned = np.repeat(~out, size)
    n = np.bincount(w[learned], minlength=len(words))
    n[begin] = (~out).sum()
    rank = ranks(n)[1]
    columns = {
        "keys": pack_sorted(words),
        "last": last.tobytes(),
        "n": pack(n),
        "pw": pack(np.bincount(pairs // len(words), minlength=len(words))),
        "pv": pack(rank[by[pairs % len(words)]]),
        "pc": pack(np.bincount(of[learned], minlength=len(pairs))),
        "held": out.astype(np.uint8).tobytes(),
        "size": pack(size),
        "token": pack(rank[w]),
    }
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([len(w)], pa.int64()), *[pa.array([x], pa.binary()) for x in columns.values()]], names=["piece", "ids", "tokens", *columns])


def _cut(limit: int):
    """doc_id, text and held_out as pieces of about limit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, n = [], 0
        for b in batches:
            raw, offsets = bw.texts(b.column(1))
            out = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, r, o in bw.chunks(raw, offsets, min(TEXTS, 8 * limit)):
                k, u, first = tokens(r, o)
                held.append((b.column(0).slice(lo, hi - lo), out[lo:hi], k, u, first))
                n += len(k)
                if n >= limit:
                    yield _piece(number, held)
                    number, n = number + 1, 0
        if held:
            yield _piece(number, held)
        bw.forget()
        trim()

    return run


_PIECE = "keys binary, last binary, n binary, pw binary, pv binary, pc binary, held binary, size binary, token binary"


class Piece:
    """The words and pairs of a piece. Pairs lie by word, last byte of the context, then context, so that those of one
    dish above lie together."""

    def __init__(self, get):
        self.keys = unpack_sorted(get("keys"))
        of = unpack(get("pw"))
        self.n = unpack(get("n"))
        self.by = ranks(self.n)[0]
        self.w, self.v = np.repeat(np.arange(len(of)), of), self.by[unpack(get("pv"))]

    def pairs(self, which=slice(None)) -> np.ndarray:
        return pair_keys(self.keys[self.v[which]], self.keys[self.w[which]])

    def tokens(self, get) -> tuple[np.ndarray, np.ndarray]:
        """The pair of every token, and the first token of each text."""
        w, first = self.by[unpack(get("token"))], np.concatenate([[0], np.cumsum(unpack(get("size")))])
        place = by_last(np.frombuffer(get("last"), np.uint8))[1]
        x = np.empty_like(w)
        x[1:] = place[w[:-1]]
        x[first[:-1]] = place[np.searchsorted(self.keys, BEGIN.view(bw.U))]
        w *= len(self.keys)
        x += w
        del w
        return numbered(x)[1], first  # a piece has no pairs but those of its tokens

    def with_parents(self, get) -> Piece:
        """Also the restaurants above that the words are dishes of (word * 256 + last byte before), and that of each pair."""
        self.u = np.frombuffer(get("last"), np.uint8)[self.v]
        dishes = self.w * 256 + self.u
        new = np.ones(len(dishes), bool)
        new[1:] = dishes[1:] != dishes[:-1]
        self.dishes, self.dish = dishes[new], np.cumsum(new) - 1
        return self


def _getter(rows: pa.Table | pa.RecordBatch, i: int):
    return lambda name: rows.column(name)[i].as_py()


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["kind", "part", "piece", "block"])


def _unpacked(t: pa.Table) -> list[list[np.ndarray]]:
    """The arrays of all rows' blocks: the first of each row, the second and so on."""
    return [list(x) for x in zip(*(unpack_all(x) for x in t.column("block").to_pylist()))]


def _ask_counts(parts: int):
    """The keys of each piece's pairs and their counts, for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = _getter(b, i)
                keys = Piece(get).pairs()
                order = order_of(keys)
                keys, c = keys[order], unpack(get("pc"))[order]
                at = cuts_of(keys, parts)
                rows = [(REQUEST, r, get("piece"), pack(gaps(keys[x:y]), c[x:y])) for r, (x, y) in enumerate(zip(at[:-1], at[1:])) if x < y]
                del keys, order, c
                yield from _table(rows).to_batches()
        trim()

    return run


def _add_counts(t: pa.Table) -> pa.Table:
    """For each piece its pairs' counts over all pieces, twice, plus one where it is the piece that counts them; and
    a row of no piece with the numbers of pairs seen once and twice."""
    blocks, counts = _unpacked(t)
    sizes = [len(k) for k in blocks]
    piece = t.column("piece").to_numpy()
    c = np.concatenate(counts)
    keys, which = numbered(np.concatenate([ascending(k) for k in blocks]))
    total = sums(which, c, len(keys))
    # Of the pieces that learn a pair the one with the least hash counts it, so that all count about as many.
    there = np.flatnonzero(c > 0)
    of = which[there]
    hashed = bw.mix(keys[of] ^ np.repeat(bw.mix(piece.view(bw.U)), sizes)[there])
    least = np.full(len(keys), ~bw.U(0))
    np.minimum.at(least, of, hashed)
    out = 2 * total[which]
    out[there[hashed == least[of]]] += 1
    cuts = np.cumsum([0, *sizes])
    part = t.column("part")[0].as_py()
    rows = [(COUNTS, part, int(p), pack(out[x:y])) for p, x, y in zip(piece, cuts[:-1], cuts[1:])]
    rows.append((COUNTS, part, -1, pack(np.array([(total == 1).sum(), (total == 2).sum()]))))
    return _table(rows)


# --- Seating.


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def binomial(n: np.ndarray, p: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Binomial draws that depend on seeds alone; where the variance is above 25, rounded normal ones."""
    h = bw.mix(seeds)
    x = (h >> bw.U(11)).astype(np.float64) * 2.0**-53
    out = (x < p).astype(np.int64)  # that of one trial
    several = np.flatnonzero(n > 1)
    if not len(several):
        return out
    n, p, x, h = n[several], p[several], x[several], h[several]
    low = np.minimum(p, 1 - p)
    variance = n * low * (1 - low)
    got = np.zeros(len(n), np.int64)
    wide = np.flatnonzero(variance > 25)
    y = ((bw.mix(h[wide] ^ bw.BASE) >> bw.U(11)).astype(np.float64) + 1) * 2.0**-53
    got[wide] = np.clip(np.rint(n[wide] * low[wide] + np.sqrt(-2 * variance[wide] * np.log(y)) * np.cos(2 * np.pi * x[wide])), 0, n[wide])
    live = np.flatnonzero(variance <= 25)
    most, low_, x_ = n[live], low[live], x[live]
    odds = low_ / (1 - low_)
    mass = (1 - low_) ** most
    up, k = mass, 0
    while len(live):
        more = np.flatnonzero((x_ >= up) & (k < most))
        live, most, odds, x_ = live[more], most[more], odds[more], x_[more]
        got[live] += 1
        mass = mass[more] * ((most - k) / (k + 1)) * odds
        up, k = up[more] + mass, k + 1
    out[several] = np.where(p > 0.5, n - got, got)
    return out


def falling(c: np.ndarray) -> np.ndarray:
    """The order of falling counts."""
    most = np.iinfo(np.uint16).max
    order = np.argsort((most - np.minimum(c, most)).astype(np.uint16), kind="stable")
    top = int((c >= most).sum())
    order[:top] = order[:top][np.argsort(-c[order[:top]], kind="stable")]
    return order


def seat(c: np.ndarray, others: np.ndarray, open_: np.ndarray, d: float, d0: float, all_: float | np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """New numbers of tables of dishes with c customers each. others: the parent's customers of the same word from
    other contexts; open_: strength + discount * tables of the restaurant without this dish; all_: what
    divides the parent's counts."""
    # Dishes with most customers first, so that those who still wait for a seat are always the first few.
    order = falling(c)
    c, others, open_, seeds = c[order], others[order], open_[order], seeds[order]
    all_ = np.broadcast_to(all_, len(c))[order]
    t = np.minimum(c, 1).astype(np.int64)
    rising, k = -c, 1
    while m := int(np.searchsorted(rising, -k)):
        step = max(1, k // BLOCK)
        own = t[:m]
        n = np.minimum(step, c[:m] - k)
        fresh = (open_[:m] + d * own) * np.maximum(others[:m] + own - d0, 0) / all_[:m]
        seated = np.maximum(k + (n - 1) / 2 - d * own, 1e-9)
        own += binomial(n, fresh / (fresh + seated), seeds[:m] ^ bw.mix(np.array([k], bw.U)))
        k += step
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


class Totals:
    """What a draw and the scores need of all restaurants above: of each the customers and tables, and the numbers
    of words, tokens and discounts."""

    def __init__(self, rows: list):
        self.c, self.t = np.zeros(256), np.zeros(256)
        self.words = self.tokens = self.n1 = self.n2 = self.r1 = self.r2 = 0
        for r in rows:
            if r.u >= 0:
                self.c[r.u], self.t[r.u] = r.c, r.t
                self.n1, self.n2 = self.n1 + r.n1, self.n2 + r.n2
            else:
                self.words, self.tokens, self.r1, self.r2 = r.c, r.t, r.n1, r.n2
        self.d, self.d0 = discount(self.n1, self.n2), discount(self.r1, self.r2)
        #: What divides the root's counts, and the probability of an unknown word.
        self.all = STRENGTH + self.t.sum()
        self.unknown = (STRENGTH + self.d0 * self.words) / self.all

    def root(self, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities at the root of words with n training tokens and so many customers there."""
        return np.where(n > 0, np.maximum(tables - self.d0, 0) / self.all, self.unknown)

    def parent(self, u: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probabilities in the restaurants u, times what divides their counts, of dishes with c customers and t tables."""
        return c - self.d * t + (STRENGTH + self.d * self.t[u]) * root


class Words:
    """A range's words: tokens, tables of the restaurants after them; and their dishes above (place * 256 + last byte
    before) with customers and tables."""

    def __init__(self, get, history: list[Totals], salt: int):
        self.keys, self.n, self.after = unpack_sorted(get("keys")), unpack(get("n")), unpack(get("after"))
        self.dishes, self.c = unpack_sorted(get("dishes")).astype(np.int64), unpack(get("c"))
        self.of, self.u = self.dishes >> 8, self.dishes & 255
        self.t = np.minimum(self.c, 1)
        self.root = sums(self.of, self.t, len(self.keys))
        seeds = bw.mix(self.keys[self.of] * bw.BASE + self.u.astype(bw.U))
        for j, seen in enumerate(history):
            own = seeds ^ bw.mix(np.array([salt * 1009 + j], bw.U))
            self.t = seat(self.c, self.root[self.of] - self.t, STRENGTH + seen.d * (seen.t[self.u] - self.t), seen.d, seen.d0, seen.all, own)
            self.root = sums(self.of, self.t, len(self.keys))


    def seen(self) -> bytes:
        """What Totals adds up, of this range: customers, tables, dishes with one customer and with two, by last byte;
        and words, tokens, words with one customer at the root and with two."""
        out = np.zeros((257, 4), np.int64)
        for j, values in enumerate((self.c, self.t, self.c == 1, self.c == 2)):
            out[:256, j] = sums(self.u, values, 256)
        known = (self.n > 0) & (self.keys != BEGIN.view(bw.U))
        out[256] = [known.sum(), self.n[known].sum(), (self.root[known] == 1).sum(), (self.root[known] == 2).sum()]
        return pack(out.ravel())


def _add_words(t: pa.Table) -> pa.Table:
    """One row for a range: what its words' pieces hand on, added up, and what each of them asks for."""
    part, pieces = t.column("part")[0].as_py(), t.column("piece").to_pylist()
    blocks, n, after, per, u, c = _unpacked(t)
    keys, which = numbered(np.concatenate([ascending(x) for x in blocks]))
    n, after = (sums(which, np.concatenate(x), len(keys)) for x in (n, after))
    of = np.repeat(which, np.concatenate(per))
    dishes, dish = numbered(of * 256 + np.concatenate(u))
    c = sums(dish, np.concatenate(c), len(dishes))
    at, held = np.cumsum([0, *map(len, blocks)]), np.cumsum([0, *map(len, u)])
    asked = [pack(gaps(which[i:j]), gaps(dish[x:y])) for i, j, x, y in zip(at[:-1], at[1:], held[:-1], held[1:])]
    own = dict(zip(("keys", "n", "after", "dishes", "c"), (pack_sorted(keys), pack(n), pack(after), pack_sorted(dishes), pack(c))))
    seen = Words(own.get, [], 0).seen()
    return pa.table([pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in (*own.values(), seen)], pa.array([pieces], pa.list_(pa.int64())), pa.array([asked], pa.list_(pa.binary()))], names=["part", *own, "seen", "pieces", "asked"])


def _add_again(words: pa.Table, t: pa.Table) -> pa.Table:
    """The row of a range with the sums of another sweep, whose pieces hand them on in the order they first asked in."""
    get = _getter(words, 0)
    asked = dict(zip(get("pieces"), get("asked")))
    after, c = np.zeros(len(unpack(get("n"))), np.int64), np.zeros(len(unpack(get("dishes"))), np.int64)
    for piece, x, y in zip(t.column("piece").to_pylist(), *_unpacked(t)):
        w, d = (ascending(z).view(np.int64) for z in unpack_all(asked[piece]))
        after[w] += x
        c[d] += y
    own = {"keys": get("keys"), "n": get("n"), "after": pack(after), "dishes": get("dishes"), "c": pack(c)}
    for name, value in (("after", own["after"]), ("c", own["c"]), ("seen", Words(own.get, [], 0).seen())):
        words = words.set_column(words.schema.get_field_index(name), name, pa.array([value], pa.binary()))
    return words


_WORDS = "part int, keys binary, n binary, after binary, dishes binary, c binary, seen binary, pieces array<long>, asked array<binary>"


def totals(seen: DataFrame) -> Totals:
    """Totals of the restaurants above, from the one column of what ranges have seen."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((257, 4), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += unpack(x).reshape(257, 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([*range(256), -1], np.int32)), *[pa.array(out[:, j]) for j in range(4)]], names=["u", "c", "t", "n1", "n2"])

    parts = seen.mapInArrow(partial, "u int, c long, t long, n1 long, n2 long")
    return Totals(parts.groupBy("u").agg(*[F.sum(x).alias(x) for x in ("c", "t", "n1", "n2")]).collect())  # 257 rows


def _redrawn(history: list[Totals], salt: int):
    """What the ranges have seen after as many draws as there are totals before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([Words(_getter(b, i), history, salt).seen()], pa.binary())], names=["block"])

    return run


def _answer(history: list[Totals], salt: int, kind: int, first: bool):
    """For each piece tables after its words and customers of the root, customers and tables of its dishes, and the
    words' tokens if it is the first time; and a row of no piece with what the range has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = _getter(b, i)
                x, part = Words(get, history, salt), get("part")
                rows = [(kind, part, -1, x.seen())]
                for piece, asked in zip(get("pieces"), get("asked")):
                    w, d = (ascending(z).view(np.int64) for z in unpack_all(asked))
                    rows.append((kind, part, piece, pack(x.after[w], x.root[w], x.c[d], x.t[d], *[x.n[w]][:first])))
                del x
                yield from _table(rows).to_batches()
        trim()

    return run


class Answers:
    """What a piece got: by kind the blocks of all parts, in order."""

    def __init__(self, t: pa.Table):
        kind, part = (t.column(x).to_numpy() for x in ("kind", "part"))
        order = np.lexsort((part, kind))
        self.blocks, self.rows = t.column("block"), {int(k): order[kind[order] == k] for k in np.unique(kind)}

    def of(self, kind: int) -> list[np.ndarray]:
        return [joined(x) for x in zip(*(unpack_all(self.blocks[i].as_py()) for i in self.rows[kind].tolist()))]


def _sweep(number: int, d: float, seen: Totals | None, ranges: int):
    """A piece's rows of tables, drawn given those before (each pair one table in sweep 0), and what it hands on of each
    range of words. The first sweeps also hand back what the parts and ranges told the piece for good, as one block
    in the order of its pairs and words."""

    def run(pieces: pa.Table, answered: pa.Table) -> pa.Table:
        get = _getter(pieces, 0)
        p, got, piece = Piece(get).with_parents(get), Answers(answered), get("piece")
        rows = []
        if number:
            c, own = got.of(COUNTS)
            t = np.minimum(c, 1)
            old = got.of(TABLES + number - 1)[0] if number > 1 else t
            after, tables, above, above_t, *n = got.of(WORDS + number - 1)
            n = n[0] if n else got.of(KNOWN)[0]
            root, salt = seen.root(n, tables), bw.mix(np.array([number], bw.U))
            several = np.flatnonzero(c > 1)
            several = several[falling(c[several])]  # so that only the first of them wait for long
            for x in range(0, len(several), SEATED):
                live = several[x : x + SEATED]
                w, v, u, dish = p.w[live], p.v[live], p.u[live], p.dish[live]
                parent = seen.parent(u, above[dish], above_t[dish], root[w])
                t[live] = seat(c[live], parent - old[live], STRENGTH + d * (after[v] - old[live]), d, 0.0, STRENGTH + seen.c[u], p.pairs(live) ^ salt)
            del c, old, after, above, above_t, tables, root, several
            rows.append((TABLES + number, 0, piece, pack(t)))
            if number == 1:
                rows.append((KNOWN, 0, piece, pack(n)))
            del n
        else:
            counted = np.empty(len(p.w), np.int64)
            counted[order_of(p.pairs())] = got.of(COUNTS)[0]
            c, own = counted >> 1, counted & 1
            t = np.minimum(c, 1)
            rows.append((COUNTS, 0, piece, pack(c, own)))
            del counted, c
        t *= own
        after, customers = sums(p.v, t, len(p.keys)), sums(p.dish, t, len(p.dishes))
        word, u = p.dishes >> 8, p.dishes & 255
        at = cuts_of(p.keys, ranges)
        held = np.searchsorted(word, at)
        per = np.bincount(word, minlength=len(p.keys))
        for q, (x, y, i, j) in enumerate(zip(at[:-1], at[1:], held[:-1], held[1:])):
            if x < y:
                # What the words are is asked once; later on it is the order of sweep 0.
                asked = (after[x:y], customers[i:j]) if number else (gaps(p.keys[x:y]), p.n[x:y], after[x:y], per[x:y], u[i:j], customers[i:j])
                rows.append((REQUEST, q, piece, pack(*asked)))
        return _table(rows)

    return run


def _scored(samples: list[tuple[int, Totals]], d: float):
    """The rows of a piece's texts, with probabilities averaged over the sweeps in samples."""

    def run(pieces: pa.Table, answered: pa.Table) -> pa.Table:
        get = _getter(pieces, 0)
        p, got = Piece(get).with_parents(get), Answers(answered)
        c, mean = got.of(COUNTS)[0], np.zeros(len(p.w))
        n = got.of(KNOWN)[0]
        for k, seen in samples:
            after, tables, above, above_t = got.of(WORDS + k)
            t, parent = got.of(TABLES + k)[0], parents(p, n, tables, above, above_t, seen)
            for x in range(0, len(c), SEATED):
                at = slice(x, x + SEATED)
                mean[at] += refined(p, at, c, t, n, after, d, parent) / len(samples)
            del after, tables, above, above_t, t, parent
        seen = samples[-1][1]
        values = [(n > 0)[p.w].astype(np.int64), np.log10((n + 1) / (seen.tokens + seen.words + 1))[p.w], np.log10(mean)]
        del got, c, mean, n, p.w, p.v, p.u, p.dish, p.dishes
        token, first = p.tokens(get)
        added = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
        columns = [added(x[token]) for x in values]
        ids = pieces.column("ids").combine_chunks().flatten()
        held = pa.array(np.frombuffer(get("held"), np.uint8).astype(bool))
        return pa.table([ids, held, pa.array(np.diff(first)), *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def parents(p: Piece, n: np.ndarray, tables: np.ndarray, above: np.ndarray, above_t: np.ndarray, seen: Totals) -> np.ndarray:
    """The probability of each dish of p in its restaurant above."""
    u = p.dishes & 255
    root = seen.root(n, tables)[p.dishes >> 8]
    return np.where(seen.c[u] > 0, seen.parent(u, above, above_t, root) / (STRENGTH + seen.c[u]), root)


def refined(p: Piece, at: slice, c: np.ndarray, t: np.ndarray, n: np.ndarray, after: np.ndarray, d: float, parent: np.ndarray) -> np.ndarray:
    """The probability of some pairs of p in their words' restaurants, given those of its dishes above."""
    v = p.v[at]
    below = STRENGTH + n[v]  # a word has as many customers after it as it has tokens
    return (c[at] - d * t[at] + (STRENGTH + d * after[v]) * parent[p.dish[at]]) / below


# --- Learning and scoring.


def _cogrouped(pieces: DataFrame, answers: list[DataFrame], f, schema: str, scratch: Scratch, tag: str) -> DataFrame:
    """f of each piece and its answers, written wave by wave, so that only a share of the pieces is shuffled at a time."""
    given, out = reduce(DataFrame.unionByName, answers), []
    for k in range(WAVES):
        now = [x.where(F.pmod(F.xxhash64("piece"), F.lit(WAVES)) == k).groupBy("piece") for x in (pieces, given)]
        out.append(scratch.keep(now[0].cogroup(now[1]).applyInArrow(trimmed(f), schema), f"{tag}-{k}", BLOCKS))
    return reduce(DataFrame.unionByName, out)


class Learned:
    """Pieces, the answers that sweeps and scores read, the discount of the words' restaurants and the totals of
    every sweep."""

    def __init__(self, rows: DataFrame, scratch: Scratch, piece: int = PIECE, part: int = PART, range_: int = RANGE):
        """rows: doc_id, text (not null) and held_out."""
        self.id_type = dict(rows.dtypes)["doc_id"]
        self.pieces = scratch.keep(rows.select("doc_id", "text", "held_out").mapInArrow(_cut(piece), f"piece long, ids array<{self.id_type}>, tokens long, {_PIECE}"), "pieces", BLOCKS)
        n = self.pieces.agg(F.sum("tokens")).first()[0] or 0
        parts, ranges = (max(1, -(-n // x)) for x in (part, range_))
        asked = self.pieces.select("piece", "keys", "n", "pw", "pv", "pc").mapInArrow(_ask_counts(parts), _ROW)
        counts = scratch.keep(asked.groupBy("part").applyInArrow(trimmed(_add_counts), _ROW), "counts", BLOCKS)
        self.d = _discount(counts)
        #: What a piece is told for good: its pairs' counts, and from sweep 1 on its words' tokens.
        self.told = {COUNTS: counts.where("piece >= 0")}
        self.tables: dict[int, DataFrame] = {}
        self.words: dict[int, DataFrame] = {}
        self.totals: dict[int, Totals] = {}
        for k in range(SWEEPS + 1):
            self._sweep(k, ranges, scratch)

    def _sweep(self, k: int, ranges: int, scratch: Scratch) -> None:
        given = [*self.told.values(), *[x[k - 1] for x in (self.words, self.tables) if k - 1 in x]]
        pieces = self.pieces.select("piece", "keys", "last", "n", "pw", "pv")
        out = _cogrouped(pieces, given, _sweep(k, self.d, self.totals.get(k - 1), ranges), _ROW, scratch, f"sweep-{k}")
        if k:
            self.tables[k] = scratch.keep(out.where(F.col("kind") == TABLES + k), f"tables-{k}", BLOCKS)
        if k <= 1:
            kind = KNOWN if k else COUNTS
            self.told[kind] = scratch.keep(out.where(F.col("kind") == kind), f"told-{kind}", BLOCKS)
            scratch.drop("counts")
        asked = out.where(F.col("kind") == REQUEST).groupBy("part")
        added = self.held.groupBy("part").cogroup(asked).applyInArrow(trimmed(_add_again), _WORDS) if k else asked.applyInArrow(trimmed(_add_words), _WORDS)
        words = self.held = scratch.keep(added, f"words-{k}", BLOCKS)
        scratch.drop(*[f"sweep-{k}-{x}" for x in range(WAVES)], f"words-{k - 1}")
        history: list[Totals] = []
        for j in range(ABOVE):
            history.append(totals(words.drop("pieces", "asked").mapInArrow(_redrawn(history, k), "block binary") if j else words.select("seen")))
        answers = scratch.keep(words.mapInArrow(_answer(history, k, WORDS + k, not k), _ROW), f"answers-{k}", BLOCKS)
        self.totals[k] = totals(answers.where("piece < 0").select("block"))
        self.words[k] = answers.where("piece >= 0")
        if 0 <= k - 1 <= BURN:  # what was drawn before isn't averaged
            scratch.drop(f"answers-{k - 1}", f"tables-{k - 1}")
            self.words.pop(k - 1), self.tables.pop(k - 1, None)

    def scores(self, scratch: Scratch) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, base_score, score."""
        samples = [(k, self.totals[k]) for k in sorted(self.words)]
        given = [*self.told.values(), *self.words.values(), *self.tables.values()]
        schema = f"doc_id {self.id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        return _cogrouped(self.pieces.drop("tokens", "pc"), given, _scored(samples, self.d), schema, scratch, "scores")


def _discount(counts: DataFrame) -> float:
    """Of the words' restaurants, from what the parts of the pairs have counted."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += unpack(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[:1]), pa.array(out[1:])], names=["n1", "n2"])

    r = counts.where("piece < 0").select("block").mapInArrow(seen, "n1 long, n2 long").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    return discount(r.n1 or 0, r.n2 or 0)


def score(docs: DataFrame, held_out, **sizes: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; held_out is a boolean
    expression, and only rows where it is false are learned from. sizes: piece, part and range_, in tokens."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scratch = Scratch(docs.sparkSession, "lm")
    learned = Learned(rows, scratch, **sizes)
    total = F.lit(learned.totals[SWEEPS].tokens).cast("long").alias("train_tokens")
    out = learned.scores(scratch)
    scratch.drop("pieces", f"told-{COUNTS}", f"told-{KNOWN}", *[f"{x}-{k}" for k in range(SWEEPS + 1) for x in ("answers", "tables", "words")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", total, "base_score", "score")
