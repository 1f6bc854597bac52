"""Token sequences packed by a grouping genetic algorithm.

Documents are tokenized and followed by an end id; longer ones than a sequence are cut into pieces. A
piece as long as a sequence fills one. The others are dealt by hash into demes of about DEME pieces, so
that a task's work and memory are bounded at any scale. Every deme evolves on ISLANDS islands. A solution
is a list of bins, and genes are whole bins: crossover injects well-filled bins of one parent into the
other, dissolves the bins that now hold a piece twice, and best-fits what that displaced; mutation
dissolves the worst bins. Best-fit-decreasing is one of an island's first people. Between epochs the elite of each
island migrates to the next. After FEWEST generations a deme stops as soon as it needs no more bins than its
tokens would, cut freely. What the best solution leaves in
poorly filled bins goes to fewer demes of a further level, until one deme is left or a level saves no more
than a hundredth of the bins.

Defined results: a null text is empty; an empty text is its end id alone. An empty table gives no rows;
repeated rows are packed each for itself; a null doc_id is carried along. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import Scratch, ship

LENGTH = 2048
END = 0
DEME = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
#: Generations of an island in an epoch, and those that pass at least.
GENERATIONS, FEWEST = 40, 3
#: Bins below this fill are packed anew at the next level.
WELL_FILLED = 0.99
#: Texts of only these characters are split alike by both libraries; all others go to `tokenizers`.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
# Fixed value: how the byte-level vocabulary splits a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, int]:
    """The vocabulary's character for every byte: printable ones stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of a byte-level BPE vocabulary in `tokenizers` JSON. Plain texts take the faster `tiktoken`, whose
    ids are the same as the vocabulary's ids are merge ranks; all others go through `tokenizers` itself."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(vocabulary)
        parsed = json.loads(vocabulary)
        names = _byte_names()
        added = {x["content"] for x in parsed.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        ranks = {bytes(names[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; the first may be shorter."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Tokens(held.value)
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                at, n = 0, len(ids) % length or length
                k = 0
                while at < len(ids):
                    rows.append((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, n, k = at + n, length, k + 1
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"}), preserve_index=False)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("piece", F.col("piece").cast("int"))


class Bins:
    """Bins of one capacity, with tightest fit by a bit set of the free capacities."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.free = capacity, [], []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        f = self.free[b]
        self.by_free.setdefault(f, []).append(b)
        self.mask |= 1 << f

    def add_bin(self, items: list[int], free: int) -> None:
        self.held.append(items)
        self.free.append(free)
        self._offer(len(self.held) - 1)

    def best_fit(self, item: int, size: int) -> None:
        over = self.mask >> size
        if not over:
            self.add_bin([item], self.capacity - size)
            return
        f = size + (over & -over).bit_length() - 1
        same = self.by_free[f]
        b = same.pop()
        if not same:
            self.mask &= ~(1 << f)
        self.held[b].append(item)
        self.free[b] = f - size
        self._offer(b)


def fill(bins: list[list[int]], sizes: list[int], items: list[int], capacity: int) -> list[list[int]]:
    """bins with items added, each to the tightest that has room, in the order given."""
    out = Bins(capacity)
    for b in bins:
        out.add_bin(b, capacity - sum(sizes[i] for i in b))
    for i in items:
        out.best_fit(i, sizes[i])
    return out.held


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then unevenly filled ones, which leave room that can be used."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def _crossed(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    good = [x for x in b if sum(sizes[i] for i in x) >= WELL_FILLED * capacity] or b
    given = [good[i] for i in rng.permutation(len(good))[: max(1, len(good) // 2)]]
    taken = {i for x in given for i in x}
    kept, loose = [list(x) for x in given], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    return fill(kept, sizes, sorted(loose, key=lambda i: -sizes[i]), capacity)


def _mutated(a: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    order = sorted(range(len(a)), key=lambda b: sum(sizes[i] for i in a[b]))
    out = set(order[: max(2, len(a) // 20)]) | set(rng.integers(0, len(a), max(2, len(a) // 10)).tolist())
    loose = [i for b in out for i in a[b]]
    return fill([list(x) for b, x in enumerate(a) if b not in out], sizes, sorted(loose, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1)), capacity)


def evolve(sizes: list[int], capacity: int, seed: int, settlers: list[list[list[int]]] = (), generations: int = GENERATIONS) -> tuple[list[list[int]], int]:
    """The best bins that an island finds and the generations it took. The first people are those it is given, or
    best-fit-decreasing and orders near it; FEWEST generations pass before it may stop at the least number of bins."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    n = range(len(sizes))
    people = [[list(b) for b in s] for s in settlers] or [fill([], sizes, sorted(n, key=lambda i: -sizes[i]), capacity)]
    score = lambda x: fitness(x, sizes, capacity)
    while len(people) < POPULATION:
        noise = rng.uniform(0.8, 1.2, len(sizes))
        people.append(fill([], sizes, sorted(n, key=lambda i: -sizes[i] * noise[i]), capacity))
    people = sorted(((score(x), x) for x in people), key=lambda x: x[0], reverse=True)
    for g in range(generations):
        if g >= FEWEST and len(people[0][1]) <= least:
            return people[0][1], g
        a, b = rng.choice(max(2, POPULATION // 2), 2, replace=False) if rng.random() < 0.5 else rng.choice(len(people), 2, replace=False)
        child = _crossed(people[a][1], people[b][1], sizes, capacity, rng)
        if rng.random() < 0.7:
            child = _mutated(child, sizes, capacity, rng)
        if (own := score(child)) > people[-1][0]:
            people[-1] = (own, child)
            people.sort(key=lambda x: x[0], reverse=True)
    return people[0][1], generations


_ITEM = ["doc_id", "piece", "start", "length", "ids_crc32", "copy"]
_ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


def _evolve_level(dealt: DataFrame, capacity: int, level: int, scratch: Scratch) -> DataFrame:
    """Items with deme, the bin of the deme's best solution, bin's fill, place in it; written."""

    def first(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(_ITEM, kind="stable", ignore_index=True)
        return _laid(g, *evolve(g["length"].tolist(), capacity, key[0] * 1009 + key[1]))

    def later(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        settlers, items = [], None
        for _, own in g.groupby("home"):
            items = own.sort_values(_ITEM, kind="stable", ignore_index=True)
            settlers.append([x.tolist() for x in items.groupby("bin").indices.values()])
        return _laid(items.drop(columns=["home"]), *evolve(items["length"].tolist(), capacity, key[0] * 1009 + key[1] + 7919, settlers))

    def _laid(g: pd.DataFrame, bins: list[list[int]], generations: int) -> pd.DataFrame:
        size = g["length"].to_numpy()
        bin_, at, full = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for k, b in enumerate(bins):
            bin_[b] = k
            at[b] = np.cumsum(size[b]) - size[b]
            full[b] = size[b].sum()
        spare = len(bins) - -(-int(size.sum()) // capacity)
        return g[["deme", "island", *_ITEM]].assign(bin=bin_, offset=at, fill=full, spare=spare, generations=generations)

    schema = f"deme long, island int, {_ITEMS}, bin long, offset long, fill long, spare long, generations long"
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = scratch.keep(islands.groupBy("deme", "island").applyInPandas(first, schema), f"level-{level}-0")
    for epoch in range(1, EPOCHS):
        open_ = state.groupBy("deme").agg(F.min("spare").alias("least")).where("least > 0").select("deme")
        if open_.isEmpty():
            break
        elite = state.drop("offset", "fill", "spare", "generations").withColumn("home", F.col("island"))
        moved = elite.withColumn("island", (F.col("island") + 1) % ISLANDS)
        state = scratch.keep(elite.union(moved).groupBy("deme", "island").applyInPandas(later, schema), f"level-{level}-{epoch}")
    best = state.groupBy("deme").agg(F.min(F.col("spare") * 64 + F.col("island")).alias("best")).select("deme", (F.col("best") % 64).cast("int").alias("island"))
    return state.join(best, ["deme", "island"])


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all pieces of docs in as few sequences of
    at most `length` ids as the islands find; vocabulary is the text of a `tokenizers` file."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack")
    cut = scratch.keep(pieces(docs, vocabulary, length, end), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.where(F.col("length") == length).select(*columns, (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [whole]
    rest = scratch.keep(cut.where(F.col("length") < length).withColumn("copy", F.monotonically_increasing_id()), "rest")
    level, n, before = 0, rest.count(), None
    while n:
        demes = -(-n // DEME)
        dealt = rest.withColumn("deme", F.pmod(F.xxhash64("copy", F.lit(level)), F.lit(demes)))
        done = scratch.keep(_evolve_level(dealt, length, level, scratch), f"level-{level}")
        poor = F.col("fill") < WELL_FILLED * length
        seen = done.groupBy("deme", "bin", "fill").agg(F.count("*").alias("n")).agg(F.count("*").alias("bins"), F.count_if(poor).alias("poor"), F.coalesce(F.sum(F.when(poor, F.col("n"))), F.lit(0)).alias("n")).first()
        # What is left goes on to fewer demes, unless it was so left before and now needs hardly fewer bins.
        final = demes == 1 or (before is not None and seen.bins > 0.99 * before)
        placed.append((done if final else done.where(~poor)).select(*columns, (F.lit(level << 52) + F.col("deme") * 8192 + F.col("bin")).alias("sequence_id"), "offset"))
        if final:
            break
        rest, level, n, before = done.where(poor).select(*columns, "copy"), level + 1, seen.n, seen.poor
    return reduce(DataFrame.unionAll, placed)
