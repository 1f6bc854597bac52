"""Near-duplicate components by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the keys of its distinct word shingles. A first permutation sigma maps the keys
into [0, 2^32); a second permutation pi, circularly shifted by k, gives coordinate k of the signature:
the minimum of pi((sigma(x) - k) mod 2^32) over the set. Five coordinates make a band. Documents whose
sets are equal are one node. Nodes that share a band are compared, first by their whole signatures and
then exactly on their full sets; only exact comparisons make links.

Big bands do not give all their pairs. Each round compares a band's members with one pivot, the member
that shares the most bands with others, and joins what is linked into components. Members that are still
in different components of a band after PIVOT_ROUNDS are compared in blocks of bounded size, on full sets where
they lie and until they are joined, so that no link that matters depends on the choice of pivots. What is left to chance is banding alone: a
pair at similarity 0.8 shares no band with a probability of (1 - 0.8^5)^30 < 1e-5, less if more similar.

Defined results: null, empty and blank texts have no shingles and are linked with nothing. A row whose
doc_id is null is linked with nothing, has a null component and is kept. Rows that share a doc_id count
as one document. An empty table gives no rows. Columns other than doc_id and text are not read, and
`deduplicated` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import bytewords as bw
from emberline.llm.common import Scratch, few, ship

ROWS, BANDS = 5, 30
K = ROWS * BANDS
#: Share of equal (8-bit) coordinates below which a pair isn't compared exactly; at similarity 0.8 a
#: signature falls below it with a probability of about 1e-7.
LEAST_AGREEMENT = 0.62
#: Before that, of a bit of each of 128 coordinates so many may differ: 12.8 are expected to at similarity 0.8,
#: over 38 with a probability of about 1e-10. A coordinate is mixed before its bit is taken, as the lowest bits of
#: neighbouring coordinates depend on each other where a set is small.
MOST_BITS = 38
PIVOT_ROUNDS = 2
#: Members of a band that one task compares with as many others.
BLOCK = 512
U32 = np.uint32
SHIFTS = np.arange(K, dtype=U32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct keys of its shingles of `width` words; a shorter text is one shingle."""
    keys, first, _, _ = bw.word_keys(raw, offsets)
    a, salt = bw.U(0x9FB21C651E98DF25), bw.U(0xA0761D6478BD642F)

    def joined(parts):
        h = np.zeros(len(parts[0]), bw.U)
        for p in parts:
            h = h * a + p
        return bw.mix(h + bw.U(len(parts) * int(salt) % (1 << 64)))

    n = len(keys) - width + 1
    whole = joined([keys[j : j + n] for j in range(width)]) if n > 0 else np.zeros(0, bw.U)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(whole[lo : hi - width + 1])
        elif hi > lo:
            yield joined([keys[j : j + 1] for j in range(lo, hi)])
        else:
            yield np.zeros(0, bw.U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K circulant MinHash coordinates of a set that isn't empty."""
    out = np.full(K, 0xFFFFFFFF, U32)
    sigma = (bw.mix(shingles ^ bw.U(0xE7037ED1A0B428DB)) >> bw.U(32)).astype(U32)
    for i in range(0, len(sigma), 512):
        x = sigma[i : i + 512, None] - SHIFTS
        x *= U32(0x7FEB352D)
        x ^= x >> U32(15)
        x *= U32(0x846CA68B)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def few_bits(m: np.ndarray) -> np.ndarray:
    """A bit of each of the first 128 coordinates of signatures (a row each), as two integers."""
    return np.packbits((bw.mix(m[:, :128].astype(bw.U)) & bw.U(1)).astype(np.uint8), axis=1).view(np.int64)


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("x1", pa.int64()), ("x2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=bw.U) * bw.U(0x9E3779B97F4A7C15)
        for b in batches:
            raw, offsets = bw.texts(b.column(1))
            sizes, ids, sigs = [], [], []
            for _, _, r, o in bw.chunks(raw, offsets):
                for s in shingle_sets(r, o, width):
                    sizes.append(len(s))
                    if len(s):
                        ids.append((bw.mix(s ^ bw.U(0x8EBC6AF09C88C6E3)).sum(dtype=bw.U), np.bitwise_xor.reduce(bw.mix(s + bw.U(0x589965CC75374CC3)))))
                        sigs.append(signature(s))
                    else:
                        ids.append((0, 0))
                        sigs.append(np.zeros(K, U32))
            m = np.array(sigs, U32).reshape(-1, K)
            h = np.zeros((len(m), BANDS), bw.U) + band
            for j in range(ROWS):
                h = bw.mix(h * bw.U(0xD6E8FEB86659FD93) + m[:, j::ROWS].astype(bw.U))
            two = np.array(ids, dtype=bw.U).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS, dtype=np.int32)), pa.array(h.view(np.int64).ravel()))
            bits = few_bits(m)
            sig8 = pa.FixedSizeBinaryArray.from_buffers(pa.binary(K), len(m), [None, pa.py_buffer(np.ascontiguousarray(m.astype(np.uint8)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists, sig8, pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1]))], schema=schema)

    return run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, x1 long, x2 long"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = bw.texts(b.column(1))
            for lo, hi, r, o in bw.chunks(raw, offsets):
                sets = [s.view(np.int64) for s in shingle_sets(r, o, width)]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], names=["v", "shingles"])

    return run, "v long, shingles array<long>"


def _agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, K) for s in (a, b))
    return (x == y).mean(axis=1)


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""

    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_agreement(a, b) >= LEAST_AGREEMENT)

    a, b = (sigs.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(enough("sig_a", "sig_b")).select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose full sets are similar enough, written."""
    wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{tag}-ids")
    # Grouped first, as repeated rows of a document would multiply its pairs.
    run, schema = _sets(width)
    sets = docs.join(few(wanted), "doc_id").select("doc_id", "text").mapInArrow(run, schema)
    sets = scratch.keep(sets, f"{tag}-sets")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    a, b = (sets.select(F.col("v").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    sized = 100 * F.least(F.size("set_a"), F.size("set_b")) >= percent * F.greatest(F.size("set_a"), F.size("set_b"))
    out = scratch.keep(both.where(sized).where(similar("set_a", "set_b")).select("a", "b").distinct(), f"{tag}-links")
    scratch.drop(f"{tag}-sets", f"{tag}-ids")
    return out


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(v, label) for every vertex of links (a, b) but the components' least; label is that least vertex.

    Alternates large-star and small-star steps; the logarithm of the largest component bounds their number."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    step = 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, f"{tag}-{step}")
        if step:
            scratch.drop(f"{tag}-{step - 1}")
        step += 1
        if edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            # No least vertex lies above another; a vertex with two would have made them meet.
            return edges.select(F.col("u").alias("v"), F.col("v").alias("label"))


def _blocks(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among members (key, rep, label, size) of a key that join different labels, compared block by block on
    full sets. A block gives no more links than it has members: a pair that its links join already isn't compared."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label")
        .join(sigs, "rep")
        .join(sets.withColumnRenamed("v", "rep"), "rep")
    )

    def links(g: pd.DataFrame) -> pd.DataFrame | None:
        label, rep, own, n, sets = (g[c].to_numpy() for c in ("label", "rep", "own", "n", "shingles"))
        if (label == label[0]).all():
            return None
        s = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(-1, K)
        cross = g["i"].iloc[0] != g["j"].iloc[0]
        group = np.unique(label, return_inverse=True)[1]  # what is joined so far
        found = []
        for x in range(len(g) - 1):
            sized = 100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x])
            rest = np.flatnonzero(sized & (group[x + 1 :] != group[x]) & ((own[x + 1 :] != own[x]) | (not cross))) + x + 1
            for y in rest[(s[rest] == s[x]).mean(axis=1) >= LEAST_AGREEMENT] if len(rest) else ():
                if group[x] != group[y]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        found.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                        group[group == group[y]] = group[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at = None
        for batch in batches:
            for key, g in batch.groupby(["key", "i", "j"], sort=False):
                if key != at and held:
                    if (out := links(pd.concat(held))) is not None:
                        yield out
                    held = []
                at = key
                held.append(g)
        if held and (out := links(pd.concat(held))) is not None:
            yield out

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document: those linked, directly or by others, with
    a Jaccard similarity of at least percent / 100 of their sets of `width`-word shingles share a component,
    which bears the least doc_id."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _signatures(width)
    sigs = scratch.keep(docs.mapInArrow(run, schema), "sigs")
    nodes = scratch.keep(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sig", "x1", "x2", "n_shingles")]), "nodes"
    )
    own = ["rep", F.col("n_shingles").alias("n"), "x1", "x2"]
    keyed = nodes.select(*own, F.explode("bands").alias("key")).distinct()
    shared = scratch.keep(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = scratch.keep(keyed.join(few(shared), "key"), "members")
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    open_ = scratch.keep(members.join(popular, "rep"), "open-0")
    used = scratch.keep(nodes.join(few(members.select("rep").distinct()), "rep", "left_semi").select("rep", "sig", F.col("n_shingles").alias("n")), "used")
    links, labels = None, None
    for step in range(PIVOT_ROUNDS):
        best = open_.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("minus"), "n", "x1", "x2")).alias("best")).select("key", (-F.col("best.minus")).alias("pivot"), *[F.col(f"best.{c}").alias(f"pivot_{c}") for c in ("n", "x1", "x2")])
        against = members if labels is None else _labelled(members, labels)
        # Sizes and a few bits rule out most pairs where they arise.
        sized = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
        bits = sum(F.bit_count(F.col(x).bitwiseXOR(F.col(f"pivot_{x}"))) for x in ("x1", "x2"))
        pairs = against.join(best, "key").where((F.col("rep") != F.col("pivot")) & sized & (bits <= MOST_BITS))
        if labels is not None:
            pairs = pairs.join(labels.select(F.col("v").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left").where("label <> coalesce(pivot_label, pivot)")
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = scratch.keep(_alike(pairs, used), f"pairs-{step}")
        if pairs.isEmpty() and links is not None:
            break
        found = _linked(pairs, docs, width, percent, scratch, f"round-{step}")
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"labels-{step}")
        rest = _labelled(open_, labels).join(best, "key")
        rest = rest.join(labels.select(F.col("v").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left").where("label <> coalesce(pivot_label, pivot)")
        open_ = scratch.keep(rest.select(*open_.columns), f"open-{step + 1}")
        if open_.isEmpty():
            break
    # What lay open after the first round was compared with all of its band if it is one member only.
    first = spark.read.schema(open_.schema).parquet(f"{scratch.root}/open-1")
    several = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    divided = scratch.keep(_labelled(members.join(several, "key", "left_semi"), labels), "divided")
    split = divided.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    divided = divided.join(split, "key", "left_semi")
    run, schema = _sets(width)
    sets = scratch.keep(docs.join(few(divided.select(F.col("rep").alias("doc_id")).distinct()), "doc_id").select("doc_id", "text").mapInArrow(run, schema), "divided-sets")
    last = scratch.keep(_blocks(divided, used, sets, percent), "links-last")
    scratch.drop("divided-sets")
    if not last.isEmpty():
        labels = components(links.union(last), scratch, "labels-last")
    named = nodes.select("s1", "s2", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("label"))
    return (
        sigs.select("doc_id", "n_shingles", "s1", "s2")
        .join(named.withColumn("n", F.lit(True)), ["s1", "s2"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that aren't the first of their component."""
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession, "gone").keep(gone, "ids")
    return docs.join(few(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
