"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line that holds a word, or a piece of one of more than SHORT units. Units are words, and the
characters of what has over LONGEST of them without a blank. Pieces end after units that their own hash
chooses, one in SHARE, and after MOST units at the latest, so that an edit moves only the pieces around it. A
paragraph's digest has 60 bits and tells its words, whatever blanks lie between them. A sketch has three tables of 2^b cells, where 2^b is at least SPACE times the number
of digests; a digest goes to one cell of each, chosen by b bits of its own for each table, which counts it and
adds it, and 32 bits that check it, by exclusive or. The sketches of two versions are subtracted cell by cell,
so that what both have cancels. Peeling then takes the cells of a table that are left with one digest, as
the check shows, takes these digests out of the other two tables, and so on, table by table. If cells are
left over, both versions are sketched again with four times the cells, up to RETRIES times. What is recovered
are the digests that only one version has; with the numbers of paragraphs that gives the likeness, the
share of paragraphs that both have among all that either has. The fingerprint returned is the sketch that is
subtracted and peeled: of a text and its edited text that of their own size, as half of their paragraphs are
expected to differ. A text and the next one are sketched for all paragraphs to differ.

Everything is DataFrame expressions. Texts and digests are shuffled once to bring neighbours together, and
digests once more to deal pairs to as many tasks as there are digests for; there a pair's cells are rows that
stay in one partition through all rounds, and a round is an aggregation.

Defined results: a null text is empty. A text without a line that holds a word has no paragraphs; two such
are alike by 1. Paragraphs that repeat within a text count once. Rows with a null doc_id come after all others
in descending order, rows of equal doc_id in the order of their texts' hashes. A single row is followed by
itself. An empty table gives no rows. Other columns are not read. Should a pair not be recovered by the largest
sketch (or have over some 2^22 paragraphs), its digests are compared directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import BLANKS, BROADCAST_ROWS, Scratch, bind, few

#: Lines of more units than SHORT are cut, after one unit in SHARE and after MOST of them.
SHORT, SHARE, MOST = 12, 12, 48
#: Code points of a word; what is longer is read by characters.
LONGEST = 40
TABLES = 3
#: Bits of a digest for each table, so at most 2^BITS cells.
BITS = 20
ALL = (1 << TABLES * BITS) - 1
LEAST_BITS = 3
#: Cells of a table for each digest, at least.
SPACE = 0.6
#: Rounds of peeling, each over one table, and of larger sketches.
ROUNDS, RETRIES = 9, 6
#: Digests for each task that peels.
DIGESTS = 200_000
#: The cell that counts what was recovered.
FOUND = -1
#: Rows whose neighbours are found in one task.
GROUP = 500
EDGES = 256
LOWEST = -(1 << 63)


def _pieces(line: Column) -> Column:
    """The digests of a line's pieces."""

    def units(words: Column) -> Column:
        # What is longer than a word can be is read by characters.
        letters = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONGEST, F.split(w, "")).otherwise(F.array(w))))
        return F.transform(F.when(F.exists(words, lambda w: F.length(w) > LONGEST), letters).otherwise(words), lambda u: F.xxhash64(u))

    def cut(keys: Column) -> Column:
        n = F.size(keys)

        def between(ends: Column) -> Column:
            # (end of the piece before, end), in numbers of units; long pieces are cut from their beginning on.
            spans = F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("from"), e.alias("to")))
            starts = F.flatten(F.transform(spans, lambda x: F.transform(F.sequence(x["from"], x["to"] - 1, F.lit(MOST)), lambda o: F.struct(o.alias("at"), F.least(F.lit(MOST), x["to"] - o).alias("n")))))
            return F.transform(starts, lambda x: F.xxhash64(F.slice(keys, x["at"] + 1, x["n"])))

        ends = F.filter(F.transform(keys, lambda k, i: F.when((i == n - 1) | (F.pmod(k, F.lit(SHARE)) == 0), i + 1)), lambda i: i.isNotNull())
        return F.when(n <= SHORT, F.array(F.xxhash64(keys))).otherwise(bind(ends, between))

    return bind(bind(F.split(line, r"[\x20\x09-\x0D]+"), units), cut)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return F.array_distinct(F.transform(F.flatten(F.transform(lines, _pieces)), lambda d: d.bitwiseAND(ALL)))


def _up(x: Column, by) -> Column:
    return F.call_function("shiftleft", x, by if isinstance(by, Column) else F.lit(by))


def _down(x: Column, by) -> Column:
    return F.call_function("shiftright", x, by if isinstance(by, Column) else F.lit(by))


def _turned(x: Column, by: Column) -> Column:
    """A digest with its bits turned left: by BITS * j, so that the bits of table j are the highest."""
    return _up(x, by).bitwiseOR(_down(x, TABLES * BITS - by)).bitwiseAND(ALL)


def _cell(digest: Column, table: int, bits: Column) -> Column:
    """The number of a digest's cell in a table: the highest of its bits, turned."""
    return _down(_turned(digest, F.lit(table * BITS)), (TABLES * BITS - bits).cast("int"))


def _check(digest: Column, table) -> Column:
    """What a cell of a table adds by exclusive or besides the digest itself."""
    table = table.cast("int") if isinstance(table, Column) else F.lit(table)
    return F.xxhash64(_turned(digest, table * BITS), table).bitwiseAND(0xFFFFFFFF)


def bits_for(differing: Column) -> Column:
    """Bits for so many digests, or differences, that all can be expected to be peeled."""
    return F.least(F.lit(BITS), F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.greatest(differing, F.lit(1)) * SPACE)))).cast("int")


def _table(held: Column, table: int, bits: Column) -> Column:
    """The 2^bits cells (n, d, c) of a table of a set of digests, by number.

    Digests are sorted by their bits for the table together with a mark where each cell begins."""
    zero = F.lit(0).cast("long")
    struct = lambda n, d, c: F.struct(n.alias("n"), d.alias("d"), c.alias("c"))
    keys = F.transform(held, lambda d: _up(_turned(d, F.lit(table * BITS)), 1) + 1)
    marks = F.transform(F.sequence(zero, _up(F.lit(1).cast("long"), bits) - 1), lambda i: _up(i, (TABLES * BITS + 1 - bits).cast("int")))

    def between(line: Column) -> Column:
        def cells(places: Column) -> Column:
            def cell(g: Column) -> Column:
                d = _turned(F.aggregate(g, zero, lambda a, e: a.bitwiseXOR(_down(e, 1))), F.lit((TABLES - table) * BITS if table else 0))
                c = F.aggregate(g, zero, lambda a, e: a.bitwiseXOR(F.xxhash64(_down(e, 1), F.lit(table))))
                return F.when(F.size(g) == 0, struct(F.lit(0), zero, zero)).otherwise(struct(F.size(g), d, c.bitwiseAND(0xFFFFFFFF)))

            return F.transform(places, lambda p, i: bind(F.slice(line, p + 2, F.coalesce(F.get(places, i + 1), F.size(line)) - p - 1), cell))

        return bind(F.filter(F.transform(line, lambda e, k: F.when(e.bitwiseAND(1) == 0, k)), lambda k: k.isNotNull()), cells)

    return bind(F.sort_array(F.concat(keys, marks)), between)


def sketch(held: Column, bits: Column) -> Column:
    """Three tables of 2^bits cells of a set of digests, one table after another."""
    return bind(F.struct(held.alias("x"), bits.alias("b")), lambda y: F.concat(*[_table(y["x"], j, y["b"]) for j in range(TABLES)]))


def sketch_text(cells: Column) -> Column:
    """A sketch as text: of each cell `count:digests:checks` in hexadecimal, or nothing if it is empty."""
    one = lambda x: F.when(x["n"] == 0, "").otherwise(F.concat_ws(":", F.hex(x["n"]), F.hex(x["d"]), F.hex(x["c"])))
    return F.lower(F.array_join(F.transform(cells, one), "."))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, and next_text and next_digests, those of the row which follows by descending doc_id;
    the first follows the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("key", [i / EDGES for i in range(EDGES + 1)], 10_000).alias("edges"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    groups = max(1, seen.n // GROUP)
    edges = sorted({seen.low, *(seen.edges or []), seen.high} - {None}) or [0]
    fine = max(1, groups // max(1, len(edges) - 1))
    # Between two edges the ids are dealt evenly, in order; any edges give right results.
    table = F.array(*[F.lit(x).cast("long") for x in edges])
    k = F.size(F.filter(table, lambda x: x <= F.col("key")))
    low, high = F.element_at(table, k).cast("double"), F.coalesce(F.get(table, k).cast("double"), F.element_at(table, k).cast("double") + 1)
    part = F.least(F.floor((F.col("key").cast("double") - low) / (high - low) * fine), F.lit(fine - 1))
    rows = rows.withColumn("group", (k * F.lit(fine) + part).cast("long"))
    # The first row of a group follows the last of the group above it; one row for each group.
    tops = rows.groupBy("group").agg(F.max("key").alias("key"))
    order = Window.orderBy(F.desc("group"))
    tops = tops.select("key", F.lag("group").over(order).alias("above"), F.lit(1).alias("one"), "group")
    last = tops.agg(F.min("group").alias("group")).first()
    tops = tops.select("key", F.coalesce("above", F.lit(last.group if last else None).cast("long")).alias("group"))
    guests = rows.drop("group").join(few(tops, groups + EDGES), "key").select("doc_id", "text", "key", "group", F.lit(True).alias("guest"))
    both = rows.select("doc_id", "text", "key", "group", F.lit(False).alias("guest")).unionByName(guests)
    both = both.repartition("group").withColumn("digests", digests(F.col("text")))  # after the shuffle, which needn't carry them
    after = Window.partitionBy("group").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    return both.withColumn("next", F.lead(F.struct("text", "digests")).over(after)).where("not guest").select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def _peeled(pairs: DataFrame) -> DataFrame:
    """(uid, side, differ, left_over) of pairs (uid, side, bits, left, right): arrays of digests, and the bits of their sketches.

    pairs must be partitioned by uid; then nothing is shuffled, as all keys begin with it."""
    keys = ["uid", "side", "bits"]
    both = F.concat(F.transform("left", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), F.transform("right", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))
    one = pairs.select(*keys, F.explode(both).alias("e")).select(*keys, "e.d", "e.n")
    m = _up(F.lit(1), F.col("bits")).cast("int")
    cell = lambda table, n, d, c: F.struct((F.lit(table) * m + _cell(F.col("d"), table, F.col("bits"))).cast("int").alias("cell"), n.cast("int").alias("n"), d.alias("d"), c.alias("c"))
    added = lambda x: [F.sum(f"{x}n").cast("int").alias("n"), F.bit_xor(f"{x}d").alias("d"), F.bit_xor(f"{x}c").alias("c")]
    some = "n <> 0 or d <> 0 or c <> 0"
    sketched = one.select(*keys, F.explode(F.array(*[cell(j, F.col("n"), F.col("d"), _check(F.col("d"), j)) for j in range(TABLES)])).alias("x"))
    state = sketched.groupBy(*keys, F.col("x.cell").alias("cell")).agg(*added("x.")).where(some)
    zero = F.lit(0).cast("long")
    for r in range(ROUNDS):
        j = r % TABLES
        pure = (F.col("cell") >= j * m) & (F.col("cell") < (j + 1) * m) & (F.abs("n") == 1) & (F.col("c") == _check(F.col("d"), j))
        found = F.struct(F.lit(FOUND).alias("cell"), F.lit(1).alias("n"), zero.alias("d"), zero.alias("c"))
        taken = F.array(found, *[cell(x, -F.col("n"), F.col("d"), _check(F.col("d"), x)) for x in range(TABLES) if x != j])
        same = F.array(F.struct("cell", "n", "d", "c"))
        state = state.select(*keys, F.explode(F.when(pure, taken).otherwise(same)).alias("x")).groupBy(*keys, F.col("x.cell").alias("cell")).agg(*added("x.")).where(some)
    return state.groupBy("uid", "side").agg(F.coalesce(F.sum(F.when(F.col("cell") == FOUND, F.col("n"))), F.lit(0)).alias("differ"), F.max(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left_over"))


def likenesses(rows: DataFrame, versions: dict[str, tuple[str, str, Column]], scratch: Scratch) -> DataFrame:
    """uid and, for every name of versions, how many digests only one has of the two arrays of digests that it names,
    sketched with the bits given; rows must have a unique uid and be read from a table."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), bits.alias("bits"), F.col(a).alias("left"), F.col(b).alias("right")) for k, (a, b, bits) in enumerate(versions.values())])
    n = rows.agg(F.sum(sum(F.size(a) + F.size(b) for a, b, _ in versions.values()))).first()[0] or 0
    found, open_ = None, None
    for level in range(1 + RETRIES):
        wanted = rows if open_ is None else rows.join(few(open_.select("uid").distinct()), "uid", "left_semi")
        pairs = wanted.repartition(max(1, -(-n // DIGESTS)), "uid").select("uid", F.explode(sides).alias("s")).select("uid", "s.*")
        pairs = pairs.withColumn("bits", F.least(F.lit(BITS), F.col("bits") + 2 * level))
        if open_ is not None:
            pairs = pairs.join(F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_, ["uid", "side"], "left_semi").repartition(max(1, -(-n // DIGESTS)), "uid")
        done = scratch.keep(_peeled(pairs), f"peeled-{level}")
        good = done.where("left_over = 0").select("uid", "side", "differ")
        found = good if found is None else found.unionByName(good)
        open_ = done.where("left_over = 1").select("uid", "side")
        n = n // 4
        if open_.isEmpty():
            break
    else:
        # Beyond the largest sketch: compared directly.
        pairs = rows.select("uid", F.explode(sides).alias("s")).select("uid", "s.*").join(few(open_), ["uid", "side"], "left_semi")
        found = found.unionByName(pairs.select("uid", "side", (F.size("left") + F.size("right") - 2 * F.size(F.array_intersect("left", "right"))).alias("differ")))
    return found.groupBy("uid").agg(*[F.sum(F.when(F.col("side") == k, F.col("differ"))).alias(name) for k, name in enumerate(versions)])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For every row the fingerprints of its text and of its edited text, whose second half is the beginning of
    the next text, and the likeness of its own to the edited and to the next one's."""
    scratch = Scratch(docs.sparkSession, "prints")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", F.col("digests").alias("own"), F.col("next_digests").alias("other"), edited.alias("edited"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), "other")
    rows = scratch.keep(rows, "rows")
    size = {x: F.size(x) for x in ("own", "changed", "other")}
    versions = {"near_edited": ("own", "changed", bits_for(F.greatest(size["own"], size["changed"]))), "near_next": ("own", "other", bits_for(size["own"] + size["other"]))}
    differ = likenesses(rows, versions, scratch)
    out = rows.select("uid", "doc_id", "n_chars", "edited_sha256", "own", "changed", size["other"].alias("n_other")).join(few(scratch.keep(differ, "differ")), "uid", "left")

    def near(name: str, left: Column, right: Column) -> Column:
        """The share of digests that both have among all that either has."""
        d, both = F.coalesce(F.col(name), F.lit(0)), left + right
        return F.when(both > 0, (both - d) / (both + d)).otherwise(F.lit(1.0)).alias(name)

    text = lambda x: bind(F.col(x), lambda held: sketch_text(sketch(held, bits_for(F.size(held)))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("changed").alias("edited_fingerprint"),
        near("near_edited", size["own"], size["changed"]), near("near_next", size["own"], F.col("n_other")),
    )
