"""Quality rules: simple counts, and divergence from what texts of a language look like.

Two histograms of a document are held against its language's reference with the Jensen-Shannon distance (the
root of the divergence to base 2, 0 to 1): that of its characters over seven classes, and that of its words
over the common words of the language and the rest. The references are those of all documents of a
language whose characters are prose by a plain measure, in scripts with and without case, so that junk
doesn't become the norm. Common are words that make up at least COMMON of a language's words, so there are
at most 1 / COMMON a language; a language has a reference from LEAST_REFERENCE words on. References are a
table with a row for each language, joined by it, however many there are. A document whose language has
none isn't judged by distance. A verdict on characters needs LEAST_CHARACTERS, one on words LEAST_WORDS, as
short texts differ by chance.

Everything is DataFrame expressions; a document is judged within its row.

Defined results: a null, empty or blank text has no words, fails the base rules and isn't kept. A null
lang is a language of its own. An empty table gives no rows, repeated rows equal rows. Columns that are
added replace those of the same name; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BLANKS, Scratch, bind, few, fresh, words

COMMON = 0.005
LEAST_REFERENCE = 1000
#: Documents count towards a reference with at least this share of lower-case letters, or of letters without case, and
#: at most that of symbols.
LEAST_LETTERS, MOST_SYMBOLS = 0.6, 0.005
LEAST_CHARACTERS = 200
LEAST_WORDS = 100
#: A histogram of n over k values is too far at more than this distance plus NOISE * sqrt(k / n), as few draws stray
#: by chance: by about 0.43 * sqrt(k / n) at its expectation.
MOST_CLASS_DISTANCE = 0.13
MOST_WORD_DISTANCE = 0.15
NOISE = 0.55
WINDOW = 8
#: A reference's words lie in so many buckets by their hash, as Spark looks a key up in a map by going through all.
BUCKETS = 64
CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "letter")


def _unlowered(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Ll}+", "")


def class_counts(text: Column, rest: Column | None = None) -> Column:
    """Array of the numbers of characters in CLASSES, then that of characters of `[#*$%&|<>]`; `letter` are letters
    without case and what combines with them. rest: text without lower-case letters."""

    def counts(rest: Column) -> Column:
        # What is left without lower-case letters is a fifth of a text, and without blanks a twentieth.
        def few(r: Column) -> Column:
            without = lambda p: F.length(r) - F.length(F.regexp_replace(r, p, ""))
            upper, digit, mark, letter = without(r"[\p{Lu}\p{Lt}]+"), without(r"[0-9]+"), without(r"[.,;:'\"!?()\-]+"), without(r"[\p{Lo}\p{Lm}\p{M}]+")
            return F.array(F.length(text) - F.length(rest), upper, digit, F.length(rest) - F.length(r), mark, F.length(r) - upper - digit - mark - letter, letter, without(r"[#*$%&|<>]+")).cast("array<double>")

        return bind(F.regexp_replace(rest, r"[\x20\x09-\x0D]+", ""), few)

    return bind(_unlowered(text), counts) if rest is None else counts(rest)


def _prose(size: Column, rest: Column) -> Column:
    """Whether a text of that size counts towards a reference; rest: it without lower-case letters."""

    def plain(r: Column) -> Column:
        return (F.length(r) <= (1 - LEAST_LETTERS) * size) & (F.length(F.regexp_replace(r, r"[^#*$%&|<>@~^=+\[\]{}\\/_`]+", "")) <= MOST_SYMBOLS * size)

    return bind(F.regexp_replace(rest, r"[\p{Lo}\p{M}]+", ""), plain)


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def references(docs: DataFrame) -> DataFrame:
    """lang and ref, a struct of classes (shares of CLASSES), words (shares of common words), sum (of those) and buckets
    (the common words by their hash), of the languages that have a reference."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = docs.select(_language().alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.length("text")
    counts = scratch.keep(rows.where(bind(_unlowered(F.col("text")), lambda x: _prose(size, x))).select("lang", F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").count(), "counts")
    totals = counts.groupBy("lang").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST_REFERENCE)
    totals = few(scratch.keep(totals, "totals"))
    share = F.struct("word", (F.col("count") / F.col("n")).alias("share"))
    common = counts.join(totals, "lang").where(F.col("count") >= COMMON * F.col("n")).groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(share))).alias("words"))  # at most 1 / COMMON a language
    # Not a filter, which would go through each text once more; sums pass over nulls.
    counted = bind(_unlowered(F.col("text")), lambda x: F.when(_prose(size, x), class_counts(F.col("text"), x)))
    sums = rows.select("lang", counted.alias("c")).groupBy("lang").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(len(CLASSES))]).alias("sums"))
    held = totals.select("lang").join(sums, "lang").join(common, "lang", "left")
    none = F.create_map().cast("map<string,double>")
    all_ = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
    classes = F.transform("sums", lambda x: x / F.greatest(all_, F.lit(1.0)))
    held = held.select("lang", classes.alias("classes"), F.coalesce("words", none).alias("words"))
    sum_ = F.aggregate(F.map_values("words"), F.lit(0.0), lambda a, x: a + x)
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.filter(F.map_keys("words"), lambda x: _bucket(x) == i))
    out = scratch.keep(held.select("lang", F.struct("classes", "words", sum_.alias("sum"), buckets.alias("buckets")).alias("ref")), "references")
    scratch.drop("counts", "totals")
    return out


def _half(p: Column, q: Column) -> Column:
    """What one value of shares p and q adds to the Jensen-Shannon divergence."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b)) / 2).otherwise(0.0)
    return part(p, q) + part(q, p)


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def n_repeat_words(all_words: Column) -> Column:
    """Words that lie in a window of WINDOW words which is found twice or more in the text."""

    def covered(keys: Column) -> Column:
        # (key, place) sorted, so that equal windows lie together; of those the places in order.
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["k"] == F.get(s, j)["k"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def total(at: Column) -> Column:
            reach = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(pairs, lambda s: bind(places(s), total))

    def paired(keys: Column, k: int) -> Column:
        """Keys of twice the words: each with the one k further on."""
        n = F.size(keys) - k
        return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(keys, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))

    def of(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        twice = lambda k, then: F.when(F.size(F.array_distinct(k)) < F.size(k), then(k)).otherwise(F.lit(0).cast("long"))
        # Where no half of a window is found twice, no window is.
        whole = lambda q: bind(paired(q, WINDOW // 2), lambda k: twice(k, covered))
        windows = bind(one, lambda h: bind(paired(h, 1), lambda p: bind(paired(p, 2), lambda q: twice(q, whole))))
        return F.when(F.size(w) > WINDOW, windows).otherwise(F.lit(0).cast("long"))

    return bind(all_words, of)


def _measures(ref: Column, text: Column):
    """(of_words, of_classes): from a text's words the struct of n_words, n_repeat_words, word_distance, base_failed and
    word_far, from its counts of classes that of word_chars, n_symbols, class_distance and class_far. ref: null without a reference."""

    def class_distance(c: Column) -> Column:
        n = F.greatest(sum((c[i] for i in range(len(CLASSES))), F.lit(0.0)), F.lit(1.0))
        return _root(sum((_half(c[i] / n, ref["classes"][i]) for i in range(len(CLASSES))), F.lit(0.0)))

    def word_distance(w: Column) -> Column:
        def found(cw: Column) -> Column:
            both = F.transform(F.array_distinct(cw), lambda x: F.struct(((F.size(cw) - F.size(F.array_remove(cw, x))) / F.size(w)).alias("p"), F.element_at(ref["words"], x).alias("q")))
            start = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
            add = lambda a, x: F.struct((a["js"] + _half(x["p"], x["q"])).alias("js"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q"))
            return F.aggregate(both, start, add, lambda a: _root(a["js"] + _half(F.greatest(1 - a["p"], F.lit(0.0)), F.greatest(1 - ref["sum"], F.lit(0.0))) + (ref["sum"] - a["q"]) / 2))

        return bind(F.filter(F.transform(w, F.lower), lambda x: F.array_contains(F.get(ref["buckets"], _bucket(x)), x)), found)

    def too_far(distance: Column, most: float, k, n: Column) -> Column:
        return F.coalesce(distance > most + NOISE * F.sqrt(k / n), F.lit(False))

    def of_words(w: Column) -> Column:
        far = F.when((F.size(w) >= LEAST_WORDS) & ref.isNotNull(), word_distance(w))
        held = F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"), far.alias("word_distance"))

        def judged(x: Column) -> Column:
            failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
            return F.struct(*[x[k].alias(k) for k in ("n_words", "n_repeat_words", "word_distance")], failed.alias("base_failed"), too_far(x["word_distance"], MOST_WORD_DISTANCE, 1 + F.size(F.map_keys(ref["words"])), x["n_words"]).alias("word_far"))

        return bind(held, judged)

    def of_classes(c: Column) -> Column:
        far = F.when((F.length(text) >= LEAST_CHARACTERS) & ref.isNotNull(), class_distance(c))
        n = (F.length(text) - F.element_at(c, 1 + CLASSES.index("blank"))).cast("long")
        return bind(far, lambda x: F.struct(n.alias("word_chars"), F.element_at(c, len(CLASSES) + 1).cast("long").alias("n_symbols"), x.alias("class_distance"), too_far(x, MOST_CLASS_DISTANCE, len(CLASSES), F.length(text)).alias("class_far")))

    return of_words, of_classes


def _referred(docs: DataFrame, against: DataFrame | None) -> tuple[DataFrame, str]:
    """docs with the reference of each one's language, and the name of its column."""
    against = references(docs) if against is None else against
    key, ref = fresh(docs, "of_language"), fresh(docs, "reference")
    named = against.select(F.col("lang").alias(key), F.col("ref").alias(ref))
    return docs.join(few(named), _language() == F.col(key), "left").drop(key), ref


def judge(docs: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, the distances
    class_distance and word_distance (null where the text is too short or has no reference), and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, ref = _referred(docs, against)
    of_words, of_classes = _measures(F.col(ref), text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    w, c, n = (fresh(rows, x) for x in ("of_words", "of_classes", "of_lines"))
    made = rows.withColumn(w, bind(words(text), of_words)).withColumn(c, bind(class_counts(text), of_classes)).withColumn(n, bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    values = {k: F.col(f"{w}.{k}") for k in ("n_words", "n_repeat_words", "word_distance", "base_failed")} | {k: F.col(f"{c}.{k}") for k in ("word_chars", "n_symbols", "class_distance")}
    values |= {"n_dup_lines": F.col(n), "kept": ~(F.col(f"{w}.base_failed") | F.col(f"{c}.class_far") | F.col(f"{w}.word_far"))}
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in values], *[v.alias(k) for k, v in values.items()])


def accepted(docs: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """The documents that are kept. The verdict is one expression, as a filter on judge's columns would measure a
    text once for each column that the verdict needs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, ref = _referred(docs, against)
    of_words, of_classes = _measures(F.col(ref), text)
    near = bind(class_counts(text), lambda c: bind(of_classes(c), lambda x: ~x["class_far"]))
    kept = rows.where(near & bind(words(text), lambda w: bind(of_words(w), lambda x: ~(x["base_failed"] | x["word_far"]))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
