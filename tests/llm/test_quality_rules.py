import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from emberline.llm import quality_rules
from tests.llm.conftest import prose


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


TEXTS = [prose(i, 150) for i in range(40)] + [
    None, "", "  \n\x0b\f", "one", "a b c d e f g h " * 3, "x " * 7, "x " * 8, "x " * 9, "same line here\nother\nsame line here\n \n\n",
    prose(1, 30) + " " + prose(1, 30), "é ü 漢字 #*$%&|<> 12\t34\r\n" * 4, prose(3, 3000), "w" * 5000,
    prose(7, 40) + " z " + prose(8, 40) + " y " + prose(7, 40), prose(5, 60).upper().replace(" ", "!! "),
]


def test_counts_equal_brute_force_and_junk_goes(documents):
    docs = documents(TEXTS).withColumn("kept", F.lit("clash")).withColumn("w", F.lit(1))
    out = quality_rules.judge(docs)
    assert len(out.columns) == len(set(out.columns)) and "w" in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
    assert all(rows[i].kept for i in range(40))
    assert not rows[len(TEXTS) - 1].kept  # all in capitals


def test_symbols_and_tables_are_far_from_prose(documents):
    good = [prose(i, 200) for i in range(30)]
    bad = [" ".join(f"{w}{'#$%'[k % 3] * 3}" for k, w in enumerate(prose(99, 200).split())), " | ".join(prose(98, 200).split())]
    rows = {r.doc_id: r for r in quality_rules.judge(documents(good + bad)).collect()}
    assert all(rows[i].kept for i in range(30)) and not rows[30].kept and not rows[31].kept


def test_nulls_and_empty(documents, spark):
    docs = documents([(None, prose(1, 300)), (1, None)]).withColumn("lang", F.lit(None).cast("string"))
    rows = quality_rules.accepted(docs).collect()
    mixed = documents(TEXTS)
    assert {r.doc_id for r in quality_rules.accepted(mixed).collect()} == {r.doc_id for r in quality_rules.judge(mixed).where("kept").collect()}
    assert quality_rules.accepted(mixed).columns == mixed.columns
    assert [r.doc_id for r in rows] == [None]
    assert quality_rules.judge(documents([])).collect() == []


def test_divergence_is_symmetric_and_bounded(spark):
    rows = spark.createDataFrame([((0.0, 1.0),), ((1.0, 0.0),), ((0.5, 0.5),), ((0.2, 0.7),)], "x struct<p:double,q:double>")
    got = [tuple(r) for r in rows.select(quality_rules._half(F.col("x.p"), F.col("x.q")), quality_rules._half(F.col("x.q"), F.col("x.p"))).collect()]
    assert got[0][0] == 0.5 and got[2][0] == 0 and all(abs(a - b) < 1e-12 for a, b in got)


def distance(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) / 2 if a else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q))))


def test_distances_equal_brute_force(documents):
    texts = [prose(i, 160) for i in range(25)] + [prose(50, 120).upper(), "漢字 " * 150]
    docs = documents(texts)
    ref = quality_rules.references(docs).first().ref
    words_ = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts[:25]]
    n = sum(map(len, words_))
    count = collections.Counter(w for x in words_ for w in x)
    # The text without case counts for the reference, too; it is 150 words of one kind.
    count["漢字"], n = 150, n + 150
    assert dict(ref.words) == pytest.approx({w: c / n for w, c in count.items() if c >= quality_rules.COMMON * n})
    for r, t in zip(sorted(quality_rules.judge(docs).collect(), key=lambda r: r.doc_id), texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        common = sorted(ref.words)
        p = [own.count(w) / len(own) for w in common]
        q = [ref.words[w] for w in common]
        assert r.word_distance == pytest.approx(distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]), abs=1e-6)
        kinds = collections.Counter("lower" if c.islower() else "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c in " \n" else "mark" if c in ".,;:'\"!?()-" else "symbol" for c in t)
        assert r.class_distance == pytest.approx(distance([kinds[k] / len(t) for k in quality_rules.CLASSES], ref.classes), abs=1e-6)
    assert not r.word_distance < 0.2


def test_many_languages_and_scripts_without_case(spark):
    """Each language has a reference of its own, also the 70th, and one whose letters have no case."""
    rows = [(k * 100 + i, " ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for w in prose(i, 250).split()), f"l{k:02d}") for k in range(70) for i in range(5)]
    arabic = "".join(chr(0x627 + k) for k in range(20))
    rows += [(9000 + i, " ".join(arabic[(i * j) % 17 : (i * j) % 17 + 1 + j % 4] for j in range(1, 300)), "ar") for i in range(1, 8)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality_rules.references(docs).count() == 71
    out = quality_rules.judge(docs).collect()
    assert all(r.class_distance is not None and r.class_distance < 0.1 for r in out)
    other = docs.where("lang = 'ar'").withColumn("lang", F.lit("l69")).limit(1)
    r = quality_rules.judge(docs.unionByName(other)).where("lang = 'l69' and doc_id >= 9000").first()
    assert r.class_distance > 0.5 and not r.kept


def test_columns_of_helpers_names_pass_through(documents):
    docs = documents([prose(1, 300)])
    for c in ("of_words", "of_classes", "of_lines", "of_language", "reference", "__w"):
        docs = docs.withColumn(c, F.lit("clash"))
    r = quality_rules.judge(docs).first()
    assert all(r[c] == "clash" for c in ("of_words", "of_classes", "of_lines", "of_language", "reference", "__w")) and r.kept


def test_common_words_lie_in_buckets_and_half_windows_repeat(documents):
    """A word is looked up in its bucket alone; halves of a window that are found twice don't make a window of it."""
    halves = "a b c d e f g h i a b c d j k l m n e f g h o p"
    docs = documents([prose(i, 160) for i in range(25)] + [halves, halves + " " + halves])
    ref = quality_rules.references(docs).first().ref
    assert len(ref.buckets) == quality_rules.BUCKETS and sorted(w for b in ref.buckets for w in b) == sorted(ref.words)
    rows = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()}
    assert rows[25] == 0 and rows[26] == 48
