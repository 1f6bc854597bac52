import itertools
import re

import pyarrow as pa
import pytest

from emberline.llm import bytewords as bw
from emberline.llm import near_dedup
from tests.llm.conftest import prose


def brute(rows, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, places):
    w = text.split(" ")
    for p in places:
        w[p % len(w)] = f"changed{p}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 200)
    texts = [base, base, edited(base, [50]), edited(base, [150]), base.upper(), prose(2, 200), None, "", " \n", "one two", "One  two", "one"]
    # A chain: each is near the next one only.
    chain = [prose(3, 150)]
    for k in range(6):
        chain.append(edited(chain[-1], [10 + 20 * k, 17 + 20 * k]))
    # Near copies of a text, many of them apart from each other.
    star = prose(4, 150)
    texts += chain + [edited(star, [7 * k, 7 * k + 80]) for k in range(12)] + [star] + [prose(50 + k, 30) + " " + prose(9, 60) for k in range(8)]
    return list(enumerate(texts, 100))


def test_components_equal_brute_force(documents, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(rows), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_blocks_join_all_that_is_linked(spark, rows, monkeypatch):
    """All documents in one band of which nothing is joined yet, in blocks of four."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    raw, offsets = bw.texts(pa.array([t for _, t in rows]))
    sets = {i: s for (i, _), s in zip(rows, near_dedup.shingle_sets(raw, offsets, 4)) if len(s)}
    members = spark.createDataFrame([(7, i, i, len(sets)) for i in sets], "key long, rep long, label long, size long")
    sigs = spark.createDataFrame([(i, bytearray(near_dedup.signature(s).astype("uint8").tobytes()), len(s)) for i, s in sets.items()], "rep long, sig binary, n long")
    held = spark.createDataFrame([(i, s.view("int64").tolist()) for i, s in sets.items()], "v long, shingles array<long>")
    links = near_dedup._blocks(members, sigs, held, 80).collect()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = find(r.a), find(r.b)
        parent[max(a, b)] = min(a, b)
    want = brute(rows, 4, 80)
    assert links and {i: find(i) for i in sets} == {i: want[i][1] for i in sets}


def test_deduplicated_keeps_one_of_each_group_and_columns(documents, rows, spark):
    docs = documents([*rows, (None, "no id"), (None, None)]).withColumn("label", near_dedup.F.lit(1)).withColumn("rep", near_dedup.F.lit("x"))
    out = near_dedup.deduplicated(docs, 5, 80)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    want = brute(rows, 5, 80)
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i][1] == i)
    assert ids.count(None) == 2


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([]), 4, 80).collect() == []


def test_signature_shares_match_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for overlap in (0.2, 0.5, 0.8):
        seen = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * overlap)
            half = (400 - n) // 2
            a, b = pool[: n + half], np.concatenate([pool[:n], pool[n + half :]])
            seen.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        assert abs(np.mean(seen) - overlap) < 0.04


def test_filters_keep_small_sets_at_the_threshold(documents):
    """Four shingles, and the same with one more: many lowest bits of these signatures differ."""
    rows = []
    for i, k in enumerate((689, 1173, 1682, 2240, 3096, 5149, 5758, 8176)):
        text = " ".join(f"w{k}x{j}" for j in range(7))
        rows += [(2 * i, text), (2 * i + 1, text + " more")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows), 4, 80).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
