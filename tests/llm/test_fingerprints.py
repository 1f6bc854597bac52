import hashlib
import re

import pytest
from pyspark.sql import functions as F

from emberline.llm import fingerprints
from tests.llm.conftest import prose

PARAGRAPHS = lambda t: {x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), likeness(PARAGRAPHS(t), PARAGRAPHS(e)), likeness(PARAGRAPHS(t), PARAGRAPHS(n)))
    return out


def test_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP", 4)
    texts = ["\n".join(prose(i * 100 + k, 5) for k in range(i % 9)) for i in range(60)]
    texts += [None, "", " \n\t", "é漢😀\nb", "one", texts[20], texts[20] + "\nmore", "\n".join(prose(9000 + k, 4) for k in range(3000)), "\n".join(prose(9000 + k, 4) for k in range(0, 3000, 2))]
    rows = [(i * i - 50, t) for i, t in enumerate(texts)]
    want = brute(rows)
    prints = {}
    got = fingerprints.fingerprint_edits(documents(rows).withColumn("fingerprint", F.lit(1))).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(after)
        assert prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_small_sketches_are_tried_again(documents, spark, monkeypatch):
    """With no round of peeling but one, nothing is recovered from any sketch, and digests are compared directly."""
    rows = [(i, "\n".join(prose(i * 100 + k, 5) for k in range(8))) for i in range(6)]
    want = {i: round(x[2], 9) for i, x in brute(rows).items()}
    for rounds, retries in ((1, 1), (9, 0), (3, 2)):
        monkeypatch.setattr(fingerprints, "ROUNDS", rounds)
        monkeypatch.setattr(fingerprints, "RETRIES", retries)
        assert {r.doc_id: round(r.near_edited, 9) for r in fingerprints.fingerprint_edits(documents(rows)).collect()} == want


def read(print_):
    """The cells of a fingerprint's tables."""
    cells = [tuple(int(y, 16) for y in x.split(":")) if x else (0, 0, 0) for x in print_.split(".")]
    m = len(cells) // fingerprints.TABLES
    return [cells[j * m : (j + 1) * m] for j in range(fingerprints.TABLES)]


def check_and_cells(spark, digest, m):
    """Of a digest its check and cell in each table."""
    d, bits = F.lit(digest).cast("long"), F.lit(m.bit_length() - 1)
    row = spark.range(1).select(*[x for j in range(fingerprints.TABLES) for x in (fingerprints._check(d, j).alias(f"c{j}"), fingerprints._cell(d, j, bits).alias(f"i{j}"))]).first()
    return [(row[f"c{j}"], int(row[f"i{j}"])) for j in range(fingerprints.TABLES)]


def test_returned_fingerprints_subtract_and_peel(documents, spark):
    """What peeling the difference of two returned fingerprints recovers gives the likeness that is returned."""
    texts = ["\n".join(prose(i * 100 + k, 5) for k in range(12)) for i in range(3)]
    peeled = 0
    for r in fingerprints.fingerprint_edits(documents(texts)).collect():
        a, b = read(r.fingerprint), read(r.edited_fingerprint)
        if len(a[0]) != len(b[0]):
            continue
        m = len(a[0])
        state = [[(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]) for x, y in zip(s, t)] for s, t in zip(a, b)]
        found = 0
        for _ in range(6):
            for j in range(fingerprints.TABLES):
                for n, d, c in [x for x in state[j] if abs(x[0]) == 1]:
                    of = check_and_cells(spark, d, m)
                    if of[j][0] == c:
                        found += 1
                        for k, (check, i) in enumerate(of):
                            state[k][i] = (state[k][i][0] - n, state[k][i][1] ^ d, state[k][i][2] ^ check)
        if not any(any(x) for t in state for x in t):
            own, changed = sum(x[0] for x in a[0]), sum(x[0] for x in b[0])
            assert r.near_edited == pytest.approx((own + changed - found) / (own + changed + found))
            peeled += 1
    assert peeled


def test_few_rows(documents):
    assert fingerprints.fingerprint_edits(documents([])).collect() == []
    r = fingerprints.fingerprint_edits(documents(["a\nb"])).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a\na").hexdigest()
    rows = fingerprints.fingerprint_edits(documents([(None, "x y\nz"), (1, "p"), (1, "p"), (None, None)])).collect()
    assert len(rows) == 4


def test_texts_of_one_line_keep_likeness(documents):
    """Half of each text is edited; words, and characters of a script without blanks, in one line."""
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(3)] + ["".join(chr(0x4E00 + (i * 977 + k * 31) % 5000) for k in range(600)) for i in range(3)]
    for r in fingerprints.fingerprint_edits(documents(texts)).collect():
        assert 0.15 < r.near_edited < 0.6 and r.near_next < r.near_edited
