import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import packing
from emberline.llm.queries import vocabulary_text
from tests.llm.conftest import prose

TEXTS = [prose(i, 10 + 40 * i) for i in range(30)] + [None, "", "don't <|endoftext|> it's\n\n 漢字  x", "​…", "a" * 9000, prose(77, 6000), "x", "x"]


@pytest.fixture(scope="module")
def vocabulary():
    return vocabulary_text("byte_bpe_50k.json")


def test_pieces_and_sequences(documents, vocabulary):
    docs = documents([*enumerate(TEXTS), (None, "no id")]).withColumn("length", F.lit("clash"))
    rows = packing.pack(docs, vocabulary, 512).collect()
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = np.array([*real.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, k = 0, 0
        while at < len(ids):
            size = (len(ids) % 512 or 512) if k == 0 else 512
            r = got[(i, k)]
            assert (r.start, r.length, r.ids_crc32) == (at, size, zlib.crc32(ids[at : at + size].tobytes()))
            at, k, n = at + size, k + 1, n + 1
    assert n == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, size in sorted(x):
            assert o == at
            at += size
        assert at <= 512
    assert len(by) <= -(-sum(r.length for r in rows) // 512) + 1


def test_levels_lose_nothing(documents, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "DEME", 20)
    docs = documents([prose(i, 1 + (i * 37) % 90) for i in range(150)])
    rows = packing.pack(docs, vocabulary, 256).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == list(range(150))
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 256 and len(total) <= 1.03 * sum(total.values()) / 256 + 2


def test_empty(documents, vocabulary):
    assert packing.pack(documents([]), vocabulary).collect() == []


def test_evolution_keeps_every_item_and_improves():
    rng = np.random.default_rng(5)
    # Pairs that fill a bin exactly, which best fit in falling order doesn't find.
    sizes = [int(x) for a in rng.integers(30, 70, 60) for x in (a, 100 - a)] + [34, 33, 33] * 10
    start = packing.fill([], sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 100)
    best, generations = packing.evolve(sizes, 100, 1, generations=200)
    assert generations >= packing.FEWEST
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in best) and len(best) <= len(start)
    child = packing._crossed(start, best, sizes, 100, rng)
    assert sorted(i for b in packing._mutated(child, sizes, 100, rng) for i in b) == list(range(len(sizes)))


def test_bins_offer_the_tightest():
    rng = np.random.default_rng(2)
    bins, free = packing.Bins(50), []
    for i, s in enumerate(rng.integers(1, 40, 300).tolist()):
        fits = [f for f in free if f >= s]
        bins.best_fit(i, s)
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            free.append(50 - s)
        assert sorted(bins.free) == sorted(free)


def test_evolution_beats_its_seed_on_a_hard_mix():
    """Sizes of a quarter to a half of a sequence, of which best fit in falling order wastes much."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(500, 1100, 1200).tolist()
    seed = packing.fill([], sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 2048)
    best, generations = packing.evolve(sizes, 2048, 3)
    assert len(best) < len(seed) and generations == packing.GENERATIONS
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in best)


def test_every_deme_evolves(spark, documents, tmp_path):
    """Also where best-fit-decreasing already needs the fewest sequences."""
    from emberline.llm.common import Scratch, ship

    ship(spark)
    items = [(i, 0, 0, 100 + i % 37, i, i, i % 2) for i in range(300)]
    dealt = spark.createDataFrame(items, packing._ITEMS + ", deme long")
    out = packing._evolve_level(dealt, 2048, 0, Scratch(spark, "t")).select("deme", "generations").distinct().collect()
    assert {r.deme for r in out} == {0, 1} and all(r.generations >= packing.FEWEST for r in out)
