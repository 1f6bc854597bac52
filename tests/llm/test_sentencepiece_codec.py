import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from emberline.llm import sentencepiece_codec as s
from emberline.llm.queries import vocabulary_path
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def vocabulary():
    return s.Vocabulary(vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


ODD = ["", " ", "  ", "x ", "   x   y  ", "\n", "▁x", "<s>", "<0x0A>", "\x00a", "a" * 300, "ＡＢ", "😀 é", "no break", " \t "]


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(3)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "▁", "\n", "é", "中", "1", "!", "the", "ing", " the", "😀", "xx", "   "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + [prose(i, 200) for i in range(20)]
    codec = s.Codec(vocabulary)
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(t), t
        assert codec.decode(ids) == t.replace("▁", " ")


def test_columns(documents, vocabulary, library):
    texts = [*ODD, None, prose(1, 5000)]
    docs = documents(texts).withColumn("piece_ids", F.lit("clash"))
    rows = {r.doc_id: r for r in s.decode(s.encode(docs, vocabulary), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert rows[i].piece_ids == (None if t is None else library.encode(t)) and rows[i].decoded == (None if t is None else t.replace("▁", " "))
    for r in s.digests(docs, vocabulary).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert s.digests(documents([]), vocabulary).collect() == []


def test_suffixes_and_occurrences():
    text = np.frombuffer("banana bandana".encode("utf-32-le"), np.uint32)
    order = s.suffix_order(text, 4)
    assert ["banana bandana"[i : i + 4] for i in order] == sorted("banana bandana"[i : i + 4] for i in range(14))
    words = ["an", "ana", "ban", "x", "na", "dana"]
    chars = np.zeros((6, 4), np.uint32)
    for k, w in enumerate(words):
        chars[k, : len(w)] = [ord(c) for c in w]
    low, high = s.occurrences(text, order, chars, np.array([len(w) for w in words]))
    found = [sorted(order[a:b].tolist()) for a, b in zip(low, high)]
    assert found == [[i for i in range(14) if "banana bandana".startswith(w, i)] for w in words]


def test_long_runs_of_blanks(vocabulary, library):
    codec = s.Codec(vocabulary)
    texts = ["a" + " " * n + b for n in (*range(1, 90), 1000) for b in ("", "b", "\n")]
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(t), len(t)
    n = 1_000_000
    assert sum(len(vocabulary.pieces[i]) for i in codec.run(n)) == n
