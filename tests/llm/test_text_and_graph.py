import random
import re

import pyarrow as pa

from furlong.llm import _text
from furlong.llm._graph import components
from furlong.llm._text import shingle_sets, text_buffers, word_hashes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_word_hashes_equal_words(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB \n\t\x0bé#x") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "   ", "a" * 3000]
    known = {}
    for segment in (1 << 20, 16):
        monkeypatch.setattr(_text, "SEGMENT", segment)
        hashes, first = word_hashes(*text_buffers(pa.array(texts)))
        at = 0
        for k, t in enumerate(texts):
            assert first[k + 1] - first[k] == len(words(t))
            for w in words(t):
                assert known.setdefault(w, hashes[at]) == hashes[at]
                at += 1
    assert len(set(known.values())) == len(known)


def test_shingle_sets():
    texts = ["a b c d e f", "A  B\nC d e f", "a b", "b a", "", None, "x " * 40]
    sets = [s.tolist() for s in shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1]
    assert sets[0] == sets[1] and sets[2] != sets[3]


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (None, 7)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {a: find(a) for a in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
