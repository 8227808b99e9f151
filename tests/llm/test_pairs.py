"""Near copies, embeddings and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from furlong.llm import ann, hnsw
from furlong.llm.near_copies import one_of_each_class
from furlong.llm.ngram_join import SetTrie, near_duplicate_classes, needed


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return out


def key(rows):
    return sorted(rows, key=str)


def corpus(rnd):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 30, 80, 150]))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                copy = copy + passage
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, "two one"), (None, "one two"), (n + 5, "w1 " * 3000)]


def test_classes_equal_brute_force(docs_of):
    for seed in (3, 4):
        rows = corpus(random.Random(seed))
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_classes(docs_of(rows).repartition(3)).collect()]
        assert key(got) == key(classes(rows))


def test_equality_counts_as_a_link(docs_of):
    a = " ".join(f"a{i}" for i in range(13))  # nine shingles, eight of them shared with b, and of the ten in all
    b = " ".join([f"a{i}" for i in range(12)] + ["z"])
    sets = shingles(a), shingles(b)
    assert 10 * len(sets[0] & sets[1]) == 8 * len(sets[0] | sets[1])
    assert [r.component_id for r in near_duplicate_classes(docs_of([(8, a), (5, b)])).collect()] == [5, 5]


def test_empty_table_and_repeated_rows(docs_of):
    assert near_duplicate_classes(docs_of([])).count() == 0
    got = near_duplicate_classes(docs_of([(1, "a b c"), (1, "a b c"), (2, "a b c")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_trie_equals_brute_force():
    rnd = random.Random(7)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(5, 30))), np.uint64) for _ in range(120)]
    trie = SetTrie()
    for i, s in enumerate(sets):
        trie.add(i, s)
    for p in sets:
        want = [i for i, s in enumerate(sets) if len(set(p.tolist()) & set(s.tolist())) >= needed(len(p), len(s))]
        assert sorted(trie.within(p)) == want


def test_one_of_each_class(docs_of):
    rows = [(4, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "other words"), (7, None), (None, "a b c d e f g h")]
    got = one_of_each_class(docs_of(rows))
    assert {r.doc_id for r in got.collect()} == {2, 9, 7, None}
    assert got.columns == docs_of(rows).columns


def vectors(rnd, n=400, d=16):
    x = rnd.standard_normal((n, d))
    for i in range(120):  # a tight group, and chains
        x[i] = x[0] + 0.05 * rnd.standard_normal(d)
    for i in range(150, 170):
        x[i] = x[i - 1] + 0.25 * rnd.standard_normal(d)
    return x


BAD = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15]


def test_embedding_classes_equal_brute_force(spark):
    x = vectors(np.random.default_rng(1))
    rows = [(i, v.tolist(), "label") for i, v in enumerate(x)] + [(1000 + i, v, "label") for i, v in enumerate(BAD)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: (int(link[i].sum()) - 1, find(i), find(i) == i) for i in range(len(x))} | {1000 + i: (0, 1000 + i, True) for i in range(len(BAD))}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicate_vectors(df).collect()}
    assert got == want
    assert hnsw.near_duplicate_vectors(df.filter("false")).count() == 0


def sparse_links(rnd, n, asked, d=64):
    """Isotropic vectors and queries of which the last twentieth have a link each, and the true pairs."""
    x, q = rnd.standard_normal((n, d)), rnd.standard_normal((asked, d))
    for i in range(asked - asked // 20, asked):
        v = x[rnd.integers(n)]
        q[i] = v / np.linalg.norm(v) + 0.46 * q[i] / np.linalg.norm(q[i])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return x, q, set(zip(*map(np.ndarray.tolist, np.nonzero(unit(q) @ unit(x).T >= 0.9)), strict=True))


def recall(shard, q, true):
    links = set(zip(*map(np.ndarray.tolist, shard.links(np.arange(len(q)) + 10**6, q)), strict=True))
    assert links <= true
    return len(links) / len(true)


def test_sparse_links_are_audited(monkeypatch):
    """A beam that is too narrow is widened though the first rows of a block have no link."""
    monkeypatch.setattr(hnsw, "BEAM", 1)
    x, q, true = sparse_links(np.random.default_rng(5), 4000, 1024)
    shard = hnsw._Shard(np.arange(len(x)), x, 0.9)
    assert recall(shard, q, true) >= 0.97 and shard.beam > 1


def test_later_blocks_are_audited_and_earlier_ones_searched_again(spark, monkeypatch):
    """With no planted audit, what later blocks show widens the beam; the whole table then comes out as by brute force."""
    monkeypatch.setattr(hnsw._Shard, "_planted", lambda self: self.unit[:0])
    monkeypatch.setattr(hnsw, "BEAM", 1)
    x, q, true = sparse_links(np.random.default_rng(6), 4000, 1024)
    shard = hnsw._Shard(np.arange(len(x)), x, 0.9)
    shard.links(np.arange(900) + 10**6, q[:900])
    assert shard.beam == 1 and not shard.widened
    for _ in range(3):
        shard.links(np.arange(50) + 10**6, q[-50:])
    assert shard.beam > 1 and shard.widened
    batch = lambda kind, ids, v: pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([kind], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([v.tobytes()])], names=["shard", "part", "kind", "ids", "vectors"])
    blocks = [batch(0, np.arange(len(x)), x), batch(1, np.arange(900) + 10**6, q[:900]), batch(1, np.arange(900, 1024) + 10**6, q[900:])]
    search = lambda beams: [r for out in hnsw._searcher(64, 0.9, beams)(iter(blocks)) for r in out.to_pylist()]
    wider = [r["beam"] for r in search({}) if r["beam"]]
    assert wider and wider[0] > 1
    assert not [r for r in search({0: 4000}) if r["beam"]]
    assert sum(r["n"] or 0 for r in search({0: 4000})) == len(true)


def test_graph_recall():
    x = np.random.default_rng(2).standard_normal((6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw.Hnsw(x).search(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a[:64]) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.9


def test_nearest_equal_brute_force(spark):
    x = vectors(np.random.default_rng(3))
    x[7] = x[300]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(BAD)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), k=10, search=ann.TREES).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 400, 50):
        d = np.sqrt(((x[q] - x) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)).tolist() if i != q][:10]
        assert [i for i, _ in got[q]] == want
        assert np.allclose([s for _, s in got[q]], d[want], rtol=0, atol=1e-12)
    assert 1000 not in got
    assert ann.nearest(df.filter("false"), df.filter("false")).count() == 0
    few = df.filter("vec_id < 4")
    assert ann.nearest(few, few, k=10).count() == 12


def test_forest_recall():
    x = np.random.default_rng(4).standard_normal((5000, 16))
    forest = ann.Forest(x)
    leaves = forest.file(x)
    hit = 0
    for q in range(60):
        found = np.isin(leaves, forest.search(x[q], ann.SEARCH * len(x))).any(1)
        true = np.argsort(((x[q] - x) ** 2).sum(1))[1:11]
        hit += found[true].sum()
    assert hit / 600 >= 0.9


def clusters(rng, n, d):
    """A third of the vectors in one tight cluster, the others in forty."""
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 41, n))
    return rng.standard_normal((41, d))[at] * 3 + rng.standard_normal((n, d)) * np.where(at == 0, 0.05, 1.0)[:, None]


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_of_the_whole_search(spark, kind, monkeypatch):
    """By the search's own share, with leaves that are split over several tasks."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64)) if kind == "even" else clusters(rng, 6000, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x[q] - x) ** 2).sum(1)
        d[q] = np.inf
        assert sorted(got[q]) == list(range(1, 11))
        hit += len(set(got[q].values()) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 600
