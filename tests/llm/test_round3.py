"""Conversation repair, spelling variants, quality: against brute force and held-out labels."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from furlong.llm import conversation, quality, queries, spelling
from furlong.llm.conversation import ACCEPTED, _NEW, _NEXT

SF = "/root/testdata/sf0.001"


def dijkstra(turns):
    """The cheapest edits by Dijkstra over (turn, state), ties by the edits' initials."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, edits, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(turns) and q in ACCEPTED:
            return cost, edits
        heapq.heappush(heap, (cost + 5, edits + "I", i, _NEW[q][1]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, q))
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if (q, initial) in _NEXT:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, _NEXT[q, initial]))
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, _NEW[q][1]))


def odd_turns(rnd, n):
    return [(rnd.choice(["s", "u", "a", "u", "a", "x", "", " "]), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_edits_equal_dijkstra_whole_and_in_blocks():
    rnd = random.Random(2)
    for _ in range(400):
        turns = odd_turns(rnd, rnd.randint(0, 13))
        want = dijkstra(turns)
        assert [conversation.cheapest(turns, b) for b in (64, 1, 2, 5)] == [want] * 4
    long = odd_turns(rnd, 300)
    assert conversation.cheapest(long) == dijkstra(long)


def test_small_conversations_by_all_paths():
    """Every string of up to six edits, cheapest and then ASCII-least."""
    rnd = random.Random(3)

    def play(turns, edits):
        i, q, cost = 0, 0, 0
        for e in edits:
            if e == "I":
                cost, q = cost + 5, _NEW[q][1]
                continue
            if i == len(turns):
                return None
            initial, fault = turns[i]
            i += 1
            if e == "D":
                cost += 2
            elif fault in (1, 2) or (e == "K" and (q, initial) not in _NEXT):
                return None
            else:
                cost += (5 if fault == 3 else 0) + (e == "R")
                q = _NEXT[q, initial] if e == "K" else _NEW[q][1]
        return (cost, "".join(edits)) if i == len(turns) and q in ACCEPTED else None

    for _ in range(12):
        turns = odd_turns(rnd, rnd.randint(0, 4))
        found = [p for n in range(7) for edits in itertools.product("DIKR", repeat=n) if (p := play(turns, edits))]
        assert min(found) == conversation.cheapest(turns)


def plain_repair(rows):
    """The contract on rows of one conversation, in plain Python."""
    key = lambda v: " " if v is None else str(v)
    turns = []
    for c, t, role, text in rows:
        kind, role, text = zlib.crc32(f"{key(c)}:{key(t)}".encode()) % 20, key(role), key(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    seen, codes = set(), []
    for _, role, text in turns:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not ends else 2 if (role, text) in seen else 3 if ends[-1] not in ".!?" else 0
        seen.add((role, text))
        codes.append((role[:1], fault))
    cost, audit = dijkstra(codes)
    out, i, q = [], 0, 0
    for e in audit:
        if e == "I":
            out.append(f"{_NEW[q][0]}:")
            q = _NEW[q][1]
            continue
        _, role, text = turns[i]
        i += 1
        if e == "K":
            out.append(f"{role}:{text}")
            q = _NEXT[q, role[:1]]
        elif e == "R":
            out.append(f"{_NEW[q][0]}:{text}")
            q = _NEW[q][1]
    ts = [t for t, _, _ in turns if t is not None]
    faulty = [f for _, f in codes]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
    gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
    return gaps, faulty.count(1), faulty.count(2), faulty.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def digests(df):
    return {r.conv_id: tuple(r[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_repair_query_equals_brute_force(spark, tmp_path):
    """The registered query on the given table and on odd rows: nulls everywhere, ties, repeats, other roles, blanks of all kinds, a long conversation."""
    rnd = random.Random(4)
    texts = ["Yes.", "No!", "  \t\x0b ", "", None, "Why?\r\n ", "it ends\x85", "half a", "x" * 5000 + ".", "Ü.\xa0", "Yes."]
    odd = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, 0, 1, 2, 2, 3, 9]), rnd.choice(["user", "assistant", "system", "tool", "User", "", None]), rnd.choice(texts)) for _ in range(150)]
    odd += [(7, i, "user" if i % 2 else "assistant", rnd.choice(texts)) for i in range(200)] + [(100 + i, i, "user", "Yes.") for i in range(60)]
    spark.createDataFrame([(*r, "x", 1, 2.0) for r in odd], "conv_id long, turn long, role string, text string, c string, t int, fault double").write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (str(tmp_path), SF):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        groups = collections.defaultdict(list)
        for r in rows:
            groups[r[0]].append(r)
        assert digests(queries.op11_conversation_repair(spark, sf)) == {c: plain_repair(g) for c, g in groups.items()}


def test_repaired_turns_read_as_they_should(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "All well."), (2, 0, "user", "Hm."), (3, 0, "tool", "")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = collections.defaultdict(list)
    for r in sorted(conversation.repaired(turns).collect(), key=lambda r: (r.conv_id, r.place)):
        got[r.conv_id].append((r.place, r.edit, r.turn, r.role, r.text))
    assert got[1] == [(0, "K", 0, "system", "Be kind."), (1, "R", 1, "user", "Hello."), (2, "K", 3, "assistant", "All well.")]
    assert 2 not in got and 3 not in got  # one turn is cheaper to delete than to answer
    assert {r.conv_id: r.audit for r in conversation.audits(turns).collect()} == {1: "KRDK", 2: "D", 3: "D"}
    empty = turns.filter("false")
    assert conversation.audits(empty).count() == conversation.repaired(empty).count() == 0


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        beside = [x for x in counts if near(w, x)]
        best = min(beside, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= 5 * n else None, None, n, len(beside)]
    for w in counts:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: (f, r, n, m, counts[f] if f else None) for w, (f, r, n, m) in out.items()}


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("slice_words", [1 << 24, 40])
def test_variants_equal_brute_force(spark, slice_words):
    """Random words of few letters, so that many are near; in one slice and in several."""
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 7))): int(5 * 6 ** rnd.uniform(0, 5)) for _ in range(250)}
    chain = {"aaaaaaz": 5, "aaaaazz": 30, "aaaazzz": 200, "aaazzzz": 2000, "aazzzzz": 20_000, "𝔘ber": 7, "𝔘bera": 50}
    counts |= chain
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants(spelling.spelling_variants(words, slice_words=slice_words))
    assert got == plain_variants(counts)
    assert got["aaaaaaz"][1] == "aazzzzz" and got["𝔘ber"][0] == "𝔘bera"
    assert spelling.spelling_variants(words.filter("false")).count() == 0


def plain_vocabulary(docs):
    found = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_spelling_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = plain_vocabulary(rows)
    got = variants(queries.op12_spelling_variants(spark, SF))
    assert {w: x[2] for w, x in got.items()} == counts
    by_key = collections.defaultdict(set)  # words that share a deletion, checked exactly
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_key[key].add(w)
    for w in counts:
        beside = {x for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by_key[key] if near(w, x)}
        assert got[w][3] == len(beside)
        best = min(beside, key=lambda x: (-counts[x], x), default=None)
        assert got[w][0] == (best if best and counts[best] >= 5 * counts[w] else None)
        assert got[w][1] == (got[got[w][0]][1] if got[w][0] else w)


def test_vocabulary_of_odd_texts(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 50)
    monkeypatch.setattr(spelling, "_HELD_WORDS", 3)
    rows = [(1, "Straße straße ÄPFEL äpfel İstanbul ſtraße " * 20), (None, "straße, straße; x" * 9), (3, None), (4, ""), (5, "a" * 300 + "É" * 7), (5, "naïveté " * 6), (5, "naïveté " * 6)]
    got = {r.word: r.n for r in spelling.vocabulary(docs_of(rows), spelling.misspelt()).collect()}
    assert got == plain_vocabulary([("" if i is None else i, t) for i, t in rows])


def test_quality_tells_held_out_labels(spark):
    """Learned outside the fold, measured inside it."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_quality_classifier(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.select("doc_id").distinct().count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and r.quality is not None]
    held = [(y, r.score, r.predicted) for y, r in labels if r.held_out]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([p == y for y, _, p in held]) > 0.95


def test_bad_lines_are_found_and_lines_are_scored_apart(docs_of):
    rnd = random.Random(6)
    line = lambda: " ".join(rnd.choice(["river", "stone", "cloud", "meadow"]) for _ in range(8)) + "."
    junk = lambda: " ".join(rnd.choice(["RIVER!!", "STONE!!", "x***"]) for _ in range(8))
    texts = ["\n".join(line() for _ in range(4)) for _ in range(60)] + ["\n".join(junk() for _ in range(4)) for _ in range(60)]
    model = quality.train(texts, [1] * 60 + [0] * 60, 0.5)
    mixed = "\n".join([line(), line(), "", line(), junk(), junk(), junk(), line(), line(), "  "])
    rows = [(1, mixed), (2, None), (3, " \n\t\n"), (4, junk()), (5, line()), (5, line()), (None, line()), (6, ("é" * 50 + " ") * 3000)]
    out = quality.score_quality(docs_of(rows), model).collect()
    got = [(r.doc_id, r.score, r.predicted, [x.line for x in r.bad_lines]) for r in out]
    by = {i: (s, p, b) for i, s, p, b in got}
    assert 5 in by[1][2] and not {0, 1, 2, 8, 9} & set(by[1][2])  # line 5 has bad lines on both sides, lines 0, 1 and 8 have none
    assert len(got) == 8 and by[4][1:] == (0, [0]) and by[5][1:] == (1, []) and by[2] == by[3] == (0.0, 0, [])
    assert quality.score_quality(docs_of([]), model).count() == 0
    one = quality.train(["a b."], [1], 1.0)
    assert [r.predicted for r in quality.score_quality(docs_of([(1, "x")]), one).collect()] == [1]
    assert quality.train([], [], 0.5).slope == 1.0


def test_line_features_do_not_depend_on_the_cut(monkeypatch):
    """Lines of several texts together, in small segments, and each text alone have the same features, and summed weights equal counted pairs."""
    import pyarrow as pa

    from furlong.llm._text import text_buffers

    texts = ["one two two\n\nThree! four|5\n \nend", "", "ünïcode line\nünïcode line\n", "\n", "last " * 500, None]
    whole = quality.lines(*text_buffers(pa.array(texts)))
    monkeypatch.setattr(quality, "_SEGMENT", 8)
    cut = quality.lines(*text_buffers(pa.array(texts)))
    weights = np.random.default_rng(1).normal(size=144)
    summed = quality.lines(*text_buffers(pa.array(texts)), weights)
    assert np.allclose(summed.shape[:, 0], whole.shape @ weights, atol=1e-5)
    for name in ("number", "length", "buckets", "shape", "first"):
        assert np.array_equal(getattr(whole, name), getattr(cut, name)), name
    assert whole.first.tolist() == [0, 3, 3, 5, 5, 6, 6] and whole.number.tolist() == [0, 2, 4, 0, 1, 0]
    alone = [quality.lines(*text_buffers(pa.array([t]))) for t in texts]
    assert np.array_equal(np.concatenate([a.buckets for a in alone]), whole.buckets)


def test_forward_backward_equals_all_labellings():
    rnd = np.random.default_rng(7)
    model = quality.QualityModel(moves=rnd.normal(size=(2, 2)), start=rnd.normal(size=2))
    emissions = rnd.normal(size=(5, 2))
    got = model.posteriors(emissions, np.array([0, 5]))
    want = np.zeros((5, 2))
    for labels in itertools.product((0, 1), repeat=5):
        p = np.exp(model.start[labels[0]] + sum(emissions[t, x] for t, x in enumerate(labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        for t, x in enumerate(labels):
            want[t, x] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True))
