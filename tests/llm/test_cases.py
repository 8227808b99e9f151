"""Cases that once went wrong, and branches that only large inputs reach."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs import classes, corpus, key

from furlong.llm import bpe, langid, ngram_join, pii, toxicity
from furlong.llm.near_copies import one_of_each_class


def test_spread_shingles_give_the_same_classes(docs_of, monkeypatch):
    """With a low limit shingles are spread over buckets; classes stay, and lone postings still go."""
    rows = corpus(random.Random(5))
    want = key(classes(rows))
    got = lambda: key([tuple(r) for r in ngram_join.near_duplicate_classes(docs_of(rows)).collect()])
    kept = {}
    star = ngram_join._star

    def counted(met):
        kept["rows"] = met.count()
        return star(met)

    monkeypatch.setattr(ngram_join, "_star", counted)
    assert got() == want
    plain = kept["rows"]
    monkeypatch.setattr(ngram_join, "hot_from", lambda counts: 4)
    monkeypatch.setattr(ngram_join, "POST_ROWS", 500)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_PROBES", 2)
    assert got() == want
    sets = [len(s) for s in ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows if t)]
    assert plain <= kept["rows"] < sum(ngram_join.prefix_length(n) for n in sets if n)


def test_hot_limit_grows_with_the_corpus():
    counts = np.full(1 << 10, 100)
    assert ngram_join.hot_from(counts) == ngram_join.HOT
    assert (counts * 1000 > ngram_join.hot_from(counts * 1000)).mean() <= 1 / ngram_join.HOT_SHARE


def test_near_copies_go_by_row(spark):
    """A wordless row beside a member of its id stays, rows of one id and different texts are apart, repeats of a lone row stay, names may clash."""
    long, other = "a b c d e f g h", "one two three four five six"
    rows = [(5, long), (6, long), (6, ""), (6, "quite another text of seven words here"), (8, other), (8, other), (9, None), (9, None), (None, long)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, id int, stays int, h int, i int, hit int")
    got = one_of_each_class(docs)
    assert got.columns == docs.columns
    kept = sorted([(r.doc_id, r.text) for r in got.collect()], key=str)
    assert kept == sorted([(5, long), (6, ""), (6, "quite another text of seven words here"), (8, other), (9, None), (9, None), (None, long)], key=str)
    assert one_of_each_class(docs.filter("false")).count() == 0


def test_values_that_cannot_change_are_no_secrets(docs_of):
    texts = ["password: ________", "token = ----////", "secret: ________1", None, "", "key of nothing"]
    out = {r.doc_id: r for r in pii.replace_entities(docs_of(list(enumerate(texts))), b"key").collect()}
    assert [out[i].text for i in (0, 1, 3, 4, 5)] == [texts[i] for i in (0, 1, 3, 4, 5)]
    assert out[2].n_entities == 1 and out[2].text != texts[2]


def test_persons_keep_their_identity(docs_of):
    texts = ["Mr John Smith met Mr Smith. Smith left with Dr Ann Lee, and Lee sang to Jane Doe.", "Jane Doe alone"]
    rows = [(0, texts[0]), (1, texts[1]), (None, texts[0]), (None, texts[1])]
    out = {(r.doc_id, len(r.text) > 30): r.text for r in pii.replace_entities(docs_of(rows), b"key").collect()}
    new = out[0, True]
    assert not any(x in new for x in ("John", "Smith", "Ann ", "Lee", "Jane", "Doe")) and out[None, True] == new
    surname = new.split(" met ")[0].split(" ")[-1]
    assert new.startswith(f"Mr {new.split(' ')[1]} {surname} met Mr {surname}. {surname} left with Dr ")
    jane = new.split(" sang to ")[1].rstrip(".")
    assert out[1, False] == f"{jane} alone"


@pytest.mark.parametrize("kind", ["name_m", "phone", "secret"])
def test_surrogates_stay_distinct_in_a_full_domain(spark, kind):
    """More entities than there are surrogates of their length: all still get distinct ones, none of them an entity."""
    values = {"name_m": [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)], "phone": [f"+{i:03d}" for i in range(150)], "secret": [f"-------{i}" for i in range(10)]}[kind]
    found = spark.createDataFrame([(kind, v) for v in values], "kind string, value string")
    special = {r.value: r.surrogate for r in pii.exceptions(found, b"k").collect()}
    final = [special.get(v) or pii.Surrogates(b"k").canonical(kind, v) for v in values]
    assert len(set(final)) == len(values) and not set(final) & set(values)


def test_columns_may_clash_in_surrogates(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", 7, 8)], "doc_id long, text string, special int, n_entities int")
    got = pii.replace_entities(docs, b"k").first()
    assert got.special == 7 and got.n_entities == 1 and "a@b.co" not in got.text


def test_a_long_run_without_blanks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rnd = Tokenizer.from_file(path), bpe.ByteBpe(path), random.Random(3)
    run = "".join(rnd.choice("abcdefghij") for _ in range(300_000))
    texts = [run, run[:1000] + " " + run, ("word, and " * 200_000)]
    for text, ids in zip(texts, own.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_runs_of_languages(docs_of):
    english, german = "the house and the garden were quiet in the evening while they waited", "das Haus und der Garten waren still am Abend während sie warteten"
    model = langid.train([english, german] * 20, ["en", "de"] * 20, ["de", "en"])
    mixed = f"{english}. {german}!"
    docs = docs_of([(1, mixed), (2, None), (3, "123"), (4, english)])
    got = {r.doc_id: r for r in langid.with_span_texts(langid.identify_languages(docs, model), docs).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[1].text == german and got[1].spans[0].words == 13
    assert got[2].spans == [] and got[3].spans == [] and [s.lang for s in got[4].spans] == ["en"]
    assert got[2].lang_pred == got[3].lang_pred == "und"


def test_emissions_equal_brute_force():
    """A word's potentials are the sum of the weights of its grams and, if it is in the lexicon, of its own."""
    texts = ["Über alle Maßen schön", "over all things fair"]
    model = langid.train(texts * 5, ["de", "en"] * 5, ["de", "en"])
    from furlong.llm._text import text_buffers
    import pyarrow as pa

    text, starts = langid._canonical(*text_buffers(pa.array(texts)))
    chain = langid._words(text, starts)
    got = model.emissions(text, chain)
    grams = langid._grams(text)
    hashes = langid._hashes(text, chain)
    for w, (b, e) in enumerate(zip(chain.begin, chain.end, strict=True)):
        want = sum((model.weights[g[p]].astype(float) for g in grams for p in range(b - 1, e) if g[p] >= 0), np.zeros(2))
        at = np.flatnonzero(model.lexicon == hashes[w])
        want = want + (model.lexicon_weights[at[0]] if len(at) else 0)
        assert np.allclose(got[w], want, atol=1e-4)


def test_offending_sentences_and_the_gradient(docs_of):
    """The sentence that makes the bag toxic is found; scores equal the noisy-or of sentences scored one at a time."""
    rnd = random.Random(1)
    clean = [" ".join(rnd.choice(["river", "stone", "cloud", "meadow", "lantern"]) for _ in range(6)) for _ in range(60)]
    texts = [f"{a}. {b}." for a, b in zip(clean[:30], clean[30:], strict=True)] + [f"{a}. you vile wretch." for a in clean[:30]]
    model = toxicity.train(texts, [0] * 30 + [1] * 30, 0.5)
    out = toxicity.score_toxicity(docs_of([(1, "river stone cloud. you vile wretch. meadow"), (2, "river stone"), (3, None)]), model)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].predicted == 1 and [x.sentence for x in got[1].offending] == ["you vile wretch"] and got[2].predicted == got[3].predicted == 0
    alone = toxicity.score_toxicity(docs_of([(i, t) for i, t in enumerate(["river stone cloud", "you vile wretch", "meadow"])]), model).collect()
    assert abs(got[1].score - (1 - np.prod([1 - r.score for r in alone]))) < 1e-9


def test_stages_on_empty_and_odd_rows(spark):
    """Stages keep clean rows, whatever their ids, and end well on an empty table."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(40).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    for name, stage in cp.STAGES[1:4]:
        assert stage(spark, docs.filter("false"), sf).count() == 0, name
        out = stage(spark, odd, sf)
        assert out.columns == docs.columns
    kept = cp.language(spark, docs, sf)
    lettered = docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert 0.9 * lettered <= kept.count() <= lettered and kept.filter(~F.col("text").rlike(r"\p{L}")).count() == 0
    replaced = {r.doc_id: r for r in cp.personal_data(spark, docs, sf).collect()}
    for r in docs.collect():
        found = pii.entities(r.text or "")
        assert (replaced[r.doc_id].text == r.text) == (not found)
        assert not {v for _, _, k, v in found if k in ("email", "secret", "access_key")} & set((replaced[r.doc_id].text or "").split())


def test_stages_take_any_extra_column(spark):
    """A column of the name that a stage would use, in any case of letters, is carried along."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumn("__text", F.lit(7)).withColumn("__TEXT_", F.lit(8))
    for name, stage in cp.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {(r["__text"], r["__TEXT_"]) for r in out.collect()} == {(7, 8)}, name


def test_surnames_stay_distinct_when_they_stand_alone(docs_of):
    """Persons of different surnames keep different ones in every kind of mention, over a whole corpus, and a surname keeps its surrogate with and without a given name."""
    key = b"surrogates of the registered queries"
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abdeiklmnorstu") for _ in range(n))
    surnames = sorted({letters(6).capitalize() for _ in range(70)}) + ["Smith", "Taylor"]
    texts = ["Mr Alexander Smith met Mr Alexander Taylor. Smith left and Taylor stayed."]
    pairs = [(rnd.choice(surnames), rnd.choice(surnames)) for _ in range(80)]
    texts += [f"Mr Alexander {a} met Mrs Alice {b}. Then {a} left and Mr {a} wrote to {b}." for a, b in pairs if a != b]
    out = {r.doc_id: r.text for r in pii.replace_entities(docs_of(list(enumerate(texts))), key).collect()}
    full = {}
    for i, text in enumerate(texts):
        old, new = re.findall(r"[A-Za-z-]+", text), re.findall(r"[A-Za-z-]+", out[i])
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            if a in surnames or a in ("Alexander", "Alice"):
                assert full.setdefault(a, b) == b != a and b not in surnames
            else:
                assert a == b
    assert len(set(full.values())) == len(full)
