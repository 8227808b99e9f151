"""The stages in a row, against what each should have kept."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        following = corpus_pipeline.stored(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((name, docs, following))
        docs = following
    return out


def test_stages_keep_the_columns_of_documents(staged):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _, _ in staged] == ["toxicity", "language ID", "n-gram Jaccard join", "PII", "best-fit packing"]
    for _, before, _ in staged:
        assert before.columns == columns


def test_toxic_documents_go_and_clean_ones_stay(staged):
    _, before, after = staged[0]
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    clean = [d for d, y in labels.items() if y == 0]
    toxic = [d for d, y in labels.items() if y == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.3 * len(toxic)


def test_near_copies_go(staged):
    from test_pairs import classes

    _, before, after = staged[2]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    want = {c if n else d for d, n, c in classes(rows)}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want


def test_every_token_is_packed(staged):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, before, after = staged[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.select("text").collect())
    assert after.groupBy().sum("length").first()[0] == want
