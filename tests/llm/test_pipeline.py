"""The pipeline against its stages done plainly."""

import hashlib
import random

import corpus_pipeline
from quire.llm import langid, pii

from .test_operators import EMAIL, plain_classes, plain_prints

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"]: r for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert set(kept) == {i for i, r in first.items() if r["text"] and langid._letter(r["text"])}
    assert all(kept[i] == first[i] for i in kept)

    two = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(kept.values()), docs.schema), SF)
    classes = plain_classes({i: plain_prints(r["text"], count=corpus_pipeline.PRINTS) for i, r in kept.items()}, corpus_pipeline.RADIUS)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for c in classes.values()})
    assert two.columns == corpus_pipeline.COLUMNS

    three = corpus_pipeline.substrings(spark, two, SF)
    four = corpus_pipeline.private(spark, three, SF)
    assert four.columns == corpus_pipeline.COLUMNS
    clean = {r["doc_id"]: r for r in four.collect()}
    field = pii.trained()
    for r in three.collect():
        (base, added) = field.spans([r["text"]])[0]
        text = clean[r["doc_id"]]["text"]
        assert (text == r["text"]) == (not base and not added)
        assert not EMAIL.search(text) and len(text) == clean[r["doc_id"]]["n_chars"]

    last = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == set(clean)
    total = {}
    for r in last:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["piece_length"]
    assert total == {i: len(r["text"].encode()) + 1 for i, r in clean.items()}


def test_language_stage_decides(spark):
    """Planted junk goes, wrong and missing labels are set right, clean documents stay."""
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r["doc_id"]: r for r in docs.collect() if r["text"] and langid._letter(r["text"])}
    junk = ["a 12345 67890 " * 20, "%%%% %%%% q %%%%", hashlib.sha256(b"k").hexdigest() * 4, "这是一个测试文本" * 3, "Это совсем другой язык, которого нет в выборке."]
    junk += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(n)) for n in (3, 30, 300)]
    rows = [(-1 - k, t, "en", "junk", len(t)) for k, t in enumerate(junk)]
    some = [r for r in clean.values() if len(r["text"]) > 300][:20]
    wrong = {10**9 + k: (r, None if k % 4 == 0 else "de" if r["lang"] == "en" else "en") for k, r in enumerate(some)}
    rows += [(i, r["text"], lang, r["source"], r["n_chars"]) for i, (r, lang) in wrong.items()]
    planted = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(rows, docs.select(*corpus_pipeline.COLUMNS).schema))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, planted, SF).collect()}
    assert set(got) == set(clean) | set(wrong)
    assert [got[i] for i in wrong] == [r["lang"] for r, _ in wrong.values()]
