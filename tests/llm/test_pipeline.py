"""The pipeline's stages, each held against a plain account of what it has to do."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import pii, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{k}" for k in "abcdefghijklmnopqrstuvwxyz") + " passage of many words that several documents have in common with each other"


def table():
    rng = random.Random(11)
    vocabulary = {"en": ["the", "of", "ring", "thin", "oning", "with", "that", "tion"], "de": ["der", "und", "schön", "über", "nicht", "keit", "ung"]}
    texts = [(" ".join(rng.choice(vocabulary[lang]) + rng.choice(vocabulary[lang]) for _ in range(rng.randint(60, 200))), lang) for lang in ("en", "de") for _ in range(30)]
    copies = [texts[0], texts[0], (texts[31][0].upper(), "de")]
    shared = [(f"{t[:200]} {PASSAGE} {t[200:]}", lang) for t, lang in (texts[5], texts[6])]
    texts[5], texts[6] = shared
    odd = [(None, "en"), ("", "de"), ("123 456", "en"), ("qxzjv kqwxz zzxqj vvkqx " * 12, "en")]
    private = [(f"{' '.join(reversed(texts[8][0].split()))} write to john@mail.example.com today", "en")]
    return [(i, t, lang, "s", len(t) if t else None) for i, (t, lang) in enumerate(texts + copies + odd + private)]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"file://{folder}/documents.parquet"), []
    seen.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"file://{folder}").write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        seen.append(docs)
    return folder, seen


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(staged):
    _, seen = staged
    assert all(df.columns == COLUMNS for df in seen[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "PII", "packing"]


def test_language_stage_drops_only_what_no_language_explains(staged):
    before, after = texts(staged[1][0]), texts(staged[1][1])
    gone = set(before) - set(after)
    assert gone == {k for k, t in before.items() if not t or t == "123 456" or t.startswith("qxzjv")}
    assert all(before[k] == t for k, t in after.items())


def test_near_duplicate_stage_keeps_one_of_each_group(staged):
    before, after = staged[1][1], texts(staged[1][2])
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
    assert set(after) == set(groups.values()) and len(after) < len(groups)


def test_rows_without_an_id_and_repeated_ids_are_decided_by_row(spark):
    long = " ".join(f"word{k}" for k in range(80))
    made = [(None, long, "en", "s", 1), (None, "another text of its own that nothing else is like", "en", "s", 2), (5, long, "en", "s", 3), (5, "quite a different text under the same id as one above", "en", "s", 4), (5, long, "en", "r", 9), (7, None, "en", "s", 0), (8, "  ", "en", "s", 2)]
    frame = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert got == {made[1], made[3], made[4], made[5]}


def test_genuine_replacement_characters_stay(spark):
    text = "é" * 30 + "漢字 a passage long enough to be found twice in the table"
    frame = spark.createDataFrame([(1, text, "en", "s", 1), (2, "\ufffd kept " + "ü" + text[1:] + "\ufffd", "en", "s", 1)], SCHEMA)
    after = texts(corpus_pipeline.repeated_passages(spark, frame, ""))
    assert after[1] == text and after[2] == "\ufffd kept ü\ufffd"


def test_passages_stay_in_one_document(staged):
    before, after = texts(staged[1][2]), texts(staged[1][3])
    assert set(before) == set(after)
    assert PASSAGE in after[5] and PASSAGE[:60] not in after[6]
    seen: set[str] = set()
    for k in sorted(before):
        own = {before[k][i : i + 50] for i in range(len(before[k]) - 49)}
        if not own & seen:
            assert after[k] == before[k]
        seen |= own
    assert {r.doc_id: r.n_chars for r in staged[1][3].collect()} == {k: len(t) for k, t in after.items()}


def test_personal_data_goes_and_clean_documents_stay(staged):
    before, after = texts(staged[1][3]), texts(staged[1][4])
    assert set(before) == set(after)
    for k, t in after.items():
        assert not pii.base(t)
        assert t == before[k] or pii.base(before[k])
    assert any("[EMAIL]" in t for t in after.values())


def test_everything_is_packed_once(spark, staged):
    folder, seen = staged
    lengths = {r.doc_id: (r.n, r.t) for r in seen[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()}
    assert set(lengths) == set(texts(seen[4])) and all(n == t for n, t in lengths.values())
    again = corpus_pipeline.run(spark, f"file://{folder}")
    key = ["doc_id", "start", "length"]
    total = lambda df: df.agg(F.count("*"), F.sum("length")).first()
    assert total(again)[1] == total(seen[5])[1] and set(key) <= set(again.columns)
