"""Every operator and pipeline stage on awkward tables: NULLs, empty and long texts, ties, repeated rows, clashing names, no rows."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from folioscope.llm import (  # noqa: E402
    bag_minhash,
    budget_mixing,
    chat_windows,
    cross_parsing,
    fertility_rules,
    minhash_prints,
    piece_codec,
    suffix_tree_lm,
    token_lengths,
    toxic_sentences,
)

CLASH = ["key", "row", "node", "score", "kind", "label", "band", "sketch", "range", "tokens", "copies", "domain", "language", "n", "order", "feature"]
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20000))


def awkward(spark):
    same = "the same text appears more than once in this table and says nothing new at all"
    rows = [
        (None, "a text without an id but with words enough to count for something", "en", "src0"),
        (None, None, None, None),
        (1, None, "en", "src1"), (2, "", "en", None), (3, " \t\n ", None, "src2"), (4, "12345 !!! 67", "de", "src3"),
        (5, same, "en", "src0"), (6, same, "en", "src0"), (6, same, "en", "src0"), (7, same + " and more", "en", "src0"),
        (8, LONG, "en", "src4"), (9, "x" * 100_000, None, "src5"), (10, "einzelne Wörter für den Anfang, und noch ein paar", "de", "src6"),
        (11, "日本語の文章です。 ▁ \u0000 ﻿ é", None, "src7"), (12, "A.", "en", "src8"), (-3, "you stupid idiot. fine day", "en", "src9"),
        (9_000_000_000, "a far away id", "en", "src0"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH]).repartition(3)


def told(spark):
    return spark.createDataFrame([(-3, 1), (5, 0), (5, None), (7, 0), (None, 1), (10, 0), (8, 0), (9, 0), (999, 1)], "doc_id bigint, toxic int")


OPERATORS = {
    "codes": lambda s, d: piece_codec.digests(d),
    "encoded": lambda s, d: piece_codec.encoded(d),
    "lengths": lambda s, d: token_lengths.token_lengths(d),
    "near": lambda s, d: bag_minhash.near_duplicates(d),
    "near prints": lambda s, d: minhash_prints.near_duplicates(d),
    "prints": lambda s, d: minhash_prints.fingerprints(d),
    "neighbours": lambda s, d: minhash_prints.neighbour_prints(d),
    "languages": lambda s, d: cross_parsing.languages(d),
    "toxicity": lambda s, d: toxic_sentences.toxicity(d, told(s)),
    "model": lambda s, d: suffix_tree_lm.model_scores(d),
    "quality": lambda s, d: fertility_rules.quality(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, name):
    docs = awkward(spark)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(r["doc_id"]) for r in docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_in_none_out(spark, name):
    assert OPERATORS[name](spark, awkward(spark).where("false")).collect() == []


def test_defined_values(spark):
    docs = awkward(spark)

    def by_id(df):
        return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}

    languages = by_id(cross_parsing.languages(docs))
    assert all(languages[i]["lang_pred"] == "und" and languages[i]["score"] == 0.0 for i in (1, 2, 3, 4))
    toxic = by_id(toxic_sentences.toxicity(docs, told(spark)))
    assert all(toxic[i]["score"] == 0.0 for i in (1, 2, 3))
    codes = by_id(piece_codec.encoded(docs))
    assert codes[1]["ids"] == codes[2]["ids"] == [1, 2] and codes[1]["decoded"] == ""
    classes = by_id(bag_minhash.near_duplicates(docs))
    assert classes[5]["class_id"] == classes[6]["class_id"] == 5 and classes[1]["class_id"] == 1 and classes[2]["class_id"] == 2
    prints = by_id(minhash_prints.fingerprints(docs))
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] == "" and prints[5]["fingerprint"] == prints[6]["fingerprint"] != ""
    lengths = by_id(token_lengths.token_lengths(docs))
    assert (lengths[1]["n_words"], lengths[3]["n_tokens"], lengths[9]["n_words"]) == (0, 0, 1)
    quality = by_id(fertility_rules.quality(docs))
    assert quality[1]["base_failed"] and not quality[1]["kept"] and quality[11]["band"] not in ("Latin", "Zyyy")
    model = by_id(suffix_tree_lm.model_scores(docs))
    assert model[1]["n_tokens"] == model[2]["n_tokens"] == model[3]["n_tokens"] == 1


def test_tables_of_one_row(spark):
    one = awkward(spark).where("doc_id = 5").limit(1)
    assert minhash_prints.neighbour_prints(one).first()["near_next"] == 1.0
    assert bag_minhash.near_duplicates(one).first()["class_id"] == 5
    assert suffix_tree_lm.model_scores(one).count() == 1


def test_mixing_takes_only_texts_with_tokens(spark):
    docs = awkward(spark)
    mixed = budget_mixing.mixed_rows(docs, F.lit("all"), {}, 100, 3)
    taken = mixed.select("row.text", "row.copies", F.col("copies").alias("times"), "part", "n_tokens").collect()
    assert all(r["text"] and r["text"].strip() and r["copies"] == "extra copies" for r in taken)
    assert sum(r["times"] * r["n_tokens"] + r["part"] for r in taken) == sum(len(r["text"].split()) for r in docs.where("text IS NOT NULL").collect())
    assert budget_mixing.mixed_rows(docs.where("false"), F.lit("all"), {}, 100, 3).collect() == []


def test_conversations(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (1, None, "user", "first of all"),
        (None, 0, None, "[INST] who? </s>"), (2, 5, "assistant", "w " * 5000), (3, 1, "tool\nx", "<s>[\\INST]"), (3, 0, "assistant", "yes")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("conv", F.lit("x")).withColumn("chunk", F.lit("y"))
    got = {r["conv"]: r for r in chat_windows.read_back(chat_windows.windows(table)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 5, None: 1, 2: 1, 3: 2}
    assert got[3]["loss_chars"] == 3 and got[2]["loss_chars"] == 10000 and got[1]["loss_chars"] == 0
    assert chat_windows.read_back(chat_windows.windows(table.where("false"))).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    told(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark)
    docs = docs.where("false") if empty else docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        found = out.count()
        assert (found == 0) == empty, name
        if name == "pieces":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            break
        assert out.columns == columns, name
        docs = out
