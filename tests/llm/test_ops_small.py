"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, katz, licenses, line_quality, multiset, packing, pii, simhash, toxicity, warc
from quire.llm.common import fresh_dir

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, fp string, component_id string, row string, score string, base string, spans string, n_words string, ids string, t string, kept string, at string, id string, mark string"
LONG = "word " * 30_000 + "x" * 50_000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (None, "a b c d e f"), (7, "Same text, twice. " * 9), (8, "Same text, twice. " * 9), (9, None)]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, *["clash"] * 13) for r in rows], SCHEMA)


ROWWISE = {
    "op1": lambda d: simhash.near_classes(d),
    "op3": lambda d: multiset.edited_neighbours(d),
    "op6": lambda d: pii.find_pii(d),
    "op7": lambda d: bpe.encode_texts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "op8": lambda d: licenses.scan_licenses(d),
    "op9": lambda d: katz.score_texts(d),
    "op10": lambda d: line_quality.line_first_clean(d),
}


@pytest.mark.parametrize("op", sorted(ROWWISE))
def test_odd_rows_each_give_a_row(spark, op):
    got = sorted((r["doc_id"] for r in ROWWISE[op](frame(spark)).collect()), key=str)
    assert got == sorted((r[0] for r in TEXTS), key=str)


@pytest.mark.parametrize("op", sorted(ROWWISE))
def test_empty_table(spark, op):
    assert ROWWISE[op](frame(spark, [])).collect() == []


def test_score_texts_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark), labels)
    got = toxicity.score_texts(frame(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] < 1e-9 for r in got)
    assert toxicity.score_texts(frame(spark, []), model).collect() == []


def test_packing_odd_rows(spark):
    got = packing.pack(frame(spark), P.path("byte_bpe_50k.json")).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 1024
    assert total[1] == total[2] == total[9] == 1 and total[5] == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 5)
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.json")).collect() == []


def test_warc_odd_rows(spark):
    rows = [(1, None, None), (2, "u", "x" * 100), (3, "u", "x" * 100), (3, "u", "x" * 100), (None, "u", "x" * 100), (4, "u", "y" * 99), (5, "u", "y" * 99), (6, "u", "z" * 3_000_000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archive(warc.write_archive(d, fresh_dir(spark, "w"))).collect()), key=str)
    want = [(1, "response", None, 0), (2, "response", None, 100), *[(3, "revisit", 2, 100)] * 2, (4, "response", None, 99), (5, "response", None, 99), (6, "response", None, 3_000_000), (None, "revisit", 2, 100)]
    assert got == sorted(want, key=str)
    assert warc.read_archive(warc.write_archive(d.where("false"), fresh_dir(spark, "w"))).collect() == []


def test_near_dedup_odd_rows(spark):
    got = simhash.near_dedup(frame(spark)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([1, 4, 5, None, 7], key=str)
    assert all(r["mark"] == "clash" for r in got)
    assert simhash.near_dedup(frame(spark, [])).collect() == []


def test_clean_and_redact_keep_columns(spark):
    d = frame(spark, [*TEXTS, (11, "Write to me.x@mail1.example.com or not. " * 8)])
    kept = line_quality.clean_documents(d)
    assert kept.columns == d.columns
    shown = pii.redact(d).where("doc_id = 11").first()
    assert "@" not in shown["text"] and "[EMAIL]" in shown["text"] and shown["t"] == "clash"
    assert pii.redact(d).where(F.col("doc_id") == 1).first()["text"] is None
