"""Queries over whole tables and texts against plain versions."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quire.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_tar_scan_has_all_documents(spark, docs):
    got = sorted(tuple(r) for r in rows(spark, "src06_tar_scan"))
    assert got == sorted((f"{i}.pdf", f"./{i}.pdf", len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items())


def test_source_bundles_have_all_documents(spark, docs):
    assert sorted(tuple(r) for r in rows(spark, "src07_source_bundles")) == sorted((i, "main.tex", t) for i, t in docs.items())


def test_listing_has_all_documents(spark, docs):
    assert sorted(tuple(r) for r in rows(spark, "src08_recursive_listing")) == sorted((i, len(t.encode())) for i, t in docs.items())


def test_listing_has_empty_and_null_texts(spark, tmp_path):
    made = [(0, ""), (1, "é"), (20_004, ""), (-5, "abc"), (6, None)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["src08_recursive_listing"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(-5, 3), (0, 0), (1, 2), (6, None), (20_004, 0)]


def test_numbered_lines_are_spread_over_files(spark, tmp_path, monkeypatch):
    from quire.plans import source_queries as Q

    spark.range(3000).selectExpr("id AS doc_id", "'en' AS lang", "concat('t', id) AS text").orderBy(F.rand(1)).write.parquet(str(tmp_path / "documents.parquet"))
    at = f"file://{tmp_path}/lines"
    monkeypatch.setattr(Q.Z, "scratch", lambda spark, name: at)
    got = catalog.QUERIES["src01_win03_numbered_lines"](spark, str(tmp_path)).collect()
    assert sorted((r["ln"], r["id"], r["target"]) for r in got) == [(i, str(i), f"t{i}") for i in range(3000)]
    counts = [r["n"] for r in spark.read.option("recursiveFileLookup", "true").text(at).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(counts) < 1500


def test_bundles_come_in_small_batches(spark, tmp_path):
    """What a worker holds doesn't grow with the rows of a partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        catalog.QUERIES["src07_source_bundles"](spark, SF)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_human_bytes_of_all_events(spark):
    def human(n):
        for unit, size in (("B", 1), ("KiB", 1 << 10), ("MiB", 1 << 20)):
            if n < size << 10:
                return f"{n / size:.2f} {unit}"
        return f"{n / (1 << 30):.2f} GiB"

    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "CAST(floor(abs(value) * 1000) AS BIGINT) AS size").collect()
    want = sorted((e["event_id"], human(e["size"] * (e["event_id"] % 1000 + 1) * 2 + 1)) for e in events)
    assert sorted(tuple(r) for r in rows(spark, "sca13_human_bytes")) == want


def test_visibility_of_all_documents(spark, docs):
    assert {r["doc_id"] for r in rows(spark, "sca40_jon10_win05_06_visibility")} == {i for i, t in docs.items() if t}


def test_epoch_shuffle_numbers_all_documents(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["pos"], r["doc_id"], r["batch"]) for r in catalog.QUERIES["smp01_bat01_epoch_shuffle"](spark, str(tmp_path)).collect())
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"7:0:{i}".encode()).hexdigest())
    assert got == [(p, i, p // 8) for p, i in enumerate(order)]


def test_token_layouts_of_whole_texts(spark, tmp_path):
    texts = {0: "a" * 10, 1: "é\U0001f600x\0" * 100, 2: "word " * 700, 8: "b", 9: "c" * 60, 16: "", 17: None}
    prompt = {i: f"{'en' * (i % 2 + 1)}s{i}" for i in texts}
    made = [(i, t, "en" * (i % 2 + 1), f"s{i}") for i, t in texts.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    ids = {i: [0] + [128815] * 6 + [ord(c) for c in prompt[i] + t] for i, t in texts.items() if t}
    first = {i: 7 + len(prompt[i]) for i in ids}
    labels = {i: [-100 if k < first[i] else x for k, x in enumerate(v)] for i, v in ids.items()}
    joined = lambda v: ",".join(map(str, v))
    assert run("sca34_36_agg13_label_mask") == sorted((i, joined(v), sum(x != -100 for x in v), 6, first[i]) for i, v in labels.items())
    size = {i: max(len(v) for j, v in ids.items() if j // 8 == i // 8) for i in ids}
    assert run("sca37_39_agg17_pad_batch") == sorted((i, size[i], joined(v + [0] * (size[i] - len(v))), sum(x != 0 for x in v)) for i, v in ids.items())
    seen = lambda i, v: ";".join(joined(k for k in range(q + 1) if (k < first[i] or q - k < 4) and v[k]) for q in range(len(v)))
    assert run("sca40_jon10_win05_06_visibility") == sorted((i, first[i], len(v), hashlib.sha256(seen(i, v).encode()).hexdigest()) for i, v in ids.items())
    assert run("sca41_additive_mask") == sorted((i, joined("0" if k <= 9 and (k < 3 or 9 - k < 4) else "-inf" for k in range(len(v)))) for i, v in ids.items() if len(v) > 9)
    assert run("prd21_batch_sanity") == [(0, 3, 0, True), (1, 2, 0, True)]
