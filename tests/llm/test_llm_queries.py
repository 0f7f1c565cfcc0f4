"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import duckdb
import pytest

from quire.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = c.execute(registry.ORACLES[name])
    order = [[x[0] for x in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from quire.llm import line_quality, packing, pii, toxicity
    from quire.llm.common import table, written

    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["clean_text"] for r in line_quality.line_first_clean(docs).where("kept").collect()}
    results = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        results[name] = docs
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.select("text", "n_chars").collect())
    text = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in results.items() if n != "packing"}
    assert text["quality"] == kept and set(kept) <= set(before)
    assert set(text["toxicity"]) <= set(text["quality"]) and all(text["quality"][i] == t for i, t in text["toxicity"].items())
    model = toxicity.train(results["quality"], table(spark, SF, "labels"))
    assert set(text["toxicity"]) == {i for i, t in text["quality"].items() if model.score(t) < toxicity.THRESHOLD}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.lower().split()) for i, t in text["toxicity"].items())}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(text["near_dedup"]) == {find(i) for i in sets}
    assert set(text["pii"]) == set(text["near_dedup"])
    for i, t in text["near_dedup"].items():
        if not pii.base_spans(t) and not pii._candidates(t, []):
            assert text["pii"][i] == t
        assert not any(k == "email" for k, _, _ in pii.base_spans(text["pii"][i]))
    tk = packing.Tokens(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    sizes = {i: len(x) // 4 + 1 for i, x in zip(text["pii"], tk.encode(list(text["pii"].values())))}
    packed = {r["doc_id"]: r["n"] for r in results["packing"].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert packed == sizes
