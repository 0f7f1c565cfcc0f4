import difflib

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import tokens as K
from quire.operators import evaluation as E
from quire.operators import manifest as M
from quire.operators import pages as P
from quire.operators import samples as S
from quire.operators import sequences as Q
from quire.operators import synthetic as Y
from quire.operators import training as N
from quire.schema import IGNORE, SAMPLE
from quire.sources import readers as R
from quire.sources import writers as Z
from quire.sources.yaml import parse_yaml
from quire.streaming.ingest import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_image_tokens(spark):
    tiled = lambda w, h: one(spark, K.tiled_tokens(F.lit(1024), F.lit(640), F.lit(w), F.lit(h)))
    assert (tiled(3, 4), tiled(1, 1), one(spark, K.base_tokens(F.lit(1024)))) == (1513, 273, 273)


def test_visibility_golden(spark):
    labels = F.array(*map(F.lit, [IGNORE] * 3 + list(range(5, 9))))
    real = F.array(*[F.lit(True)] * 7)
    see = lambda q: one(spark, K.visible(F.lit(q), K.first_supervised(labels), 2, real))
    assert see(5) == [0, 1, 2, 4, 5]
    assert see(2) == [0, 1, 2]


@pytest.mark.parametrize(("step", "rate"), [(1, 6.67e-06), (15, 1.00e-04), (149, 1.35e-08), (150, 0)])
def test_learning_rate(spark, step, rate):
    assert one(spark, K.learning_rate(F.lit(step), 1e-4, 15, 150)) == pytest.approx(rate, rel=2e-2, abs=1e-12)


def test_scrub_keeps_formulas(spark):
    t = "<em>a</em> $x [@k]$ b [@k] $$<p>$$ c ,  d\n\n\n\ne"
    assert one(spark, X.scrub(F.lit(t))) == "a $x [@k]$ b $$<p>$$ c, d\n\ne"


def test_similarity_is_asymmetric_and_takes_nulls(spark):
    d = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("a", None)], "a string, b string")
    got = [r[0] for r in d.select(E.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("tide", "diet"), ("diet", "tide"), ("a", ""))]


def test_sequence_ids_are_dense(spark):
    d = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "ord int").where("ord % 3 > 0")
    got = [r["sample_id"] for r in P.sequence_ids(d, "ord", "p_", 4).orderBy("ord").collect()]
    assert got == [f"p_{i:04d}" for i in range(len(got))]


def test_line_numbers_count_blanks(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"target": "a"}\n\n  \n{"id": "q", "target": "b", "images": ["i.png"]}\n')
    rows = {r["ln"]: r for r in R.read_samples(spark, str(p)).collect()}
    assert sorted(rows) == [0, 3]
    done = S.normalised(R.read_samples(spark, str(p)), "/r").collect()
    assert {(r["id"], r["error"]) for r in done} == {("row_0", "images"), ("q", None)}


def test_checked_raises(spark):
    d = spark.createDataFrame([], SAMPLE).withColumn("ln", F.lit(0))
    with pytest.raises(ValueError, match="no samples"):
        S.checked(S.normalised(d, "/r"))
    bad = S.normalised(spark.createDataFrame([(1, None)], "ln int, id string").selectExpr("ln", "id", *(f"CAST(NULL AS {t}) AS {n}" for n, t in (("mode", "string"), ("image", "string"), ("images", "array<string>"), ("prompt", "string"), ("target", "string")))), "/r")
    with pytest.raises(Exception, match="invalid sample"):
        S.checked(bad).collect()


def test_state_log_skips_broken_lines(spark, tmp_path):
    p = tmp_path / "log"
    p.write_text('{"path": "a", "sha256": "1"}\n{bad\n{"path": "a", "digest": "2"}\n')
    assert [tuple(r) for r in R.read_state(spark, str(p)).collect()] == [("a", "2")]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(60)
    (src / "1.json").write_text('{"path":"a","size":1,"digest":"x"}\n{"path":"b","size":1,"digest":"y"}\n')
    run()
    (src / "2.json").write_text('{"path":"a","size":1,"digest":"x"}\n{"path":"a","size":1,"digest":"z"}\n')
    run()
    got = sorted((r["path"], r["digest"]) for r in spark.read.json(str(tmp_path / "state")).collect())
    assert got == [("a", "x"), ("a", "z"), ("b", "y")]


def test_yaml_scalars():
    assert parse_yaml("a: 1\nb: 1e-4 # c\nc: 'x: y'\nd: true\ne:\n# f: 1\n") == {"a": 1, "b": 1e-4, "c": "x: y", "d": True, "e": None}


def test_unsafe_paths_and_buckets(spark):
    rows = spark.createDataFrame([("/a",), ("a/../b",), ("a/b",), ("c",)], "p string").select(M.unsafe(F.col("p")), M.bucket(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(True, ""), (True, "a"), (False, "a"), (False, "(root)")]


def test_audit_is_sorted(tmp_path):
    Z.write_audit({"b": 1, "a": "é"}, f"file://{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_yaml_blocks_and_flows():
    text = "title: My $x$ paper: part\nabstract: |\n  One\n  two\n\n  three\nl:\n- a\n- b: 1\n  c: [1, 'x', {k: v}]\nn:\n  m: {a: 1, b: two}\n  o: >-\n    f1\n    f2\np: plain\n  goes on\n"
    want = {"title": "My $x$ paper: part", "abstract": "One\ntwo\n\nthree\n", "l": ["a", {"b": 1, "c": [1, "x", {"k": "v"}]}], "n": {"m": {"a": 1, "b": "two"}, "o": "f1 f2"}, "p": "plain goes on"}
    assert parse_yaml(text) == want
    assert parse_yaml("- 1\n- - 2\n  - 3\n-\n  x: 1\n") == [1, [2, 3], {"x": 1}] and parse_yaml("# nothing\n") is None


@pytest.mark.parametrize("text", ["a: &x 1", "a: [1", "- a\nb: 1", "a: 'x' y", "a:\n   b: 1\n  c: 2", "a: !t 1", "---\na: 1", "a: *x"])
def test_yaml_that_is_not_read_raises(text):
    with pytest.raises(ValueError):
        parse_yaml(text)


def test_config_over_defaults(tmp_path):
    (tmp_path / "c.yaml").write_text("lr: 1e-4\nmodules: [a, b]\nrun:\n  seed: 0\n")
    assert R.read_config(str(tmp_path / "c.yaml"), {"lr": 1, "steps": 5}) == {"lr": 1e-4, "steps": 5, "modules": ["a", "b"], "run": {"seed": 0}}
    (tmp_path / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="no mapping"):
        R.read_config(str(tmp_path / "d.yaml"))


def test_lines_are_numbered_over_files(spark, tmp_path):
    lines = [f"a{i}" for i in range(5)], ["", "b" * 5000, " ", *(f"b{i}" * 9 for i in range(3000))], [], ["c"]
    for name, part in zip("1234", lines):
        (tmp_path / f"part-{name}").write_text("".join(f"{x}\n" for x in part))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files are read in parts
    try:
        got = R.numbered_lines(spark, str(tmp_path)).orderBy("ln").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(x, i) for i, x in enumerate(x for part in lines for x in part)]


def test_last_write_wins_over_appended_files(spark, tmp_path):
    import os

    for k, (name, rows) in enumerate((("z", [("a", "old")]), ("m", [("a", "new"), *((f"p{i}", "x") for i in range(500))]), ("b", [("p1", "last")]))):
        (tmp_path / name).write_text("".join(f'{{"path": "{p}", "digest": "{d}"}}\n' for p, d in rows))
        os.utime(tmp_path / name, (1_000_000 + k, 1_000_000 + k))
    got = {r["path"]: r["digest"] for r in R.read_state(spark, str(tmp_path)).collect()}
    assert (got["a"], got["p1"], got["p2"], len(got)) == ("new", "last", "x", 501)


def test_state_append_waits_for_the_lock(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    new = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "path string, digest string")
    Z.append_state(new, path)
    Z.append_state(new.unionByName(spark.createDataFrame([("b", "3")], "path string, digest string")), path)
    assert sorted((r["path"], r["digest"]) for r in spark.read.json(path).collect()) == [("a", "1"), ("b", "2"), ("b", "3")]
    (tmp_path / "state.lock").write_text("")
    with pytest.raises(TimeoutError), Z.locked(spark, path, wait=0.5):
        pass


def test_money_rounds_the_binary_value(spark):
    import random

    rng = random.Random(8)
    values = [0.125, 0.375, 1.005, 2.675, -0.001, 0.0, -0.0, 0.005, 0.015, 1e-9, 99.995, 1234567.125, 5e-324, 0.994999999, 0.995, 1e14 + 0.125]
    values += [rng.randint(0, 10**6) / 1000 for _ in range(3000)] + [rng.uniform(-50, 50) for _ in range(1000)] + [rng.randint(0, 10**5) / 8 for _ in range(500)]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.money(F.col("v")).alias("m"))
    assert all(r["m"] == f"{r['v']:.2f}" for r in d.collect())
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (None,)], "v double").select(X.money(F.col("v"))).collect()] == [None, None]


def test_error_rates(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    pairs = [("a b c d", "a x c"), ("", "a"), ("a", ""), ("one two\n\nthree\n\nfour", "three\n\none two\n\nfour"), ("kitten on a mat " * 9, "sitting on the mat " * 8), (None, "a")]
    d = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = d.select("a", "b", E.char_error_rate(a, b).alias("c"), E.word_error_rate(a, b).alias("w"), E.block_order(a, b).alias("o")).collect()
    for r in got:
        x, y = r["a"], r["b"]
        if x is None:
            assert r["c"] is None and r["w"] is None and r["o"] is None
            continue
        assert r["c"] == pytest.approx(plain(x, y) / max(len(x), 1)) and r["w"] == pytest.approx(plain(x.split(), y.split()) / max(len(x.split()), 1))
        p, q = ([k.strip() for k in t.split("\n\n") if k.strip()] for t in (x, y))
        assert r["o"] == pytest.approx(plain(p, q) / max(len(p), len(q), 1))


def test_synthetic_dataset(spark, tmp_path):
    path = f"file://{tmp_path}/train"
    Z.write_jsonl(Y.samples(spark, singles=3, multis=2, pages=2, seed=123), path)
    rows = spark.read.json(path).collect()
    one, many = ([r for r in rows if r["mode"] == m] for m in ("single_gundam", "multi_base"))
    assert (len(rows), len(one), len(many)) == (5, 3, 2)
    assert all(r["target_type"] == "page_markdown" and r["prompt"].startswith("<image>") and r["target"].strip() and "markdown" in r["source"] for r in rows)
    assert all(len(r["images"]) == 1 and "# " in r["target"] and "<table>" in r["target"] for r in one)
    assert all(len(r["images"]) == 2 and r["target"].count("<PAGE>") == 2 for r in many)
    again = Y.samples(spark, singles=3, multis=2, pages=2, seed=124).collect()
    assert {r["target"] for r in again}.isdisjoint(r["target"] for r in rows)
    got = spark.range(500).select(F.explode(Y.items(5, F.col("id"))).alias("x")).select("x.*").agg(F.min("qty"), F.max("qty"), F.min("price"), F.max("price")).first()
    assert got[0] == 1 and got[1] == 6 and 3.5 <= got[2] < 4.5 and 38.9 < got[3] <= 39.9


def test_train_modes_that_meet_nothing_raise(spark):
    d = spark.createDataFrame([("layers.0.self_attn.q_proj", 3)], "name string, numel long")
    with pytest.raises(ValueError, match="meets no"):
        N.applied(d, "lora_attn")
    with pytest.raises(ValueError, match="unknown mode"):
        N.applied(d, "other")


def test_samples_keep_meta_and_absent_keys(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"mode": null, "image": "a", "target": "t"}\n{"image": "a", "target": "t", "meta": {"chunk": "c"}}\n{"id": null, "image": "a", "target": "t"}\n')
    got = S.normalised(R.read_samples(spark, str(tmp_path / "x.jsonl")), "/r").collect()
    assert [(r["id"], r["mode"], r["error"], r["meta"]["chunk"]) for r in got] == [("row_0", None, "mode", None), ("row_1", "single_gundam", None, "c"), (None, "single_gundam", None, None)]


@pytest.mark.parametrize("text", ["abc", "x" * 40, "a\0b\0\0" * 9, "\0", "one<image>two\0", "é\U0001f600" * 50])
def test_digests_of_what_positions_see(text, monkeypatch):
    """Shared passes, ids that aren't real and chunks' borders, against each position by itself."""
    import hashlib

    monkeypatch.setattr(Q, "CHUNK", 7)
    samples = [Q.sample("<image>en", text, 6), Q.sample("<image>en", text * 2, 6), None, Q.sample("<image>de", "word " * 9, 6), Q.sample("", text, 6)]
    for s, got in zip(samples, Q.visible_digests(samples, 4)):
        if s is None:
            assert got is None
            continue
        bound, ids = Q.first_supervised(s.labels), s.ids.tolist()
        want = ";".join(",".join(str(k) for k in range(q + 1) if (k < bound or q - k < 4) and ids[k]) for q in range(len(ids)))
        assert got == hashlib.sha256(want.encode()).hexdigest()


def test_size_of_encoded_texts(spark):
    texts = ["", "a", "<image>", "a<image>b<image><image>", "<ima<image>ge>", "é\U0001f600\0"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.encoded_size(F.col("t"), 6).alias("n"))
    assert {r["t"]: r["n"] for r in d.collect()} == {t: len(Q.encoded(t, 6)[0]) for t in texts}


def test_visibility_makes_a_shared_prefix_once(monkeypatch):
    made = []
    seen = Q._seen
    monkeypatch.setattr(Q, "_seen", lambda real, bound, window, start, end: made.append(end - start) or seen(real, bound, window, start, end))
    samples = [Q.sample("<image>en", "x" * n, 6) for n in range(1, 300)]
    Q.visible_digests(samples, 4)
    assert sum(made) == len(samples[-1].ids)


def test_money_near_half_cents(spark):
    """Where the nearest whole number of cents is taken, and where exact decimals decide."""
    import math

    values = [x for k in (1, 3, 7, 2**29, 2**30 - 1, 2**30, 2**30 + 1) for c in (0.005, 0.125, 0.375, 0.00499, 0.00501, 0.995) for x in (k + c, math.nextafter(k + c, 0), math.nextafter(k + c, 2**40), -k - c)]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.money(F.col("v")).alias("m"))
    assert [(r["v"], r["m"]) for r in d.collect()] == [(v, f"{v:.2f}") for v in values]


def test_strip_takes_white_space_of_any_kind(spark):
    """As Python's; and not by a pattern, which would try every gap of a text."""
    import sys

    blank = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
    texts = [blank, "", "a", f"{blank}a{blank}\U0001f600{blank}", "\u200b a \u200b", " \n é\r\n", "x\0\n", "\u2028b\u2029\n"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip(F.col("t")).alias("s"))
    assert [(r["t"], r["s"]) for r in d.collect()] == [(t, t.strip()) for t in texts]
    assert "regexp_replace" not in d._jdf.queryExecution().optimizedPlan().toString()
