"""That the operators work by their methods."""

import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs.join(labels, "doc_id").where("lang = 'en'").select("doc_id", F.col("toxic").alias("y"), "text").cache()


def test_swaps_are_of_sentences():
    assert toxicity.swapped("The muslim man left.") == [
        "The christian man left.",
        "The jewish man left.",
        "The muslim girl left.",
        "The muslim boy left.",
    ]
    pairs = toxicity.counterfactuals("First words here. Two women came! Then rain")
    assert ("Two women came!".strip(), " Two men came!".strip()) in [(a.strip(), b.strip()) for a, b in pairs]
    assert toxicity.mention("") is None and toxicity.counterfactuals("...") == []


def test_labelled_rows_give_differing_pairs(labelled):
    index = {f: i for i, f in enumerate(sorted(set().union(*map(toxicity.features, toxicity.NAMES))))}
    rows = toxicity._encoded(labelled, index).select(F.aggregate(F.zip_with("left", "right", lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x).alias("n"))
    n, most = rows.agg(F.sum("n"), F.count("*")).first()
    assert n >= 2 * most > 0


def test_penalty_spares_neutral_mentions(spark, labelled):
    # most toxic texts name one group, few others do; a model that learns this flags neutral mentions
    named = F.concat("text", F.when(F.abs(F.xxhash64("doc_id")) % 100 < F.when(F.col("y") == 1, 90).otherwise(2), " The muslims came.").otherwise(""))
    rows = labelled.select("y", named.alias("text"))
    neutral = [r["text"] for r in labelled.where("y = 0").orderBy("doc_id").limit(150).collect()]
    hot = [r["text"] for r in labelled.where("y = 1").orderBy("doc_id").limit(60).collect()]
    score = {}
    for lam in (0.0, toxicity.LAMBDA):
        model = toxicity.fit(rows, lam)
        score[lam] = [model.score(f"{t} The muslims came.") for t in neutral], [model.score(t) for t in hot]
    flagged = {lam: sum(s >= toxicity.THRESHOLD for s in cold) for lam, (cold, _) in score.items()}
    assert flagged[toxicity.LAMBDA] < 0.5 * flagged[0.0]
    caught = [s >= toxicity.THRESHOLD for s in score[toxicity.LAMBDA][1]]
    assert sum(caught) >= 0.8 * len(caught)


def test_near_dedup_of_a_large_cluster_with_outliers(spark, monkeypatch):
    import random

    from quire.llm import simhash

    # a chain of texts, each near the next but not to those further on, and many copies of the first
    monkeypatch.setattr(simhash, "BLOCK_NODES", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    w = rng.choices(words, k=150)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        if i >= 40:
            w = list(w)
            for at in range((i - 40) * 5 % 140, (i - 40) * 5 % 140 + 8):
                w[at] = rng.choice(words)
        else:
            w = [*w[:-1], rng.choice(words)]
    rows += [(100 + i, " ".join(rng.choices(words, k=120))) for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
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
    got = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {find(i) for i in sets}


def test_components_at_a_hub_and_of_odd_links(spark):
    from quire.llm.components import components

    rows = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(7, 7), (None, 3), (4, None), (8000, 8001), (8001, 8000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{i: 5000 for i in range(5000, 5041)}, 8000: 8000, 8001: 8000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_katz_sorts_keys_by_their_first_bits():
    import numpy as np

    from quire.llm import katz

    r = np.random.default_rng(1)
    many = [r.integers(a, b, 5000, dtype=np.uint64) for a, b in ((0, 1 << 64), (0, 50), (1 << 60, (1 << 60) + (1 << 20)))]
    alike = np.repeat(r.integers(0, 1 << 60, 10, dtype=np.uint64) << np.uint64(4), 500) | r.integers(0, 8, 5000, dtype=np.uint64)
    for keys in (*many, alike, *(np.array(x, np.uint64) for x in ([], [5], [5, 5], [3, 1], [0, (1 << 64) - 1, 0, 1]))):
        assert (katz.sorting(keys) == np.argsort(keys, kind="stable")).all()


def test_katz_words_of_a_slice():
    import pyarrow as pa

    from quire.llm import katz

    for texts in ([None], [""], ["", None, "  a B\t\nc ", "\x0b\x0c\r\x1c x\x1f\x85y\xa0z Ä É", " ", "a", "\0 \0a ", "İ K a b"]):
        words, codes, edges = katz.word_codes(pa.array(texts, pa.string()))
        assert [[words[i] for i in codes[a:b]] for a, b in zip(edges, edges[1:])] == [(t or "").encode().lower().split() for t in texts]
        assert len(set(words)) == len(words)


def test_katz_chunks_end_with_the_text_that_fills_them(spark):
    from quire.llm import katz

    texts = [" ".join(f"w{j % 7}" for j in range(i % 11)) for i in range(60)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    ids, sizes = [], []
    for r in katz.make_chunks(docs, "doc_id", "text", 20).orderBy("chunk").collect():
        c = katz.Chunk.load(r["path"], r["size"])
        ids += c.ids
        sizes.append([int(n) for n in c.starts[1:] - c.starts[:-1]])
        whole, some = (katz.Chunk.load(r["path"], r["size"]) for _ in range(2))
        whole.index(3)
        some.index(3, places=False)
        assert all((getattr(whole, x)[3] == getattr(some, x)[3]).all() for x in ("keys", "counts", "asked"))
        assert r["tokens"] == sum(sizes[-1]) == len(c.tokens) and set(c.tokens) | {0, 1} >= set(range(len(c.words))) - {1}
    assert ids == list(range(60)) and sum(sizes, []) == [len(t.split()) + 1 for t in texts]
    assert all(sum(x[:-1]) < 20 for x in sizes) and all(sum(x) >= 20 for x in sizes[:-1])


def test_katz_tables_have_few_files(spark, tmp_path, monkeypatch):
    from quire.llm import katz

    lists, write = [], katz.written
    monkeypatch.setattr(katz, "written", lambda *x: lists.append(write(*x)) or lists[-1])
    docs = spark.createDataFrame([(i, f"a b{i % 9} c{i % 4} d") for i in range(80)], "doc_id long, text string").coalesce(1)
    katz.score_texts(docs, chunk=10).write.parquet(str(tmp_path / "out"))
    assert [t.select("chunk").distinct().count() for t in lists[:4]] == [40] * 4 and len(lists) == 6
    assert [len(t.inputFiles()) for t in lists] == [1] * 6
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(80)) and len(out.inputFiles()) == 1


def test_katz_of_empty_and_short_texts(spark):
    import math

    from quire.llm import katz

    rows = {r["doc_id"]: r for r in katz.score_texts(spark.createDataFrame([(i, "") for i in range(20)], "doc_id long, text string")).collect()}
    assert len(rows) == 20 and all(r["n_tokens"] == 1 and math.isfinite(r["score"]) for r in rows.values())
    rows = katz.score_texts(spark.createDataFrame([(i, "a" * (i % 3)) for i in range(20)], "doc_id long, text string"), chunk=1).collect()
    assert len(rows) == 20 and all(r["score"] <= 0 for r in rows)


def test_transducer_emits_before_the_piece_ends():
    P = pytest.importorskip("public_tokenizers")
    import random
    import string

    import numpy as np

    from quire.llm import bpe

    t = bpe.Transducer(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(6)
    for piece in (b"a" * 3000, "".join(rng.choices(string.ascii_lowercase, k=3000)).encode(), "é世😀".encode() * 300):
        stream, out, sure, lag = bpe.Stream(t), b"", 0, 0
        for i in range(len(piece)):
            got = stream.feed(piece[i : i + 1])
            out += got
            sure += sum(len(t.bytes_of[k]) for k in np.frombuffer(got, "<u4").tolist())
            lag = max(lag, i + 1 - sure)
        assert lag <= 64 and len(out) > 0.9 * len(t.encode(piece))
        assert out + stream.end() == t.encode(piece)


def test_whole_piece_tokens_in_streams():
    from quire.llm import bpe

    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")} | {b"ab": 4, b"abcd": 5}  # no merges leave abcd
    t = bpe.Transducer(ranks)
    stream = bpe.Stream(t)
    assert stream.feed(b"abcd") == b"" and stream.end() == t.packed[5] == t.encode(b"abcd")
    stream = bpe.Stream(t)
    assert stream.feed(b"abcda") != b"" or stream.held == b""
    assert t.encode(b"abcda") == b"".join(t.packed[i] for i in (4, 2, 3, 0))


def test_utf8_machine_replaces_as_python_does():
    import random

    from quire.llm import bpe

    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choices([0x41, 0x80, 0x8F, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xE0, 0xE1, 0xED, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF], k=rng.randint(0, 12)))
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.end() == data.decode("utf-8", "replace")


def test_likeness_of_many_repeated_lines():
    from quire.llm import multiset

    line = "one line of eight words it really is\n"
    a, b, c = (multiset.fingerprint(line * n) for n in (33_000, 32_000, 65_536))
    assert a.likeness(b) > 0.99 and c.likeness(a) > 0.7 and any(c.signs)
    total = c
    for _ in range(16):
        total = total + total  # lanes wrap around
    assert total.likeness(total - a + a) == 1.0


def test_neighbours_of_a_hot_id(spark):
    from quire.llm import multiset

    rows = [(7, f"text {i} of the hot id") for i in range(120)] + [(None, f"null {i}") for i in range(60)] + [(i, f"other {i}") for i in range(20, 60)]
    got = multiset.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert {r["fingerprint"] for r in got} == {str(multiset.fingerprint(t)) for _, t in rows}


def test_letters_are_one_piece_of_the_pattern():
    P = pytest.importorskip("public_tokenizers")
    import numpy as np

    from quire.llm import packing

    t = packing.Tokens(P.path("byte_bpe_50k.json"))
    letters = [c for c in map(chr, range(0x110000)) if packing.LETTERS(c)]
    assert len(letters) > 30_000
    words = [f" {a}{b}" for a, b in zip(letters, letters[1:])]
    got = t.encode(words)
    want = [e.ids for e in t.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_packing_cache_keeps_no_long_parts(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from quire.llm import packing

    t = packing.Tokens(P.path("byte_bpe_50k.json"))
    text = "世界" * 5000
    first = t.encode([text, "a few words"])
    assert max(map(len, t.parts)) <= packing.LONGEST_KEPT
    monkeypatch.setattr(packing, "CACHE_BYTES", 100)
    assert t.encode([text, "a few words"]) == first and t.encode(["a few words"]) == first[1:] and len(t.parts) < 10


def test_packing_encodes_many_new_words_as_one_text():
    P = pytest.importorskip("public_tokenizers")
    import itertools

    import pyarrow as pa

    from quire.llm import packing

    t = packing.Tokens(P.path("byte_bpe_50k.json"))
    words = [f" {a}{b}" for a, b in itertools.product(("ab", "Ünter", "мир", "世", "zzqx"), ("", "cd", "é", "한국", "ß"))] * 30
    words += [w[1:] for w in words]
    want = [packing._packed(e.ids) for e in t.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert list(t._words(words)) == want
    texts = ["".join(x) for x in itertools.product(("a", "'s", ".", " ", ",", "\n", "1", "é"), repeat=4)] + ["", "\0", "<|endoftext|>", " a\tb"]
    got, again = t.encode(texts), t.encode(texts)
    assert got == again == [packing._packed(e.ids) for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    parts = [pa.record_batch({"x": ["a" * n]}) for n in (1 << 22, 1 << 21, 5, 1 << 22, 1 << 24, 7)]
    assert [[len(x) for x in b.column(0).to_pylist()] for b in packing.gathered(iter(parts))] == [[1 << 22, 1 << 21, 5], [1 << 22], [1 << 24], [7]]


def test_packing_keeps_parts_in_few_bytes():
    P = pytest.importorskip("public_tokenizers")
    import tracemalloc

    import pyarrow as pa

    from quire.llm import packing

    t = packing.Tokens(P.path("byte_bpe_50k.json"))
    t.encode(["some words"])
    text = " ".join(f"w{i:x}" if i % 2 else f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(60_000))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        t.encode([text])
        kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    n = len(t.parts)
    assert n > 60_000 and kept < 64 * n
    again = t.encode([text, text[::-1], "", "x" * 100])
    assert again == [packing._packed(e.ids) for e in t.tokenizer.encode_batch([text, text[::-1], "", "x" * 100], add_special_tokens=False)]


def test_whole_licence_texts_match_exactly():
    from quire.llm import license_texts, licenses

    def plain(parts):
        import re

        text = " ".join(parts)
        text = re.sub(r"\{[0-9]+\}", "the holders", text)
        text = re.sub(r"\[[^\]|]*(\|[^\]]*)?\]", "", text)
        return re.sub(r"\(([^)|]*)(\|[^)]*)?\)", r"\1", text)

    scanner = licenses.Scanner()
    for label, parts in (("mit-text", license_texts.MIT), ("isc-text", license_texts.ISC), ("bsd-2-text", license_texts.BSD_2), ("bsd-3-text", license_texts.BSD_3), ("apache-2.0-text", license_texts.APACHE_2)):
        text = plain(parts)
        odd = f"Under a licence: {text.replace(' ', ', ', 3).upper()}."
        assert label in {x[0] for x in scanner.scan(odd)[2]}, label
        words = text.split()
        for at in (4, len(words) - 3):
            changed = " ".join([*words[:at], "never", *words[at:]])
            assert label not in {x[0] for x in scanner.scan(f"licence {changed}")[2]}, (label, at)


def test_pii_contexts_and_candidates(spark):
    from quire.llm import pii

    text = "Tel:555 777 1234, JOHN [AT] EXAMPLE.ORG; (a@b.org) x 12 345 6789 8th host 10[.]0[.]0[.]1 " + "1 2 " * 30 + "a1234567b"
    base = pii.base_spans(text)
    more = pii._candidates(text, base)
    assert [(k, text[a:b]) for k, a, b in more] == [("email", "JOHN [AT] EXAMPLE.ORG"), ("ip", "10[.]0[.]0[.]1"), ("phone", "555 777 1234"), ("phone", "12 345 6789")]
    assert pii._contexts(text, [more[2][1], base[0][1]]) == [["tel"], ["org", "example org"]]
    assert pii._contexts("x" * 150 + " 555", [151]) == [["x" * 150]]
    rows = [(i, f"contact:+1 (555) 000-{1000 + i}") for i in range(20)] + [(100, "contact:555 777 1234")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("phone", 8, 20)]


def test_pii_rounds_go_on_until_nothing_is_new(spark):
    from quire.llm import pii

    # each word stands before five numbers that only the word before it knows
    numbers = lambda k: [f"55{k} 777 {1000 + i}" for i in range(10)]
    rows = [f"seed +1 (555) 000-{1000 + i}" for i in range(9)] + [f"seed {x}" for x in numbers(0)[:2]]
    for k in range(6):
        word = chr(ord("a") + k) * 3
        rows += [f"{word} {x}" for x in ([*numbers(k)[:8]] if k else numbers(0)[:8])]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["pattern"] for r in pii.confident_patterns(pii.scan_texts(d).cache(), d).collect()}
    assert "seed" in found


def test_navigation_lines_of_any_length(spark):
    from quire.llm import line_quality

    lines = "Home | " + " | ".join(f"item {i}" for i in range(2000))
    words = "This is a full sentence, with more than a few words in it, and a stop at its end. "
    d = spark.createDataFrame([(1, f"{lines}\n{words * 40}"), (2, "|" * 200_000 + ". x"), (3, "home " + "| " * 100_000 + "? y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_quality.line_first_clean(d).collect()}
    assert "Home" not in got[1]["clean_text"] and words.strip() in got[1]["clean_text"]


def test_exploded_keys_are_not_broadcast(spark):
    """A table of fingerprints that Spark may broadcast; its keys are dozens of times as large."""
    from quire.llm import simhash

    fps = spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long")
    links = simhash.fingerprint_links(fps)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == [(1, 3), (1, 1 << 40), (3, 1 << 40)]
