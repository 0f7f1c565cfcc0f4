"""Queries that go through files: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.batches import small_batches
from quire.operators import nodes
from quire.plans.base import query, read
from quire.sources import readers as R
from quire.sources import writers as Z


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ln, CAST(doc_id AS VARCHAR) AS id, lang AS source, text AS target FROM documents")
def src01_win03_numbered_lines(spark, sf):
    """Several files, the first of them the smallest: tasks read the largest first. The last folder's are as many as the rows need."""
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.col("text").alias("target"), "doc_id")
    path, at = Z.scratch(spark, "jsonl"), F.col("doc_id").asc_nulls_last()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())
    for i, (part, files) in enumerate((("doc_id < 20", 1), ("doc_id >= 20 AND doc_id < 80", 1), ("doc_id >= 80 OR doc_id IS NULL", n))):
        Z.write_jsonl(d.where(part).repartitionByRange(files, at).sortWithinPartitions(at).drop("doc_id"), f"{path}/{i}")
    return R.read_samples(spark, f"{path}/*").select("ln", "id", "source", "target")


@query("SELECT conv_id, turn, text FROM conversations")
def src02_snk01_snk03_jsonl_round_trip(spark, sf):
    path = Z.scratch(spark, "jsonl")
    Z.write_jsonl(read(spark, sf, "conversations"), path)
    Z.write_jsonl(read(spark, sf, "conversations"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path).select("conv_id", "turn", "text")


@query("SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, text FROM benchmark")
def snk02_jsonl_append(spark, sf):
    path = Z.scratch(spark, "jsonl")
    for _ in range(2):
        Z.write_jsonl(read(spark, sf, "benchmark"), path, append=True)
    return spark.read.schema("item_id long, text string").json(path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE length(text) > 3000")
def snk04_selection_ids(spark, sf):
    path = Z.scratch(spark, "selection")
    Z.write_selection(read(spark, sf, "documents").where("length(text) > 3000"), path, "doc_id")
    return spark.read.text(f"{path}/ids").select(F.col("value").alias("id"))


@query("SELECT doc_id, text FROM documents")
def src03_src04_pruned_parquet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


@query("SELECT doc_id, lang, CAST(NULL AS BOOLEAN) AS is_table, CAST(NULL AS BIGINT) AS page_number FROM documents")
def src05_tolerant_parquet(spark, sf):
    return R.read_columns(spark, f"{sf}/documents.parquet", {"doc_id": "long", "lang": "string", "is_table": "boolean", "page_number": "int"})


@query("SELECT doc_id || '.pdf' AS member, './' || doc_id || '.pdf' AS raw, strlen(text) AS n, sha256(text) AS sha FROM documents")
def src06_tar_scan(spark, sf):
    spark.dataSource.register(R.TarSource)
    d = read(spark, sf, "documents").select(F.concat(F.lit("./"), "doc_id", F.lit(".pdf")).alias("m"), "text")
    path = Z.scratch(spark, "tar")
    Z.write_tars(d, path, "m", "text")
    t = spark.read.format("tar").option("suffix", ".pdf").load(path)
    return t.select("member", "raw", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id AS id, 'main.tex' AS name, text FROM documents")
def src07_source_bundles(spark, sf):
    import gzip

    small_batches(spark)
    d = read(spark, sf, "documents")
    packed = d.select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(lambda s: s.map(lambda t: gzip.compress(t.encode())), "binary")("text").alias("content"))
    return R.extract_sources(packed).select(F.col("path").cast("long").alias("id"), "name", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def src12_mixed_ids(spark, sf):
    i = F.col("doc_id").cast("string")
    path = Z.scratch(spark, "ids")
    Z.write_texts(read(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(i.alias("arxiv_id")))).otherwise(i).alias("v")), "v", path)
    return R.read_ids(spark, path)


@query("SELECT event_type AS path, CAST(max(event_id) AS VARCHAR) AS digest FROM events GROUP BY event_type")
def src13_state_log(spark, sf):
    """One file of a log, with broken lines."""
    d = read(spark, sf, "events").coalesce(1).sortWithinPartitions("event_id")
    line = F.to_json(F.struct(F.col("event_type").alias("path"), F.col("event_id").cast("string").alias("sha256")))
    path = Z.scratch(spark, "state")
    Z.write_texts(d.select(F.explode(F.array(line, F.lit("{broken"))).alias("v")), "v", path)
    return R.read_state(spark, path)


@query(
    """WITH l AS (SELECT event_type AS path, CASE WHEN event_id % 50 = 0 THEN 'again-' || event_id ELSE CAST(event_id AS VARCHAR) END AS digest, event_id % 50 = 0 AS later, event_id FROM events)
    SELECT path, arg_max(digest, (later, event_id)) AS digest FROM l GROUP BY path"""
)
def src13_win03_appended_log(spark, sf):
    """A small file, then a larger one, then a small one: what was written last wins."""
    d = read(spark, sf, "events")
    line = lambda digest: F.to_json(F.struct(F.col("event_type").alias("path"), digest.alias("sha256"))).alias("v")
    i = F.col("event_id")
    path = Z.scratch(spark, "state")
    for rows, digest in ((d.where("event_id % 100 = 1"), i.cast("string")), (d.where("event_id % 50 > 0 AND event_id % 100 <> 1"), i.cast("string")), (d.where("event_id % 50 = 0"), F.concat(F.lit("again-"), i))):
        Z.write_texts(rows.coalesce(1).sortWithinPartitions("event_id").select(line(digest)), "v", path, append=True)
    return R.read_state(spark, path)


@query("SELECT event_type || '/' || (event_id % 20) AS path, CAST(event_id % 3 AS VARCHAR) AS digest FROM events GROUP BY ALL")
def snk06_state_append(spark, sf):
    d = read(spark, sf, "events").select(F.concat("event_type", F.lit("/"), F.col("event_id") % 20).alias("path"), (F.col("event_id") % 3).cast("string").alias("digest")).distinct()
    path = Z.scratch(spark, "state")
    Z.write_jsonl(d.where("digest = '0'"), path)
    Z.append_state(d, path)
    return spark.read.schema("path string, digest string").json(path)


@query("SELECT item_id, 'x' || item_id AS title FROM benchmark")
def src09_sca45_feed(spark, sf):
    i = F.col("item_id").cast("string")
    entry = F.concat(F.lit("<entry><id>http://a/abs/"), i, F.lit("v2</id><title> x"), i, F.lit(" </title><author><name>A</name></author><author><name>B</name></author><category term='c'/></entry>"))
    path = Z.scratch(spark, "feed")
    # a page of a feed is one document: the benchmark's few hundred items at most
    page = read(spark, sf, "benchmark").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("v"))
    Z.write_texts(page, "v", path)
    f = R.read_feed(spark, path).where("authors = 'A, B' AND cats[0] = 'c'")
    return f.select(F.col("id").cast("long").alias("item_id"), "title")


@query(
    """SELECT doc_id, 'Para:abs ' || doc_id || '|Header:h|Str:kept' || CASE WHEN doc_id % 2 = 0 THEN '|Str:' || lang ELSE '' END || '|Para:cap|Math:x^2|Str:deep|Para:inner' AS kept FROM documents"""
)
def ast01_11_node_rules(spark, sf):
    """Nested nodes: div > (link > text, span > (cite > text), note > link > text), figures within divs."""
    kind = "struct<type string, target string, text string, caption string, attr string, within array<int>>"

    def node(type_, within=(), target="", text=None, caption=None, attr=None):
        text = text if text is None or not isinstance(text, str) else F.lit(text)
        return F.struct(
            F.lit(type_).alias("type"), F.lit(target).alias("target"), (F.lit(None) if text is None else text).cast("string").alias("text"), F.lit(caption).cast("string").alias("caption"),
            F.lit(attr).cast("string").alias("attr"), F.array(*map(F.lit, within)).cast("array<int>").alias("within"),
        ).cast(kind)

    every = [
        node("Header", text="h", attr="{#s}"),  # 0
        node("Div"),  # 1
        node("Link", (1,), target="http://x"),  # 2: what it holds stays
        node("Str", (1, 2), text="kept"),  # 3
        node("Link", (1,), target=F.when(F.col("doc_id") % 2 == 0, "http://y").otherwise("#s")),  # 4: within the text for odd ids
        node("Span", (1, 4)),  # 5
        node("Str", (1, 4, 5), text=F.col("lang")),  # 6
        node("Cite", (1,)),  # 7
        node("Str", (1, 7), text="gone"),  # 8
        node("Div", (1,)),  # 9
        node("Figure", (1, 9), caption="cap"),  # 10
        node("Image", (1, 9, 10), caption="gone"),  # 11
        node("Figure", (1, 9), caption=""),  # 12
        node("Math", (1, 9), text="x^2"),  # 13
        node("Note", (1, 9)),  # 14
        node("Link", (1, 9, 14), target="http://z"),  # 15
        node("Str", (1, 9, 14, 15), text="gone"),  # 16
        node("Span", (1, 9)),  # 17
        node("Span", (1, 9, 17)),  # 18
        node("Str", (1, 9, 17, 18), text="deep"),  # 19
        node("RawInline", (1,), text="gone"),  # 20
        node("RawBlock", text="gone"),  # 21
        node("Image", caption="inner"),  # 22
    ]
    abstract = F.array(node("Div"), node("Para", (0,), text=F.concat(F.lit("abs "), "doc_id")), node("Cite", (0,)))
    d = read(spark, sf, "documents").select("doc_id", nodes.with_abstract(nodes.clean_nodes(abstract), nodes.clean_nodes(F.array(*every))).alias("kept"))
    d = d.where(F.forall("kept", lambda n: n["attr"].isNull()))
    return d.select("doc_id", F.array_join(F.transform("kept", lambda n: F.concat(n["type"], F.lit(":"), n["text"])), "|").alias("kept"))
