"""Queries over pages, samples and texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import pages as P
from quire.operators import samples as S
from quire.plans.base import WITH_PAGES, pages, query, read
from quire.schema import PAGE_BREAK, PAGE_TOKEN

STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
TRIMMED = STRIP.format("natural_text")
CONVERT = f"""primary_language = 'en' AND is_rotation_valid IS DISTINCT FROM false AND is_diagram IS DISTINCT FROM true
  AND length({TRIMMED}) BETWEEN 200 AND 5000"""


#: A sample's meta as JSON; null fields are written. Fields that a producer doesn't have come last.
META_SQL = """CAST(to_json({{'chunk': chunk, 'arcname': regexp_replace(regexp_extract(pdf_relpath, 'tar[.]gz:(.*)', 1), '^[.]/', ''), 'page_id': {page_id}, 'img_w': img_w, 'img_h': img_h, 'char_len': length(natural_text), 'language': primary_language,
    'is_table': is_table, 'is_diagram': is_diagram, 'license': 'odc-by', 'n_pages': NULL, 'page_ids': NULL, 'arxiv_id': NULL}}) AS VARCHAR)"""
PAGE_SQL = """'page_' || lpad(CAST(row_number() OVER (ORDER BY ord) - 1 AS VARCHAR), {digits}, '0') AS id, 'pages' AS source, 'images/page_' || lpad(CAST(row_number() OVER (ORDER BY ord) - 1 AS VARCHAR), {digits}, '0') || '.png' AS image,
    'single_gundam' AS mode, '<image>Read this page.' AS prompt, natural_text AS target, 'natural_text_or_html' AS target_format, 'full_page_parse' AS task"""


def _shown(samples):
    """A sample's fields, meta as JSON, without those that are null in all rows."""
    return samples.withColumn("meta", F.to_json("meta", {"ignoreNullFields": "false"}))


def _arcs(d):
    return P.located(d).withColumn("member", F.regexp_replace("member", r"^\./", ""))


@query(f"{WITH_PAGES} SELECT {PAGE_SQL.format(digits=6)}, {META_SQL.format(page_id='id')} AS meta FROM pages0 WHERE {CONVERT}")
def page_convert(spark, sf):
    """PRD04-08, PRJ08, WIN01: filtered pages as samples with dense ids."""
    return _shown(S.page_samples(_arcs(P.convertible(pages(spark, sf))), "pages")).drop("images")


@query(f"{WITH_PAGES} SELECT {PAGE_SQL.format(digits=4)}, {META_SQL.format(page_id='CAST(NULL AS VARCHAR)')} AS meta FROM (SELECT * FROM pages0 WHERE contains(pdf_relpath, 'src1') ORDER BY ord LIMIT 30)")
def prj09_lim05_probe_samples(spark, sf):
    d = pages(spark, sf).where(F.col("pdf_relpath").contains("src1")).orderBy("ord").limit(30)
    return _shown(S.page_samples(_arcs(d), "pages", digits=4, probe=True)).drop("images")


@query(f"{WITH_PAGES} SELECT count(*) AS n, min(length(natural_text)) AS lo, CAST(trunc(median(length(natural_text))) AS BIGINT) AS med, max(length(natural_text)) AS hi, CAST(count_if(is_table) AS BIGINT) AS has_table, CAST(count_if(is_diagram) AS BIGINT) AS has_diagram FROM pages0 WHERE {CONVERT.replace('AND is_diagram IS DISTINCT FROM true', '')}")
def agg01_02_page_stats(spark, sf):
    d = pages(spark, sf).where("primary_language = 'en'").where(P.not_false(F.col("is_rotation_valid")))
    n = F.length(X.strip(F.col("natural_text")))
    d = d.where((n >= 200) & (n <= 5000)).withColumn("n", F.length("natural_text"))
    return d.agg(F.count("*").alias("n"), F.min("n").alias("lo"), F.expr("CAST(percentile(n, 0.5) AS BIGINT)").alias("med"), F.max("n").alias("hi"), F.count_if("is_table").alias("has_table"), F.count_if("is_diagram").alias("has_diagram"))


@query(f"{WITH_PAGES} SELECT min(img_w) AS w_lo, max(img_w) AS w_hi, min(img_h) AS h_lo, max(img_h) AS h_hi FROM pages0")
def agg03_image_ranges(spark, sf):
    return pages(spark, sf).agg(F.min("img_w").alias("w_lo"), F.max("img_w").alias("w_hi"), F.min("img_h").alias("h_lo"), F.max("img_h").alias("h_hi"))


@query(f"{WITH_PAGES} SELECT chunk, page_number AS arc, max(ord) AS ord, arg_max(id, ord) AS id FROM pages0 GROUP BY ALL")
def agg04_set05_last_row_wins(spark, sf):
    d = pages(spark, sf).select("chunk", F.col("page_number").alias("arc"), "ord", "id")
    return P.last_wins(d.withColumn("k", F.col("ord")), ["chunk", "arc"], "k").drop("k")


@query(f"{WITH_PAGES} SELECT chunk, min(ord) AS first_seen, count(DISTINCT page_number) AS arcs FROM pages0 GROUP BY chunk")
def agg04_chunk_order(spark, sf):
    return pages(spark, sf).groupBy("chunk").agg(F.min("ord").alias("first_seen"), F.countDistinct("page_number").alias("arcs"))


@query(f"{WITH_PAGES} SELECT count(DISTINCT (chunk, page_number)) AS candidates, count(DISTINCT chunk) AS chunks FROM pages0")
def agg06_candidate_totals(spark, sf):
    d = pages(spark, sf).groupBy("chunk").agg(F.countDistinct("page_number").alias("n"))
    return d.agg(F.sum("n").alias("candidates"), F.count("*").alias("chunks"))


@query(
    f"""{WITH_PAGES} SELECT ord, regexp_extract(pdf_relpath, 'pdf_tarballs/([^:]+)\\.tar\\.gz:(.+)$', 1) AS chunk_of,
    regexp_replace(regexp_extract(pdf_relpath, 'pdf_tarballs/([^:]+)\\.tar\\.gz:(.+)$', 2), '^\\./', '') AS member FROM pages0"""
)
def prd09_sca02_sca03_locator(spark, sf):
    return P.located(pages(spark, sf)).select("ord", "chunk_of", F.regexp_replace("member", r"^\./", "").alias("member"))


@query(f"{WITH_PAGES} SELECT id, chunk FROM pages0 WHERE chunk IN ('src1', 'src3')")
def prd10_chunk_allow_list(spark, sf):
    return pages(spark, sf).where(F.col("chunk").isin("src1", "src3")).select("id", "chunk")


@query(f"{WITH_PAGES} SELECT id, CASE WHEN contains(pdf_relpath, ':') THEN substr(pdf_relpath, strpos(pdf_relpath, ':') + 1) ELSE pdf_relpath END AS arc FROM pages0 WHERE contains(pdf_relpath, 'src1')")
def prd11_chunk_by_substring(spark, sf):
    p = F.col("pdf_relpath")
    return pages(spark, sf).where(p.contains("src1")).select("id", F.when(p.contains(":"), F.substring(p, F.locate(":", p) + 1, F.length(p))).otherwise(p).alias("arc"))


@query(f"{WITH_PAGES} SELECT ord, is_rotation_valid IS DISTINCT FROM false AS keep_rotation, is_diagram IS DISTINCT FROM true AS keep_diagram FROM pages0")
def prd07_prd08_flags_keep_null(spark, sf):
    return pages(spark, sf).select("ord", P.not_false(F.col("is_rotation_valid")).alias("keep_rotation"), P.not_true(F.col("is_diagram")).alias("keep_diagram"))


@query(f"{WITH_PAGES} SELECT ord FROM pages0 WHERE nullif(primary_language, 'fr') = 'en'")
def prd06_language_equality(spark, sf):
    return pages(spark, sf).where(F.nullif(F.col("primary_language"), F.lit("fr")) == "en").select("ord")


@query(f"SELECT doc_id FROM documents WHERE {STRIP.format('CASE WHEN doc_id % 3 = 0 THEN chr(160) || chr(8195) WHEN doc_id % 3 = 1 THEN text END')} <> ''")
def prd04_non_empty_text(spark, sf):
    t = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(chr(160), decode(unhex('E28083'), 'UTF-8')) WHEN doc_id % 3 = 1 THEN text END")
    return read(spark, sf, "documents").where(X.strip(t) != "").select("doc_id")


@query(f"{WITH_PAGES} SELECT ord, length({TRIMMED}) AS n FROM pages0 WHERE length({TRIMMED}) >= 300 AND length({TRIMMED}) <= 900")
def prd05_char_bounds(spark, sf):
    return pages(spark, sf).select("ord", F.length(X.strip(F.col("natural_text"))).alias("n")).where("n >= 300 AND n <= 900")


WRAP_SPACES = r"chr(160) || ' ' || chr(8195) || text || chr(10) || chr(12288) || chr(9)"


@query(f"SELECT doc_id, length({STRIP.format(WRAP_SPACES)}) AS n, {STRIP.format(WRAP_SPACES)} AS stripped FROM documents")
def sca01_unicode_strip(spark, sf):
    t = F.concat(F.lit("   "), "text", F.lit("\n　\t"))
    return read(spark, sf, "documents").select("doc_id", F.length(X.strip(t)).alias("n"), X.strip(t).alias("stripped"))


@query("SELECT doc_id, trim(regexp_replace(' ' || chr(9) || text, '[\\s]+', ' ', 'g')) AS t FROM documents")
def sca05_whitespace_collapse(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.collapse(F.concat(F.lit(" \t"), "text")).alias("t"))


DIRTY = "'![a](b.png)' || chr(10) || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ![x](y)'"
CLEAN = f"{STRIP.format(f'''regexp_replace(regexp_replace(regexp_replace({DIRTY}, '!\\[[^\\]]*\\][(][^)]*[)]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')''')} || chr(10)"


@query(f"SELECT doc_id, {CLEAN} AS target FROM documents WHERE length({CLEAN}) BETWEEN 300 AND 12000")
def sca07_prd12_clean_target_window(spark, sf):
    t = F.concat(F.lit("![a](b.png)\n"), "text", F.lit("  \n\n\n\nend ![x](y)"))
    return read(spark, sf, "documents").select("doc_id", X.clean_target(t).alias("target")).where(F.length("target").between(300, 12000))


@query("SELECT doc_id FROM documents WHERE NOT length(text) > 2500")
def prd13_max_target(spark, sf):
    return read(spark, sf, "documents").where(~(F.length("text") > 2500)).select("doc_id")


RESIDUE_SQL = r"""\[@|[{]#|[{][.][a-zA-Z]|[{][a-zA-Z][-\w]*="|:::|<span|<div|<figure|\[\\\[|\]\(#"""
RES = "'[@k] {#a} ' || CASE WHEN doc_id % 2 = 0 THEN '::: <span> [\\[ ](#x {k=\"v\"' ELSE '' END || text"


@query(f"SELECT doc_id, round(len(regexp_extract_all({RES}, '{RESIDUE_SQL}')) / greatest(length({RES}) / 1000.0, 1), 6) AS density FROM documents WHERE len(regexp_extract_all({RES}, '{RESIDUE_SQL}')) / greatest(length({RES}) / 1000.0, 1) <= 5")
def prd14_sca12_residue_gate(spark, sf):
    t = F.concat(F.lit("[@k] {#a} "), F.when(F.col("doc_id") % 2 == 0, '::: <span> [\\[ ](#x {k="v"').otherwise(""), F.col("text"))
    return read(spark, sf, "documents").select("doc_id", X.residue_density(t).alias("d")).where("d <= 5").select("doc_id", F.round("d", 6).alias("density"))


MARKUP = {
    "figcaption": "a<figcaption> \xa0cap\n\u2003</figcaption>b<figcaption>\u3000\n</figcaption>", "figure": '<figure class="x">a</figure>', "image": "a![ \u2002cap ](i.png){width=1}b![\xa0](j.png)", "img": '<img src="a">',
    "embed": '<embed src="a"/>', "equation_ref": '[\\[eq\\]](#e){r="x"}', "anchor_link": "[See](#s){r=1} me", "citation": "x [@k; @l] y", "fence": "::: note\nx\n:::\r::: y\u2028::: z\n", "id_attr": "h {#id .c}", "class_attr": "h {.c}",
    "key_attr": "a{width=3}b", "tags": "<em>a</em><param x><br/>", "empty_parens": "f( ; )g()(\u3000,\xa0)", "empty_brackets": "[ ]a[\u2009\x1f]", "space_before_sign": "a  , b ;c\xa0.", "space_after_paren": "(  a(\u2003\x85b",
    "blanks": "a   b", "blank_lines": "a\n\n\n\nb",
}
#: The same rules for DuckDB, written on their own: pattern and replacement pairs.
BLANK, INLINE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]", r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}]"
BRACED, IN_PARENS, IN_ANCHOR = r"([{][^}]*[}])?", r"[(][^)]*[)]", r"[(]#[^)]*[)]"
SQL_RULES = {
    "figcaption": [(f"<figcaption>{BLANK}*</figcaption>", "\n\n"), (f"(?s)<figcaption>{BLANK}*(.*?){BLANK}*</figcaption>", "\n\n\\1\n\n")],
    "figure": [("<(/figure|figure)[^>]*>", "")],
    "image": [(rf"!\[{INLINE}*\]{IN_PARENS}{BRACED}", "\n\n"), (rf"!\[{INLINE}*([^\n]*?){INLINE}*\]{IN_PARENS}{BRACED}", "\n\n\\1\n\n")],
    "img": [("<img[^>]*/?>", "")],
    "embed": [("<embed[^>]*/?>", "")],
    "equation_ref": [(rf"\[\\\[[^\]]*\\\]\]{IN_ANCHOR}{BRACED}", "")],
    "anchor_link": [(rf"\[([^\]]+)\]{IN_ANCHOR}{BRACED}", "\\1")],
    "citation": [(r"\[@([^\]]*)\]", "")],
    "fence": [(r"(?m)^:{3,}.*$", "")],
    "id_attr": [("[{]#[^}]*[}]", "")],
    "class_attr": [("[{][.][^}]*[}]", "")],
    "key_attr": [("[{][^{}]*=[^{}]*[}]", "")],
    "tags": [("</?(span|div|strong|sup|sub|em|br|p)[^>]*>", "")],
    "empty_parens": [(f"[(]{BLANK}*(,|;)?{BLANK}*[)]", "")],
    "empty_brackets": [(rf"\[{BLANK}*\]", "")],
    "space_before_sign": [("[ \t]+([.]|,|;|:|[)])", "\\1")],
    "space_after_paren": [(f"[(]{BLANK}+", "(")],
    "blanks": [("[ \t][ \t]+", " ")],
    "blank_lines": [("\n{3,}", "\n\n")],
}
MATH_RE2 = r"(?s)\$\$.{0,1000}?.{0,998}?\$\$|\$[^$\n]+\$"


def _replaced_sql(t: str, name: str) -> str:
    for pattern, new in SQL_RULES[name]:
        t = f"regexp_replace({t}, {_literal(pattern)}, {_literal(new)}, 'g')"
    return t


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(i: int, name: str) -> None:
    sample = MARKUP[name]

    def rule(spark, sf):
        t = F.concat(F.lit(sample), "text", F.lit(sample))
        return read(spark, sf, "documents").select("doc_id", X.apply_rule(t, name).alias("t"))

    rule.__name__ = f"cln{i:02d}_{name}"
    query(f"SELECT doc_id, {_replaced_sql(f'{_literal(sample)} || text || {_literal(sample)}', name)} AS t FROM documents")(rule)


for _i, (_name, _, _) in enumerate(X.RULES, 2):
    _rule(_i, _name)

WRAPPED = " " + " ".join(MARKUP.values()) + " $[@k]$ and $$<em>x</em>$$ [@a $y$ ] "


def _scrub_sql(table: str, c: str) -> str:
    """The recipe in SQL: marks by position, rules, then the formulas put back by their numbers."""
    t = "masked"
    for name in SQL_RULES:
        t = _replaced_sql(t, name)
    return f"""WITH s AS (SELECT doc_id, replace({c}, chr(160), ' ') AS t FROM {table}),
    a AS (SELECT doc_id, regexp_extract_all(t, '{MATH_RE2}') AS store, regexp_split_to_array(t, '{MATH_RE2}') AS parts FROM s),
    m AS (SELECT doc_id, store, array_to_string([CASE WHEN i < len(parts) THEN parts[i] || chr(1) || 'M' || (i - 1) || chr(1) ELSE parts[i] END FOR i IN range(1, len(parts) + 1)], '') AS masked FROM a),
    r AS (SELECT doc_id, store, {STRIP.format(t)} AS done FROM m),
    n AS (SELECT doc_id, store, regexp_split_to_array(done, chr(1) || 'M[0-9]+' || chr(1)) AS parts, regexp_extract_all(done, chr(1) || 'M([0-9]+)' || chr(1), 1) AS nums FROM r)
    SELECT doc_id, array_to_string([CASE WHEN i < len(parts) THEN parts[i] || store[CAST(nums[i] AS INT) + 1] ELSE parts[i] END FOR i IN range(1, len(parts) + 1)], '') AS t FROM n"""


WRAPPED_SQL = _literal(WRAPPED)


@query(_scrub_sql("documents", f"{WRAPPED_SQL} || text || {WRAPPED_SQL}"))
def cln01_cln21_sca08_10_scrub_full(spark, sf):
    t = F.concat(F.lit(WRAPPED), "text", F.lit(WRAPPED))
    return read(spark, sf, "documents").select("doc_id", X.scrub(t).alias("t"))


@query(f"SELECT page_id, regexp_replace(html, '{SQL_RULES['tags'][0][0]}', '', 'g') AS t FROM pages")
def cln14_html_tags(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.apply_rule(F.col("html"), "tags").alias("t"))


@query("SELECT doc_id, len(regexp_extract_all('$$a$$ ' || text || ' $b$', '" + MATH_RE2 + "')) AS n, regexp_replace('$$a$$ ' || text || ' $b$', '" + MATH_RE2 + "', '@', 'g') AS t FROM documents")
def sca08_math_protect(spark, sf):
    t = F.concat(F.lit("$$a$$ "), "text", F.lit(" $b$"))
    return read(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(X.MATH), F.lit(0))).alias("n"), F.regexp_replace(t, X.MATH, "@").alias("t"))


FRONT = "CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) ELSE '---' END || text"


@query(
    f"""WITH s AS (SELECT doc_id, {FRONT} AS t FROM documents), e AS (SELECT doc_id, t, strpos(substr(t, 5), chr(10) || '---' || chr(10)) AS p FROM s)
    SELECT doc_id, CASE WHEN starts_with(t, '---' || chr(10)) AND p > 0 THEN substr(t, 5, p - 1) ELSE '' END AS yaml,
    CASE WHEN starts_with(t, '---' || chr(10)) AND p > 0 THEN substr(t, p + 9) ELSE t END AS body FROM e"""
)
def src15_front_matter(spark, sf):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: T"), "doc_id", F.lit("\n---\n"))).otherwise("---"), F.col("text"))
    d = read(spark, sf, "documents").select("doc_id", t.alias("t"))
    yaml, body = X.front_matter(F.col("t"))
    return d.select("doc_id", yaml.alias("yaml"), body.alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '# T' || doc_id || chr(10) || chr(10) ELSE '' END || CASE WHEN doc_id % 2 > 0 THEN lang || chr(10) || chr(10) ELSE '' END || text AS t FROM documents")
def prj13_title_header(spark, sf):
    title = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T"), "doc_id"))
    return read(spark, sf, "documents").select("doc_id", X.titled(title, F.when(F.col("doc_id") % 2 > 0, F.col("lang")), F.col("text")).alias("t"))


@query("SELECT doc_id, replace(left(text, 120), chr(10), ' ') AS head, replace(right(text, 160), chr(10), ' ') AS tail, length(text) AS n FROM documents")
def sca15_eva03_preview(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("head"), F.translate(F.right("text", F.lit(160)), "\n", " ").alias("tail"), F.length("text").alias("n"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(' a, ,' || lang || ',,b ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM documents")
def sca16_csv_items(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(X.csv_items(F.concat(F.lit(" a, ,"), "lang", F.lit(",,b "))), "|").alias("items"))


@query("SELECT doc_id, replace(chr(160) || text || chr(160), chr(160), ' ') AS t FROM documents")
def sca17_nbsp(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.translate(F.concat(F.lit(" "), "text", F.lit(" ")), " ", " ").alias("t"))


@query("SELECT page_id, regexp_replace(split_part('http://x/abs/' || page_id || 'v' || (page_id % 9), '/abs/', -1), 'v\\d+$', '') AS base FROM pages")
def sca04_version_strip(spark, sf):
    u = F.concat(F.lit("http://x/abs/"), "page_id", F.lit("v"), F.col("page_id") % 9)
    return read(spark, sf, "pages").select("page_id", F.regexp_replace(F.substring_index(u, "/abs/", -1), r"v\d+$", "").alias("base"))


@query("SELECT doc_id, array_to_string(list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN source END, ''], lambda x: x <> ''), ', ') AS authors FROM documents")
def sca06_join_authors(spark, sf):
    a = F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(""))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.filter(a, lambda x: x != ""), ", ").alias("authors"))


@query("SELECT doc_id, replace(source || '/' || doc_id, '/', '_') AS safe, 'images/' || replace(source || '/' || doc_id, '/', '_') || '_p' || lpad(CAST(doc_id % 40 AS VARCHAR), 3, '0') || '.png' AS image FROM documents")
def prj14_safe_path(spark, sf):
    safe = F.replace(F.concat("source", F.lit("/"), "doc_id"), F.lit("/"), F.lit("_"))
    return read(spark, sf, "documents").select("doc_id", safe.alias("safe"), F.concat(F.lit("images/"), safe, F.lit("_p"), F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0"), F.lit(".png")).alias("image"))


@query("SELECT doc_id, p AS page, 'd' || doc_id || '_p' || lpad(CAST(p AS VARCHAR), 3, '0') AS image FROM (SELECT doc_id, unnest(range(0, doc_id % 4)) AS p FROM documents)")
def src18_win02_page_explode(spark, sf):
    d = read(spark, sf, "documents").where("doc_id % 4 > 0").select("doc_id", F.posexplode(F.sequence(F.lit(0), F.col("doc_id") % 4 - 1)).alias("page", "x"))
    return d.select("doc_id", "page", F.concat(F.lit("d"), "doc_id", F.lit("_p"), F.lpad(F.col("page").cast("string"), 3, "0")).alias("image"))


SAMPLES = """samples0 AS (
  SELECT doc_id AS ln, CASE WHEN doc_id % 5 > 0 THEN 's' || doc_id END AS id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'multi_base' WHEN 2 THEN 'odd' ELSE 'single_base' END AS mode,
  CASE WHEN doc_id % 4 = 0 THEN '/abs/' || doc_id WHEN doc_id % 4 = 1 THEN 'rel/' || doc_id WHEN doc_id % 4 = 2 THEN '' END AS image,
  CASE WHEN doc_id % 6 = 0 THEN ['a.png', '/b.png'] WHEN doc_id % 6 = 1 THEN ['a.png'] WHEN doc_id % 6 = 2 THEN CAST([] AS VARCHAR[]) END AS images,
  CASE WHEN doc_id % 3 = 0 THEN '<image>p' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN '<image><image>' END AS prompt,
  CASE WHEN doc_id % 11 = 0 THEN chr(160) WHEN doc_id % 11 > 1 THEN text END AS target FROM documents)"""


def samples(spark, sf):
    c = """doc_id AS ln, CASE WHEN doc_id % 5 > 0 THEN 's' || doc_id END AS id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'multi_base' WHEN 2 THEN 'odd' ELSE 'single_base' END AS mode,
    CASE WHEN doc_id % 4 = 0 THEN '/abs/' || doc_id WHEN doc_id % 4 = 1 THEN 'rel/' || doc_id WHEN doc_id % 4 = 2 THEN '' END AS image,
    CASE WHEN doc_id % 6 = 0 THEN array('a.png', '/b.png') WHEN doc_id % 6 = 1 THEN array('a.png') WHEN doc_id % 6 = 2 THEN CAST(array() AS array<string>) END AS images,
    CASE WHEN doc_id % 3 = 0 THEN '<image>p' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN '<image><image>' END AS prompt,
    CASE WHEN doc_id % 11 = 0 THEN chr(160) WHEN doc_id % 11 > 1 THEN text END AS target"""
    return read(spark, sf, "documents").selectExpr(*_split_columns(c))


def _split_columns(c: str) -> list[str]:
    out, depth, part = [], 0, ""
    for x in c:
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += x
    return [*out, part]


NORMAL = f"""WITH {SAMPLES}, u AS (
  SELECT *, coalesce(mode, 'single_gundam') AS m, CASE WHEN len(images) > 0 THEN images WHEN coalesce(image, '') <> '' THEN [image] END AS im FROM samples0),
v AS (SELECT *, coalesce(prompt, CASE WHEN starts_with(m, 'multi') THEN '<image>Read these pages.' ELSE '<image>Read this page.' END) AS p FROM u),
e AS (SELECT *, len(string_split(p, '<image>')) - 1 AS np FROM v)
SELECT coalesce(id, 'row_' || ln) AS id, m AS mode, array_to_string(list_transform(im, lambda x: CASE WHEN starts_with(x, '/') THEN x ELSE '/root/' || x END), '|') AS images, p AS prompt, target,
CASE WHEN m NOT IN ('single_gundam', 'single_base', 'multi_base') THEN 'mode' WHEN im IS NULL THEN 'images' WHEN starts_with(m, 'single') AND len(im) <> 1 THEN 'single'
     WHEN coalesce({STRIP.format('target')}, '') = '' THEN 'target' WHEN NOT CASE WHEN starts_with(m, 'multi') THEN np = 1 ELSE np = len(im) END THEN 'placeholder' END AS error FROM e"""


@query(NORMAL)
def prj01_06_prd01_03_prd20_normalise(spark, sf):
    d = S.normalised(samples(spark, sf), "/root")
    return d.withColumn("images", F.array_join("images", "|"))


@query(f"SELECT error, count(*) AS n FROM ({NORMAL}) GROUP BY error")
def agg09_validation_errors(spark, sf):
    return S.normalised(samples(spark, sf), "/root").groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT 'd' || doc_id AS id, 'multi_base' AS mode, 2::BIGINT AS n FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]')")
def prd22_valid_samples(spark, sf):
    """All rows keep the rules here, so the check passes every one of them."""
    d = read(spark, sf, "documents").where(X.strip(F.col("text")) != "")
    d = d.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("multi_base").alias("mode"), F.lit(None).cast("string").alias("image"), F.array(F.lit("a.png"), F.lit("/b.png")).alias("images"),
        F.lit("<image>x").alias("prompt"), F.col("text").alias("target"), F.col("doc_id").alias("ln"),
    )
    return S.checked(S.normalised(d, "/root")).select("id", "mode", F.size("images").alias("n"))


LINES = """CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"mode":null,' ELSE '"mode":"multi_base",' END || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"prompt":null,' ELSE '"prompt":"<image>p",' END
    || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '"id":null,' ELSE '"id":"i' || doc_id || '",' END || CASE WHEN doc_id % 2 = 0 THEN '"meta":{"n_pages":' || doc_id || '},' ELSE '' END"""


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ln, CASE doc_id % 3 WHEN 0 THEN 'single_gundam' WHEN 2 THEN 'multi_base' END AS mode FROM documents),
    p AS (SELECT *, CASE WHEN doc_id % 4 > 1 THEN '<image>p' WHEN doc_id % 4 = 0 THEN CASE WHEN mode = 'multi_base' THEN '<image>Read these pages.' ELSE '<image>Read this page.' END END AS prompt FROM r)
    SELECT CASE doc_id % 5 WHEN 0 THEN 'row_' || ln WHEN 1 THEN NULL ELSE 'i' || doc_id END AS id, mode, prompt, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS n_pages,
    CASE WHEN mode IS NULL THEN 'mode' WHEN prompt IS NULL THEN 'placeholder' END AS error FROM p"""
)
def sca43_absent_or_null(spark, sf):
    """Keys that a line leaves out get defaults; keys that it sets to null stay null."""
    from quire.sources.readers import read_samples
    from quire.sources.writers import scratch, write_texts

    path = scratch(spark, "lines")
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("{"), F.expr(LINES), F.lit('"image":"a.png","target":"t"}')).alias("v"))
    write_texts(d.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id"), "v", path)
    return S.normalised(read_samples(spark, path), "/root").select("id", "mode", "prompt", "meta.n_pages", "error")


GROUPS = """g AS (SELECT source, doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS grp FROM documents),
h AS (SELECT source, grp, count(*) AS n, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members, string_agg(text, chr(10) || '<PAGE>' || chr(10) ORDER BY doc_id) AS joined FROM g GROUP BY ALL HAVING count(*) = 3)"""


@query(f"WITH {GROUPS} SELECT source, CAST(grp AS BIGINT) AS grp, n, first, members, joined FROM h")
def agg05_win04_prj10_multipage(spark, sf):
    d = P.fixed_groups(read(spark, sf, "documents"), "doc_id", 3, "text", PAGE_BREAK, ["source"])
    return d.select("source", F.col("group").alias("grp"), "n", "first", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "joined")


@query(
    f"""WITH {GROUPS.replace("count(*) AS n,", "count(*) AS n, list('d' || doc_id ORDER BY doc_id) AS ids,")} SELECT 'multi_' || source || '_' || lpad(CAST(grp AS VARCHAR), 6, '0') AS id, source, array_to_string(list_transform(ids, lambda x: 'images/' || x || '.png'), '|') AS images,
    'multi_base' AS mode, '<image>Read these pages.' AS prompt, joined AS target, 'natural_text_or_html' AS target_format, 'multi_page_parse' AS task,
    CAST(to_json({{'chunk': NULL, 'arcname': NULL, 'page_id': NULL, 'img_w': NULL, 'img_h': NULL, 'char_len': NULL, 'language': NULL, 'is_table': NULL, 'is_diagram': NULL, 'license': NULL, 'n_pages': 3, 'page_ids': ids, 'arxiv_id': NULL}}) AS VARCHAR) AS meta FROM h"""
)
def prj10_multipage_samples(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), "source", F.concat(F.lit("images/d"), "doc_id", F.lit(".png")).alias("image"), F.col("text").alias("target"))
    return _shown(S.multipage_samples(d, 3, "doc_id", ["source"])).withColumn("images", F.array_join("images", "|")).drop("image")


@query(f"WITH {GROUPS} SELECT source, CAST(grp AS BIGINT) AS grp, CAST(unnest(range(0, 3)) AS BIGINT) AS page, trim(unnest(string_split(joined, '<PAGE>')), chr(10)) AS body FROM h")
def doc05_page_split(spark, sf):
    d = P.fixed_groups(read(spark, sf, "documents"), "doc_id", 3, "text", PAGE_BREAK, ["source"])
    d = d.select("source", F.col("group").alias("grp"), F.posexplode(F.split("joined", PAGE_TOKEN)).alias("page", "body"))
    return d.select("source", "grp", F.col("page").cast("long").alias("page"), F.trim("body", F.lit("\n")).alias("body"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS target, 'multi_base' AS mode, '<image>Merge these pages.' AS prompt, 'multi_page_merge' AS task, count(*) AS n_pages, CAST(conv_id AS VARCHAR) AS arxiv_id
    FROM conversations GROUP BY conv_id"""
)
def prj11_merge_samples(spark, sf):
    d = read(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    d = S.merge_samples(d.withColumn("t", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n")), "key", "n", "t")
    return d.select("id", "target", "mode", "prompt", "task", "meta.n_pages", "meta.arxiv_id")


@query("SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS target FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def sca42_conversation_pairs(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    d = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lead(F.struct("turn", "role", "text")).over(w).alias("next"))
    return d.where("role = 'user' AND next.role = 'assistant' AND next.turn = turn + 1").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("next.text").alias("target"))


@query(f"{WITH_PAGES} SELECT ord, chunk FROM (SELECT *, min(ord) OVER (PARTITION BY chunk) AS c FROM pages0) ORDER BY c, ord LIMIT 100")
def lim01_chunk_order_limit(spark, sf):
    d = pages(spark, sf)
    c = d.groupBy("chunk").agg(F.min("ord").alias("c"))
    return d.join(c, "chunk").orderBy("c", "ord").limit(100).select("ord", "chunk")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 500 AND 3000 ORDER BY doc_id LIMIT 50")
def lim02_first_n_accepted(spark, sf):
    return read(spark, sf, "documents").where(F.length("text").between(500, 3000)).orderBy("doc_id").limit(50).select("doc_id")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 30")
def lim04_lim05_first_n(spark, sf):
    return read(spark, sf, "benchmark").orderBy("item_id").limit(30)


@query("SELECT doc_id, chr(65279) || lang || '_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id FROM documents")
def prj05_padded_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("﻿"), "lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"))
