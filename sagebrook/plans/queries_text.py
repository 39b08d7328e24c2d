"""Queries on documents, pages, vectors and conversations: rules, links, sections, chunks, retrieval, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import coverage as V
from ..operators import docs as D
from ..operators import filters as P
from ..operators import match as M
from ..operators import retrieve as R
from ..operators import web as W
from ..operators.common import share_of_total, small, top_per_key, work_path
from .queries_core import HOST_SQL
from .registry import query, table

# The texts are invented words, so the rules take lists that occur in them.
URL_WORDS, STRONG_WORDS = ("page=", "ref=", "utm_", "/de/", "/es/"), ("utm_",)
TEXT_WORDS, STRONG_TEXT = ("|", "***", "$$$", "!!"), ("***",)


def sql_first(text: str, words) -> str:
    """The first of the words that the text holds, in SQL."""
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"""SELECT page_id, coalesce('除外ドメイン: ' || {sql_first(HOST_SQL, ('example.org',))},
 CASE WHEN html NOT LIKE '%<h2%' THEN '非募集要項URLパターン（covered_units無し）: ' || {sql_first('lower(url)', URL_WORDS)} ELSE '合格発表・成績URL（covered_unitsあり）: ' || {sql_first('lower(url)', STRONG_WORDS)} END,
 CASE WHEN html NOT LIKE '%<h2%' THEN '非募集要項キーワード（covered_units無し）: ' || {sql_first("html || ' ' || url", TEXT_WORDS)} ELSE '明らかに無関係なコンテンツ: ' || {sql_first("html || ' ' || url", STRONG_TEXT)} END) AS reason FROM pages""")
def rule_cascade_reasons(spark, d):
    reason = P.exclusion_reason(F.col("url"), F.col("html"), F.contains("html", F.lit("<h2")), hosts=("example.org",), url_patterns=URL_WORDS, strong_url=STRONG_WORDS, content=TEXT_WORDS, strong_content=STRONG_TEXT)
    return table(spark, d, "pages").select("page_id", reason.alias("reason"))


@query(f"""SELECT coalesce({sql_first('lower(url)', URL_WORDS)}, 'kept') AS reason, count(*) AS n FROM pages GROUP BY 1""")
def reason_breakdown(spark, d):
    return table(spark, d, "pages").groupBy(F.coalesce(P.excluded_keyword(F.col("url"), URL_WORDS), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN {sql_any('lower(url)', ('utm_', 'ref='))} THEN 'exclude' WHEN {sql_any('lower(url)', ('/en/', '/fr/'))} THEN 'keep_keyword' WHEN contains(lower(url), '#top') THEN 'keep_document' ELSE 'undecided' END AS verdict, count(*) AS n FROM pages GROUP BY 1""")
def verdict_routing(spark, d):
    verdict = P.routed(F.col("url"), ("utm_", "ref="), ("/en/", "/fr/"), "#top")
    return table(spark, d, "pages").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT page_id FROM (SELECT page_id, contains(lower(url), '/fr/') AS hit, count(*) FILTER (contains(lower(url), '/fr/')) OVER (PARTITION BY split_part({HOST_SQL}, '.', -1)) AS hits FROM pages) WHERE hit OR hits < 10""")
def prefilter_with_fallback(spark, d):
    rows = table(spark, d, "pages").withColumn("site", F.substring_index(C.host(F.col("url")), ".", -1))
    return P.prefiltered(rows, "site", F.col("url"), ("/fr/",)).select("page_id")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND source = 'src3' AND contains(lower(text), 'que')")
def metadata_filter(spark, d):
    return P.metadata_filter(table(spark, d, "documents"), entity=("lang", "fr"), year=("source", "src3"), unit=("text", "QUE"), limit=None).select("doc_id", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (trim(p_type) IN ('PROMO', 'ECONOMY') OR regexp_full_match(p_name, '[0-9,.]+') OR starts_with(p_name, 'a') OR p_name = '')")
def noise_filter(spark, d):
    rows = table(spark, d, "part")
    return rows.where(~(P.noise_name(F.col("p_type"), ("PROMO", "ECONOMY"), ()) | P.noise_name(F.col("p_name"), (), ("a",)))).select("p_partkey", "p_name")


DOC_TYPES = {"table": ("|",), "shout": ("!!",), "signs": ("***", "$$$")}


@query(f"""SELECT CASE WHEN {sql_any('lower(text)', DOC_TYPES['table'])} THEN 'table' WHEN {sql_any('lower(text)', DOC_TYPES['shout'])} THEN 'shout' WHEN {sql_any('lower(text)', DOC_TYPES['signs'])} THEN 'signs'
 WHEN n_chars > 2000 THEN '募集要項' ELSE 'その他' END AS doc_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM documents GROUP BY 1""")
def doc_type_rules(spark, d):
    kind = C.doc_type(F.col("text"), F.col("n_chars") > 2000, DOC_TYPES)
    return share_of_total(table(spark, d, "documents").select(kind.alias("doc_type")), ["doc_type"])


TAGS = {"english": (" the ", " and "), "french": (" le ", " les "), "german": (" der ", " die "), "spanish": (" el ", " los "), "table": ("|",)}
TAGS_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any('text', words)} THEN '{tag}' END" for tag, words in TAGS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {TAGS_SQL} AS tags FROM documents")
def tag_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.tags_of(F.col("text"), TAGS), ",").alias("tags"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split({TAGS_SQL}, ',')) AS tag FROM documents) WHERE tag <> '' GROUP BY 1")
def tag_distribution(spark, d):
    return table(spark, d, "documents").select(F.explode(C.tags_of(F.col("text"), TAGS)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '研究科|大学院|専攻|修士|博士') AND NOT regexp_matches(t, '学部|学科|学群|学類') THEN 'graduate'
 WHEN regexp_matches(t, '学部|学科|学群|学類') AND NOT regexp_matches(t, '研究科|大学院|専攻|修士|博士') THEN 'undergraduate' ELSE 'combined' END AS scope
 FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN '学部' WHEN doc_id % 4 = 1 THEN '大学院' WHEN doc_id % 4 = 2 THEN '学科・修士' ELSE '' END AS t FROM documents)""")
def scope_detection(spark, d):
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "学部").when(k == 1, "大学院").when(k == 2, "学科・修士").otherwise("")
    return table(spark, d, "documents").select("doc_id", C.scope_of_text(F.concat("text", mark)).alias("scope"))


RAW_YEAR_SQL = """CASE o_orderkey % 6 WHEN 0 THEN (year(o_orderdate) + 27) || '年度' WHEN 1 THEN 'R' || (year(o_orderdate) - 1990) WHEN 2 THEN '令和' || (year(o_orderdate) - 1990)
 WHEN 3 THEN '平成' || (year(o_orderdate) - 1985) || '年度' WHEN 4 THEN (year(o_orderdate) + 27) || '年10月入学' ELSE '令和' || (year(o_orderdate) - 1990) || '年度（x）' END"""
ERA_SQL = "CASE WHEN y - 2018 = 1 THEN '令和元年度' WHEN y - 2018 BETWEEN 2 AND 12 THEN '令和' || (y - 2018) || '年度' ELSE raw END"
NORMAL_YEAR_SQL = f"""SELECT o_orderkey, raw, CASE WHEN k IN (0, 4) THEN {ERA_SQL} WHEN k = 1 THEN '令和' || e || '年度' WHEN k = 2 THEN raw || '年度' WHEN k = 3 THEN raw ELSE '令和' || e || '年度' END AS year
 FROM (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) + 27 AS y, year(o_orderdate) - 1990 AS e, {RAW_YEAR_SQL} AS raw FROM orders)"""


def raw_years(spark: SparkSession, d: str) -> DataFrame:
    year, k = F.year("o_orderdate"), F.col("o_orderkey") % 6
    text = lambda n: n.cast("string")
    raw = (
        F.when(k == 0, F.concat(text(year + 27), F.lit("年度"))).when(k == 1, F.concat(F.lit("R"), text(year - 1990))).when(k == 2, F.concat(F.lit("令和"), text(year - 1990)))
        .when(k == 3, F.concat(F.lit("平成"), text(year - 1985), F.lit("年度"))).when(k == 4, F.concat(text(year + 27), F.lit("年10月入学")))
        .otherwise(F.concat(F.lit("令和"), text(year - 1990), F.lit("年度（x）")))
    )
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", raw.alias("raw"))


@query(NORMAL_YEAR_SQL)
def year_normalised(spark, d):
    return raw_years(spark, d).select("o_orderkey", "raw", C.normal_year(F.col("raw")).alias("year"))


@query(f"SELECT year, count(*) AS n, count(*) FILTER (starts_with(year, '平成') OR year = '令和元年度' OR try_cast(regexp_extract(year, '^令和([0-9]+)年度', 1) AS INT) <= 6) AS outdated FROM ({NORMAL_YEAR_SQL}) GROUP BY 1")
def year_distribution(spark, d):
    years = raw_years(spark, d).select(C.normal_year(F.col("raw")).alias("year"))
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.outdated_year(F.col("year"))).alias("outdated"))


@query(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN year = stored THEN 'correct' ELSE 'update' END AS action FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN year ELSE '令和7年度' END AS stored FROM ({NORMAL_YEAR_SQL}))) GROUP BY 1""")
def year_repair_preview(spark, d):
    rows = raw_years(spark, d)
    stored = F.when(F.col("o_orderkey") % 2 == 0, C.normal_year(F.col("raw"))).otherwise("令和7年度")
    return V.year_repair(rows.withColumn("stored", stored), "stored", "raw").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_recovery(spark, d):
    wrapped = F.concat(F.lit("<think>{ not this }</think>\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(C.recovered_json(wrapped), "$.k").alias("k"))


@query("""SELECT event_type, reason, count(*) AS n FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN 'parse error' WHEN 2 THEN 'empty list' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY ALL""")
def empty_extractions(spark, d):
    k = F.col("event_id") % 4
    doc = F.when(k == 1, F.concat(F.lit("{"), "props")).when(k == 2, F.lit('{"covered_units": []}')).when(k == 3, F.lit('{"covered_units": [{"unit_name": "a"}]}'))
    return V.empty_extractions(table(spark, d, "events").withColumn("doc", doc), "doc", ["event_type"])


LINKS_SQL = r"""links AS (SELECT page_id, pos, text AS link_text, url AS link_url FROM (SELECT page_id, pos, text, url, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS k FROM
 (SELECT page_id, pos, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text,
  CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || href ELSE NULL END AS url FROM
  (SELECT page_id, url, unnest(ts) AS t, regexp_replace(replace(trim(unnest(hs)), '&amp;', '&'), '#.*$', '') AS href, unnest(range(len(hs)))::INT AS pos FROM
   (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a\s*>', 1) AS hs, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a\s*>', 2) AS ts FROM pages)))
 WHERE regexp_matches(url, '^https?://')) WHERE k = 1)"""


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, link_text, link_url FROM links")
def page_links(spark, d):
    return W.page_links(table(spark, d, "pages")).select("page_id", "pos", "link_text", "link_url")


@query(f"WITH {LINKS_SQL} SELECT page_id, link_url FROM links WHERE ends_with(lower(regexp_replace(link_url, '\\?.*$', '')), 's') AND NOT contains(link_text, 'ing') AND (contains(link_text, 'e') OR contains(lower(link_url), 'th'))")
def doc_links(spark, d):
    links = W.page_links(table(spark, d, "pages"))
    relevant = P.relevant_link(F.col("link_text"), F.col("link_url"), ("ing",), ("e",), ("th",))
    return W.document_links(links, P.document_url(F.col("link_url"), "path", "s"), relevant).select("page_id", "link_url")


@query(f"""WITH {LINKS_SQL}, s AS (SELECT *, (CASE WHEN ends_with(lower(link_url), 'e') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(link_text || ' ' || link_url), 'th') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(link_text || ' ' || link_url), 'an') THEN 3 ELSE 0 END) AS score FROM links)
 SELECT page_id, link_url, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS k FROM s WHERE score > 0) WHERE k = 1""")
def best_link(spark, d):
    return W.best_link(W.page_links(table(spark, d, "pages")), "page_id", "e", ("th", "an")).select("page_id", "link_url", "score")


@query(f"WITH {LINKS_SQL} SELECT page_id, link_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM links WHERE contains(lower(link_url), 'th') OR contains(lower(link_text), 'th')) WHERE k <= 10")
def likely_documents(spark, d):
    return W.likely_documents(W.page_links(table(spark, d, "pages")), "page_id", "th").select("page_id", "link_url")


def _page_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pages linked by the words that they link to: page -> word -> next page with that word."""
    links = W.page_links(table(spark, d, "pages"))
    word = F.regexp_extract("link_url", "/([^/?#]*)$", 1)
    return links.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("w"), word).alias("dst"), "pos")


REACH_SQL = f"""WITH RECURSIVE {LINKS_SQL}, e AS (SELECT 'p' || page_id AS src, 'w' || regexp_extract(link_url, '/([^/?#]*)$', 1) AS dst FROM links UNION ALL SELECT 'w' || regexp_extract(link_url, '/([^/?#]*)$', 1), 'p' || page_id FROM links),
 r AS (SELECT 'p' || min(page_id) AS node, 0 AS depth FROM pages GROUP BY {HOST_SQL} UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1"""


@query(REACH_SQL)
def link_reach(spark, d):
    out = _page_edges(spark, d)
    edges = out.select("src", "dst").unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = table(spark, d, "pages").groupBy(C.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
    return W.reachable(edges, first.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node")), 3)


@query(f"SELECT split_part({HOST_SQL}, '.', -1) AS kind, count(*) AS n, count(DISTINCT regexp_extract({HOST_SQL}, '[^.]+[.][^.]+$')) AS domains FROM pages GROUP BY 1")
def url_domains(spark, d):
    rows = table(spark, d, "pages").withColumn("host", C.host(F.col("url")))
    return rows.groupBy(F.substring_index("host", ".", -1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(C.registrable_domain(F.col("host"))).alias("domains"))


@query("SELECT md5(url) AS page_key, count(*) AS n FROM pages GROUP BY 1")
def page_keys(spark, d):
    return table(spark, d, "pages").groupBy(C.page_key(F.col("url")).alias("page_key")).agg(F.count(F.lit(1)).alias("n"))


@query()
def html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", W.html_to_markdown(F.col("html"), F.col("url")).alias("markdown"))


@query()
def page_titles(spark, d):
    text = W.html_to_markdown(F.col("html"), F.col("url"))
    return table(spark, d, "pages").select("page_id", C.title_of_text(F.regexp_replace(text, "(?m)^[#-]+ ", "")).alias("title"))


def _heading(line):
    """Headings of the given texts: short lines that start a sentence and hold no bar."""
    stripped = C.strip(line)
    return (F.length(stripped) <= 60) & (F.length(stripped) > 2) & ~F.contains(stripped, F.lit("|"))


SECTIONS_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
 s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x, length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) BETWEEN 3 AND 60 AND NOT contains(line, '|') AS h, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l),
 r AS (SELECT *, n - sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM s),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, h ORDER BY line_no) AS i, min(n) OVER (PARTITION BY doc_id, run, h) = 1 AS at_start FROM r),
 b AS (SELECT *, h AND (i + at_start::INT) % 2 = 1 AS starts FROM o),
 c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM b)
 SELECT doc_id, section_no, coalesce(max(CASE WHEN starts THEN x END), '冒頭') AS heading, sha256(regexp_replace(string_agg(CASE WHEN NOT starts THEN line END, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM c
 GROUP BY 1, 2 HAVING regexp_replace(coalesce(string_agg(CASE WHEN NOT starts THEN line END, chr(10) ORDER BY line_no), ''), '^\\s+|\\s+$', '', 'g') <> ''"""


@query(SECTIONS_SQL)
def section_split(spark, d):
    out = D.sections(table(spark, d, "documents"), "doc_id", "text", _heading)
    return out.select("doc_id", F.col("section_no"), "heading", C.content_hash(F.col("content")).alias("content_hash"))


@query(f"SELECT count(*) AS sections, count(DISTINCT doc_id) AS documents, count(*) FILTER (heading = '冒頭') AS untitled FROM ({SECTIONS_SQL})")
def section_stats(spark, d):
    out = D.sections(table(spark, d, "documents"), "doc_id", "text", _heading)
    return out.agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("heading") == rules.FIRST_HEADING).alias("untitled"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.document_chunks(table(spark, d, "documents"), "doc_id", "text", _heading)


@query()
def chunk_pack(spark, d):
    return _chunks(spark, d)


@query()
def chunk_stats(spark, d):
    return V.work_estimate(_chunks(spark, d), "doc_id", "chunk_text")


@query()
def chunk_context(spark, d):
    docs = table(spark, d, "documents")
    context = D.context_line(F.col("source"), F.lit(None).cast("string"), F.lit("令和8年度"), F.lit("combined"), F.col("lang"), None)
    out = D.enriched_chunks(_chunks(spark, d), docs, "doc_id", context, C.tags_of(F.left("text", F.lit(2000)), TAGS), F.col("source"))
    return out.withColumn("exam_types", F.array_join("exam_types", ","))


@query("""SELECT conv_id, sha256(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn)) AS text_hash, count(*)::INT AS page_count,
 length(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn))::INT AS char_count FROM conversations WHERE turn <= 50 GROUP BY 1""")
def pages_to_document(spark, d):
    out = D.pages_to_documents(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", C.content_hash(F.col("full_text")).alias("text_hash"), "page_count", "char_count")


@query("SELECT conv_id, turn::INT AS page_number, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS page_text FROM conversations WHERE turn <= 50 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def document_pages(spark, d):
    whole = D.pages_to_documents(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return D.split_pages(whole, "conv_id", "full_text")


@query("""SELECT p_brand, '| p_name | p_size |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) FILTER (k <= 49) || CASE WHEN max(k) > 49 THEN chr(10) || '...' ELSE '' END AS markdown
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) GROUP BY 1""")
def markdown_table(spark, d):
    row = F.array(F.col("p_name"), F.col("p_size").cast("string"))
    first = top_per_key(table(spark, d, "part"), ["p_brand"], 50, F.col("p_partkey"))  # the table has 49 of them under its header
    rows = first.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("r"))
    grid = F.concat(F.array(F.array(F.lit("p_name"), F.lit("p_size"))), F.col("r.row"))
    return rows.select("p_brand", D.markdown_table(grid).alias("markdown"))


COSINE_SQL = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
VECTOR_SQL = f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
 (SELECT item_id AS query_id, b.vec_id AS chunk_id, round({COSINE_SQL}, 6) AS score FROM benchmark JOIN embeddings a ON a.vec_id = item_id JOIN embeddings b ON """


def _queries(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("q_label"))
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")).join(vectors, "item_id").withColumnRenamed("item_id", "query_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


@query(VECTOR_SQL + "true)) WHERE rank <= 10")
def vector_topk(spark, d):
    return R.vector_top_k(_queries(spark, d), _vectors(spark, d), 10)


@query(VECTOR_SQL + "a.label = b.label)) WHERE rank <= 5")
def vector_topk_filtered(spark, d):
    return R.vector_top_k(_queries(spark, d), _vectors(spark, d), 5, equal=[("q_label", "label")])


@query(VECTOR_SQL + "true)) WHERE rank <= 10")
def vector_index_topk(spark, d):
    """The same from an index by clusters."""
    path = work_path(spark, "vectors")
    R.index_vectors(_vectors(spark, d), path, 16)
    return R.vector_search(_queries(spark, d), path, 10)


def word_tokens(text):
    """Lower-cased words, for texts in Latin letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), "")


TOKENS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}]+'), lambda x: x <> '')"
BM25_SQL = f"""dt AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM dt),
 tf AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM dt), tc AS (SELECT doc_id, dl, token, count(*) AS tf FROM tf GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM tc GROUP BY 1), raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
 idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 qt AS (SELECT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS token FROM benchmark JOIN embeddings ON vec_id = item_id), qc AS (SELECT query_id, token, count(*) AS times FROM qt GROUP BY ALL),
 bs AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))), 6) AS score FROM qc JOIN idf USING (token) JOIN tc USING (token), st GROUP BY ALL),
 bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"WITH {BM25_SQL} SELECT * FROM bm WHERE rank <= 10")
def bm25_topk(spark, d):
    return R.bm25_top_k(_queries(spark, d), _texts(spark, d), 10, tokens=word_tokens)


@query(f"WITH {BM25_SQL} SELECT * FROM bm WHERE rank <= 10")
def bm25_index_topk(spark, d):
    """The same from a stored index that grows by a part and is then searched without the texts."""
    path, texts = work_path(spark, "bm25"), _texts(spark, d)
    english = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")
    R.index_chunks(english, path, tokens=word_tokens)
    R.index_chunks(texts, path, tokens=word_tokens)  # all that the first part hasn't got
    return R.bm25_search(_queries(spark, d), path, 10, tokens=word_tokens)


FUSED_SQL = f"""vt AS ({VECTOR_SQL} true)) WHERE rank <= 20), rr AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM
 (SELECT query_id, chunk_id, rank FROM vt UNION ALL SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 20) GROUP BY ALL),
 fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr)"""


@query(f"WITH {BM25_SQL}, {FUSED_SQL} SELECT * FROM fu WHERE rank <= 20")
def rrf_fused(spark, d):
    near = R.vector_top_k(_queries(spark, d), _vectors(spark, d), 20)
    return R.fused([near, R.bm25_top_k(_queries(spark, d), _texts(spark, d), 20, tokens=word_tokens)])


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks by BM25 with their texts and their queries."""
    queries = _queries(spark, d)
    hits = R.with_chunks(R.bm25_top_k(queries, _texts(spark, d), 10, tokens=word_tokens), _texts(spark, d), queries.count() * 10)
    return hits.join(small(queries.select("query_id", "query")), "query_id")


KEYWORDS = ("tion", "the", "qu", "sch")
HITS_SQL = f"""WITH {BM25_SQL}, hi AS (SELECT bm.*, d.text, b.text AS query FROM bm JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)"""
MATCHES_SQL = " + ".join(f"(contains(query, '{w}') AND contains(text, '{w}'))::INT" for w in KEYWORDS)
ANY_SQL = sql_any("query", KEYWORDS)


@query(HITS_SQL + f""", bo AS (SELECT query_id, chunk_id, score, rank AS r0, {MATCHES_SQL} AS keyword_matches, round(score + 0.02 * ({MATCHES_SQL}), 6) AS hybrid_score, {ANY_SQL} AS a FROM hi)
 SELECT query_id, chunk_id, score, keyword_matches, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a THEN -hybrid_score ELSE r0 END, chunk_id) AS rank FROM bo""")
def keyword_boost(spark, d):
    out = R.boosted(_hits(spark, d), C.all_contained(F.col("query"), KEYWORDS), F.col("text"))
    return out.select("query_id", "chunk_id", "score", "keyword_matches", "hybrid_score", "rank")


TERMS_SQL = "regexp_extract_all(query, '([一-鿿぀-ヿ]{2,}|[a-zA-Z]{3,})', 1)"


@query(HITS_SQL + f""", re AS (SELECT query_id, chunk_id, rank AS r0, CASE WHEN count(*) OVER (PARTITION BY query_id) > 5 THEN
 round(0.7::DOUBLE * score + 0.3::DOUBLE * len(list_filter({TERMS_SQL}, lambda t: contains(text, t))) / greatest(len({TERMS_SQL}), 1), 10) END AS rerank_score FROM hi)
 SELECT query_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, r0, chunk_id) AS rank FROM re) WHERE rank <= 5""")
def lexical_rerank(spark, d):
    out = R.reranked(_hits(spark, d), C.query_terms(F.col("query")), F.col("text"), "score")
    return out.select("query_id", "chunk_id", "rerank_score", "rank")


OWN_FUSED_SQL = FUSED_SQL.replace(" true))", " b.vec_id IN (SELECT doc_id FROM documents)))")  # vectors of chunks
HYBRID_SQL = f"""WITH {BM25_SQL}, {OWN_FUSED_SQL}, hi AS (SELECT fu.*, d.text, b.text AS query FROM fu JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20),
 re AS (SELECT query_id, chunk_id, score, rank AS r0, CASE WHEN count(*) OVER (PARTITION BY query_id) > 5 THEN round(0.7::DOUBLE * score + 0.3::DOUBLE * len(list_filter({TERMS_SQL}, lambda t: contains(text, t))) / greatest(len({TERMS_SQL}), 1), 10) END AS rerank_score FROM hi)
 SELECT query_id, chunk_id, score, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, r0, chunk_id) AS rank FROM re) WHERE rank <= 5"""


@query(HYBRID_SQL)
def hybrid_search(spark, d):
    out = R.hybrid_search(_queries(spark, d), _texts(spark, d), tokens=word_tokens, vectors=_vectors(spark, d).select("chunk_id", "vector"))
    return out.select("query_id", "chunk_id", "score", "rerank_score", "rank")


@query(HITS_SQL + """ SELECT query_id, sha256(string_agg('[' || rank || '] ' || chunk_id || chr(10) || left(text, 900), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash, count(*)::INT AS blocks FROM hi WHERE rank <= 5 GROUP BY 1""")
def context_assembly(spark, d):
    hits = _hits(spark, d).where("rank <= 5").withColumn("label", F.col("chunk_id").cast("string"))
    return R.context_blocks(hits).select("query_id", C.content_hash(F.col("context")).alias("context_hash"), "blocks")


@query(HITS_SQL + " SELECT query_id, rank, chunk_id, left(text, 200) AS preview, round(score, 4) AS shown_score FROM hi")
def citations(spark, d):
    return R.citations(R.result_list(_hits(spark, d)), ["chunk_id", "preview", "shown_score"])


@query("""SELECT page_id, array_to_string(list_slice(x, 1, 5), ' ') AS sources, len(x)::INT AS n FROM (SELECT page_id, list_transform(list_filter(list_zip(v, range(1, len(v) + 1)), lambda e: list_position(v, e[1]) = e[2]), lambda e: e[1]) AS x FROM
 (SELECT page_id, regexp_extract_all(html, 'href="(/[a-zA-Z]+)"', 1) AS v FROM pages))""")
def extracted_sources(spark, d):
    return R.sources_in_text(table(spark, d, "pages"), "page_id", "html", 'href="(/[a-zA-Z]+)"')


@query(f"""SELECT band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM (SELECT CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS band FROM ({VECTOR_SQL} true)) WHERE rank <= 5)) GROUP BY 1""")
def eval_bands(spark, d):
    return V.score_bands(R.vector_top_k(_queries(spark, d), _vectors(spark, d), 5), "score")


# Matching: suppliers' parts as known units, disturbed names as items. The block is the brand.

KNOWN_SQL = "known AS (SELECT p_brand AS block, p_partkey AS unit_id, p_partkey AS pos, p_name AS name, replace(p_name, ' ', '') AS name_key FROM part)"
ITEM_NAME_SQL = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name || 'x' END"


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("unit_type"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("sub"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    odd = F.when(k == 0, name).when(k == 1, F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(F.concat(name, F.lit("x")))
    return table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("input_pos"), F.lit(0).alias("item_pos"), F.lit(None).cast("string").alias("unit_type"), odd.alias("name"), F.lit(None).cast("string").alias("sub"), F.lit("high").alias("confidence"))


@query(f"WITH {KNOWN_SQL}, items AS (SELECT p_brand AS block, p_partkey AS input_pos, replace({ITEM_NAME_SQL}, ' ', '') AS key FROM part) SELECT items.block, input_pos, unit_id FROM items JOIN known ON known.block = items.block AND name_key = key")
def exact_match(spark, d):
    return M.exact_matches(_items(spark, d), _known(spark, d), full=False).select("block", "input_pos", "unit_id")


@query(f"""WITH {KNOWN_SQL}, u AS (SELECT block, name_key, min(pos) AS pos, min_by(unit_id, pos) AS unit_id FROM known GROUP BY ALL), items AS (SELECT p_brand AS block, p_partkey AS input_pos, replace({ITEM_NAME_SQL}, ' ', '') AS key FROM part),
 s AS (SELECT items.block, input_pos, unit_id, pos, 100.0::DOUBLE * (greatest(length(key), length(name_key)) - levenshtein(key, name_key)) / greatest(length(key), length(name_key)) AS score FROM items JOIN u ON u.block = items.block)
 SELECT block, input_pos, unit_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block, input_pos ORDER BY score DESC, pos) AS k FROM s WHERE score >= 75) WHERE k = 1""")
def fuzzy_match_edit(spark, d):
    out = M.fuzzy_matches(_items(spark, d), _known(spark, d), full=False, sql=True)
    return out.select("block", "input_pos", "unit_id", F.round("score", 6).alias("score"))


@query()
def fuzzy_match(spark, d):
    return M.fuzzy_matches(_items(spark, d), _known(spark, d))


def _sub_known(spark: SparkSession, d: str) -> DataFrame:
    sub = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("unit_type"), F.col("p_name").alias("name"), sub.alias("sub"))


def _sub_items(spark: SparkSession, d: str) -> DataFrame:
    """Every part as an item with a sub-unit, a third of the names and a third of the sub-units cut short."""
    k, name, sub = F.col("p_partkey") % 3, F.col("name"), F.col("sub")
    rows = table(spark, d, "part").withColumns({"name": F.col("p_name"), "sub": F.concat(F.lit("size"), F.col("p_size").cast("string"))})
    cut = F.when(k == 1, F.substr(name, F.lit(2))).otherwise(name)
    return rows.select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("input_pos"), F.lit(0).alias("item_pos"), F.col("p_type").alias("unit_type"), cut.alias("name"),
                       F.when(k == 2, F.substr(sub, F.lit(2))).otherwise(sub).alias("sub"), F.lit("high").alias("confidence"))


@query("""WITH u AS (SELECT p_brand AS block, p_type AS t, replace(p_name || '/size' || p_size, ' ', '') AS b, min(p_partkey) AS pos FROM part GROUP BY ALL),
 i AS (SELECT p_brand AS block, p_type AS t, p_partkey AS input_pos, replace(CASE WHEN p_partkey % 3 = 1 THEN substr(p_name, 2) ELSE p_name END || '/' || CASE WHEN p_partkey % 3 = 2 THEN 'ize' ELSE 'size' END || p_size, ' ', '') AS a FROM part),
 s AS (SELECT i.block, input_pos, pos, 100.0::DOUBLE * (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) AS score FROM i JOIN u ON u.block = i.block AND u.t = i.t)
 SELECT block, input_pos, pos AS unit_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block, input_pos ORDER BY score DESC, pos) AS k FROM s WHERE score >= 75) WHERE k = 1""")
def sub_unit_match_edit(spark, d):
    out = M.fuzzy_matches(_sub_items(spark, d), _sub_known(spark, d), full=False, sql=True)
    return out.select("block", "input_pos", "unit_id", F.round("score", 6).alias("score"))


@query()
def sub_unit_match(spark, d):
    return M.fuzzy_matches(_sub_items(spark, d), _sub_known(spark, d))


@query()
def match_resolved(spark, d):
    return M.resolved(_items(spark, d), _known(spark, d))


@query("""SELECT count(*) AS n, count(*) FILTER (100.0 * (greatest(length(p_name), length(o)) - levenshtein(p_name, o)) / greatest(length(p_name), length(o)) >= 80) AS consistent FROM
 (SELECT p_name, CASE WHEN p_partkey % 2 = 0 THEN p_name || 'x' ELSE p_brand END AS o FROM part)""")
def owner_consistency(spark, d):
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(P.consistent_owner(F.col("p_name"), other, sql=True)).alias("consistent"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 15000 THEN 'SHORT' WHEN length(text) <= 60000 THEN 'MEDIUM' ELSE 'LONG' END AS tier FROM documents""")
def length_tiers(spark, d):
    return table(spark, d, "documents").select("doc_id", C.length_tier(F.col("text")).alias("tier"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE text END AS line FROM conversations)
 SELECT conv_id, turn, value FROM (SELECT *, lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS value FROM l) WHERE line = 'user'""")
def next_line_lookup(spark, d):
    line = F.when(F.col("role") == "user", "user").otherwise(F.col("text"))
    lines = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), line.alias("line"))
    return D.labelled_values(lines, "conv_id", "user").withColumnRenamed("line_no", "turn")
