"""Column functions over whole columns of the tables, against SQL that says the same of the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import coverage as V
from ..operators import filters as P
from .queries_core import HOST_SQL
from .registry import query, table


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_BINARY = "|".join("[.]" + v.lstrip(".") for v in rules.BINARY_SUFFIXES)


@query(f"""SELECT page_id, NOT regexp_matches(lower(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '')), '({_BINARY})$') AND regexp_replace(url, '#.*$', '') <> 'http://' || {HOST_SQL} || '/' AS page
 FROM pages WHERE url IS NOT NULL""")
def own_site_pages(spark, d):
    pages = table(spark, d, "pages").where("url IS NOT NULL").withColumn("host", C.host(F.col("url")))
    return pages.select("page_id", P.page_link(F.col("url"), F.concat(F.lit("http://"), "host", F.lit("/")), F.col("host")).alias("page"))


@query(f"SELECT page_id, coalesce(contains(url, 'example') AND NOT regexp_matches(url, '(?i){'|'.join(rules.PROFILE_EXCLUDE)}'), false) AS own FROM pages")
def own_profile_pages(spark, d):
    return table(spark, d, "pages").select("page_id", P.own_profile_url(F.col("url"), F.lit("example")).alias("own"))


@query("SELECT doc_id, NOT contains(coalesce(text, ''), '403 Forbidden') AND len(string_split(coalesce(text, ''), chr(10))) >= 5 AND coalesce(source, '') NOT IN ('', 'src0') AS usable FROM documents")
def usable_documents(spark, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, d, "documents").select("doc_id", P.usable_page(lines, F.col("source"), ("", "src0")).alias("usable"))


@query("""SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN contains(p_name, 'ring') OR contains(p_name, 'bolt') WHEN 'SMALL' THEN contains(p_name, 'gear') ELSE true END AS shaped FROM part""")
def shaped_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", P.shaped_name(F.col("p_type"), F.col("p_name"), {"LARGE": ("ring", "bolt"), "SMALL": ("gear",)}).alias("shaped"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([p_type, p_brand, 'ring'], string_split(p_name, ' ')))), '|') AS tags FROM part")
def part_tags(spark, d):
    union = V.tag_union(F.array("p_type", "p_brand", F.lit("ring")), F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", F.array_join(union, "|").alias("tags"))


@query("""SELECT doc_id, (n_chars % 2 = 0 AND lang = 'en' AND length(text) < 100) OR n_chars < 500 AS scan FROM (SELECT doc_id, coalesce(n_chars, 0) AS n_chars, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)""")
def thin_documents(spark, d):
    docs = table(spark, d, "documents")
    notes = F.when(F.col("lang") == "en", "").otherwise(F.coalesce("lang", F.lit("?")))
    return docs.select("doc_id", C.likely_scan(F.col("n_chars") % 2, notes, F.col("text"), F.col("n_chars")).alias("scan"))


@query("""SELECT o_orderkey, CASE WHEN s >= 90 THEN CASE WHEN g = 'high' THEN 'high' ELSE 'medium' END WHEN s >= 75 THEN CASE WHEN g = 'low' THEN 'low' ELSE 'medium' END ELSE 'low' END AS confidence
 FROM (SELECT o_orderkey, o_totalprice / 4000.0::DOUBLE AS s, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' END AS g FROM orders)""")
def order_confidences(spark, d):
    given = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low")
    return table(spark, d, "orders").select("o_orderkey", C.match_confidence(F.col("o_totalprice") / 4000.0, given).alias("confidence"))


_WORDS, _TOPICS = ("tion", "der", "que"), ("the", "un", "ción")


@query(f"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(t, '([A-Z][a-z]ing)', 1), list_filter({_list(_WORDS)}, lambda w: contains(t, w)), list_filter({_list(_TOPICS)}, lambda w: contains(t, w))), '|') AS keywords
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def document_keywords(spark, d):
    found = C.query_keywords(F.coalesce("text", F.lit("")), "[A-Z][a-z]ing", _WORDS, _TOPICS)
    return table(spark, d, "documents").select("doc_id", F.array_join(found, "|").alias("keywords"))


@query("""SELECT p_partkey, array_to_string(list_concat(list_transform(range(1, length(x)), lambda i: substr(x, i, 2)), list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')), '|') AS tokens
 FROM (SELECT p_partkey, p_name || ' ' || p_type AS x FROM part)""")
def part_bigrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(C.bigram_tokens(F.concat_ws(" ", "p_name", "p_type")), "|").alias("tokens"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '') || '/' || p_type || p_size END AS key FROM part""")
def part_keys(spark, d):
    sub = F.when(F.col("p_size") % 5 != 0, F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", C.composite_key(F.col("p_name"), sub, full=False).alias("key"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT + l_linenumber AS capacity, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE l_linestatus END AS first FROM lineitem""")
def line_capacities(spark, d):
    values = F.array(F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit(None).cast("string"))
    first = F.array(F.lit(None).cast("string"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")), F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.capacity_sum(values).alias("capacity"), C.first_present(first).alias("first"))


_PREFS = _list(rules.PREFECTURES)


@query(f"""SELECT c_custkey, list_filter({_PREFS}, lambda p: contains(t, p))[1] AS prefecture FROM
 (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {_PREFS}[c_custkey % 47 + 1] END || c_mktsegment || {_PREFS}[c_nationkey + 1] AS t FROM customer)""")
def customer_prefectures(spark, d):
    names = F.lit(list(rules.PREFECTURES))
    own = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.get(names, (F.col("c_custkey") % 47).cast("int")))
    text = F.concat("c_name", own, "c_mktsegment", F.get(names, F.col("c_nationkey")))
    return table(spark, d, "customer").select("c_custkey", C.prefecture(text).alias("prefecture"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE year(o_orderdate) || '年度' END AS year FROM orders")
def order_years(spark, d):
    year = F.concat(F.year("o_orderdate").cast("string"), F.lit("年度"))
    top = F.to_json(F.struct(F.lit("不明").alias("academic_year"), year.alias("year")))
    nested = F.to_json(F.struct(F.lit("").alias("nendo"), F.array(F.struct(year.alias("year"))).alias("covered_units")))
    document = F.when(F.col("o_orderstatus") == "F", top).when(F.col("o_orderstatus") == "O", nested).otherwise(F.to_json(F.struct(F.lit("unknown").alias("year"))))
    return table(spark, d, "orders").select("o_orderkey", C.year_of_json(document).alias("year"))


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def daily_sketches(spark, d):
    """Distinct users a day from stored sketches of day and type, within their error of the exact number."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    found = V.merged_distinct(V.distinct_sketches(events, ["day", "event_type"], "user_id"), ["day"])
    exact = events.groupBy("day").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(found, "day").select("day", "users", (F.abs(F.col("distinct") - F.col("users")) <= 1 + 0.06 * F.col("users")).alias("within"))
