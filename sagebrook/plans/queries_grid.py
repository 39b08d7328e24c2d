"""Queries on grids, label blocks, sitemaps, scores and ordered merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coverage as V
from ..operators import docs as D
from ..operators import web as W
from .registry import query, table

# A sheet is a brand's parts of one type; a row is a part.


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), F.col("p_partkey").alias("row_idx"), F.col("p_size").alias("size"),
        F.array(F.col("p_name"), F.col("p_size").cast("string")).alias("cells"),
    )


@query("""WITH f AS (SELECT *, min(CASE WHEN p_size >= 45 THEN p_partkey END) OVER (PARTITION BY p_brand, p_type) AS a FROM part),
 g AS (SELECT *, min(CASE WHEN p_size <= 3 THEN p_partkey END) OVER (PARTITION BY p_brand, p_type) AS b FROM f WHERE p_partkey > a)
 SELECT p_brand AS workbook, p_type AS sheet, p_partkey AS row_idx FROM g WHERE b IS NULL OR p_partkey < b""")
def block_cut(spark, d):
    return D.block_rows(_cells(spark, d), F.col("size") >= 45, F.col("size") <= 3).select("workbook", "sheet", "row_idx")


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name END AS e, CASE WHEN p_size % 3 = 0 THEN p_name END AS u, CASE WHEN p_size % 2 = 0 THEN 's' || p_size END AS s FROM part),
 f AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS fe FROM r),
 n AS (SELECT *, fe IS DISTINCT FROM lag(fe) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS fresh FROM f),
 p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS part FROM n),
 x AS (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY p_brand, p_type, part ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS fu FROM p)
 SELECT p_brand AS workbook, p_type AS sheet, p_partkey AS row_idx, fe AS entity, 'part' AS unit_type, fu AS unit, s AS sub FROM x WHERE fe IS NOT NULL AND fu IS NOT NULL AND (s IS NOT NULL OR u IS NOT NULL)""")
def filled_units(spark, d):
    size, name = F.col("size"), F.get("cells", F.lit(0))
    rows = _cells(spark, d).select(
        "workbook", "sheet", "row_idx", F.when(size % 5 == 0, name).alias("entity"), F.lit("part").alias("unit_type"), F.when(size % 3 == 0, name).alias("unit"),
        F.when(size % 2 == 0, F.concat(F.lit("s"), size.cast("string"))).alias("sub"),
    )
    return D.filled_units(rows)


@query("""SELECT p_brand AS workbook, p_type AS sheet, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 'round' ELSE 'flat' END AS unit_type, p_name AS unit, min(p_partkey) AS row_idx
 FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt') OR contains(p_name, 'gear') GROUP BY ALL""")
def fallback_units(spark, d):
    return D.fallback_units(_cells(spark, d), {"round": ("ring", "bolt"), "flat": ("gear",)})


@query("""SELECT p_brand AS workbook, p_type AS sheet, arg_min(p_name, p_partkey) AS value
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) WHERE k <= 5 AND contains(p_name, 'e') GROUP BY ALL""")
def first_cells(spark, d):
    place = F.row_number().over(Window.partitionBy(*D.SHEET).orderBy("row_idx")) - 1
    return D.first_cell(_cells(spark, d).withColumn("row_idx", place), lambda c: F.when(F.contains(c, F.lit("e")), c), 5)


@query("SELECT p_brand AS workbook, p_type AS sheet, min(p_partkey) AS header_idx FROM part WHERE contains(p_name, 'a') AND (p_size || '') LIKE '%1%' GROUP BY ALL")
def header_rows(spark, d):
    name, size = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    titled = F.array(F.when(F.contains(name, F.lit("a")), "named"), F.when(F.contains(size, F.lit("1")), "sized"))
    found = D.header_row(_cells(spark, d).withColumn("cells", titled), {"name": ("named",), "size": ("sized",)})
    return found.select("workbook", "sheet", "header_idx")


@query("""WITH h AS (SELECT conv_id, list_sort(list(turn)) AS u FROM conversations WHERE role = 'user' GROUP BY 1), f AS (SELECT conv_id, u[least(2, len(u))] AS a FROM h),
 b AS (SELECT c.conv_id, turn, role, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY c.conv_id) AS z FROM conversations c JOIN f ON f.conv_id = c.conv_id WHERE turn > a)
 SELECT conv_id, turn AS line_no, role AS line FROM b WHERE z IS NULL OR turn < z""")
def labelled_block(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("role").alias("line"))
    return D.labelled_block(lines, "conv_id", "user", ("user",))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)utm_') THEN 0 ELSE (CASE WHEN contains(url, 'example.com') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(url), 'page') OR contains(lower(url), 'ref') THEN 5 ELSE 0 END)
 + (CASE WHEN contains(url, '/en/') THEN 3 ELSE 0 END) + (CASE WHEN length(url) - length(replace(url, '/', '')) >= 4 THEN 2 ELSE 0 END) END AS score FROM pages""")
def owner_url_scores(spark, d):
    score = C.owner_url_score(F.col("url"), F.lit("example.com"), ("utm_",), ("page", "ref"), "/en/")
    return table(spark, d, "pages").select("page_id", score.alias("score"))


@query("""SELECT page_id, 0 AS pos, regexp_extract(url, '^[^\\s<]+') AS loc, false AS is_sitemap FROM pages UNION ALL SELECT page_id, 1, 'https://example.com/s' || page_id || '.xml', true FROM pages""")
def sitemap_locations(spark, d):
    body = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><sitemap><loc>https://example.com/s"), F.col("page_id").cast("string"), F.lit(".xml</loc></sitemap></urlset>"))
    return W.sitemap_urls(table(spark, d, "pages").withColumn("body", body), "page_id", "body")


@query("""WITH s AS (SELECT c_nationkey, c_custkey, 0 AS source_no, c_custkey AS pos FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_nationkey, c_custkey, 1, c_custkey FROM customer),
 o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_custkey ORDER BY source_no, pos) AS k FROM s),
 l AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY source_no, pos, c_custkey) AS j FROM o WHERE k = 1) SELECT c_nationkey, c_custkey, source_no FROM l WHERE j <= 20""")
def ordered_merge(spark, d):
    rows = table(spark, d, "customer").withColumn("pos", F.col("c_custkey"))
    return V.ordered_merge([rows.where("c_acctbal > 8000"), rows], "c_custkey", "pos", "c_nationkey", 20).select("c_nationkey", "c_custkey", "source_no")


@query("SELECT c_mktsegment AS entity, list_aggregate(list_slice(list(c_name ORDER BY c_custkey), 1, 2), 'string_agg', ',') AS names FROM customer GROUP BY 1")
def query_names(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("entity"), F.lit("segment").alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    made = W.search_queries(rows, "entity", "kind", "name", "pos", ["%s|%s"])
    return made.select("entity", F.array_join(F.transform("queries", lambda q: F.substring_index(q, "|", -1)), ",").alias("names"))
