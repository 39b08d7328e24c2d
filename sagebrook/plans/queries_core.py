"""Queries on the relational tables: coverage, joins, windows, upserts, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coverage as V
from ..operators import filters as P
from ..operators import match as M
from ..operators.common import first_per_key, percent, share_of_total, small, top_per_key, work_path
from ..sources import tables as S
from .registry import query, table

# Roles: unit = customer, entity = nation, region = region, document = orders, edge = lineitem.

UNITS_SQL = """units AS (SELECT c.*, n_name, r_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS covered
 FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").join(small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return V.covered_units(customers, edges, "c_custkey")


@query(f"WITH {UNITS_SQL} SELECT count(*) AS total, count(*) FILTER (covered) AS covered_n, count(*) FILTER (NOT covered) AS uncovered_n, round(100.0 * count(*) FILTER (covered) / nullif(count(*), 0), 1)::DOUBLE AS pct FROM units")
def coverage_overall(spark, d):
    return V.coverage(units(spark, d))


BY_ENTITY_SQL = f"WITH {UNITS_SQL}, e AS (SELECT n_name, r_name, count(*) AS total, count(*) FILTER (covered) AS covered_n, count(*) FILTER (NOT covered) AS uncovered_n, round(100.0 * count(*) FILTER (covered) / count(*), 1)::DOUBLE AS pct FROM units GROUP BY ALL)"


@query(BY_ENTITY_SQL + " SELECT * FROM e ORDER BY pct DESC, n_name")
def coverage_by_entity(spark, d):
    return V.coverage(units(spark, d), ["n_name", "r_name"]).orderBy(F.desc("pct"), "n_name")


@query(BY_ENTITY_SQL + " SELECT n_name, total, covered_n, uncovered_n, pct, r_name AS region FROM e")
def coverage_worst_first(spark, d):
    return V.coverage(units(spark, d), ["n_name", "r_name"]).withColumnRenamed("r_name", "region").orderBy("pct", "n_name")


@query(BY_ENTITY_SQL + ' SELECT count(*) FILTER (pct = 100) AS "full", count(*) FILTER (pct > 0 AND pct < 100) AS partial, count(*) FILTER (pct = 0) AS "none", count(*) AS entities FROM e')
def coverage_buckets(spark, d):
    return V.coverage_buckets(V.coverage(units(spark, d), ["n_name"]))


@query(f"WITH {UNITS_SQL} SELECT r_name, count(DISTINCT n_name) AS entities, count(*) AS total, count(*) FILTER (covered) AS covered_n FROM units GROUP BY r_name")
def coverage_by_region(spark, d):
    return units(spark, d).groupBy("r_name").agg(F.count_distinct("n_name").alias("entities"), F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered_n"))


@query(f"WITH {UNITS_SQL} SELECT c_custkey, n_name, c_mktsegment FROM units WHERE covered IS DISTINCT FROM true")
def uncovered_units(spark, d):
    return P.uncovered(units(spark, d), "covered", True).select("c_custkey", "n_name", "c_mktsegment")


@query(f"WITH {UNITS_SQL} SELECT n_name, count(*) AS n FROM units WHERE NOT covered GROUP BY n_name ORDER BY n DESC, n_name LIMIT 30")
def uncovered_queue(spark, d):
    return P.uncovered(units(spark, d), "covered", True).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "n_name").limit(30)


@query(BY_ENTITY_SQL + " SELECT n_name, CASE WHEN covered_n = total THEN 'complete' WHEN covered_n > 0 THEN 'partial' ELSE 'none' END AS status FROM e WHERE pct >= 50")
def entity_status(spark, d):
    out = V.coverage(units(spark, d), ["n_name"]).where("pct >= 50")
    return out.select("n_name", P.status_label(F.col("covered_n"), F.col("total")).alias("status"))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS cleaned, count(*) FILTER (o_orderstatus = 'P') AS excluded,
 count(*) FILTER (o_totalprice > 200000) AS large, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 1)::DOUBLE AS pct FROM orders GROUP BY o_orderpriority""")
def clean_progress(spark, d):
    flags = {"cleaned": F.col("o_orderstatus") == "F", "excluded": F.col("o_orderstatus") == "P", "large": F.col("o_totalprice") > 200000}
    return V.clean_progress(table(spark, d, "orders"), flags, "cleaned", ["o_orderpriority"])


@query("""SELECT o_orderpriority, count(*) AS documents, count(n) AS chunked, coalesce(sum(n), 0)::BIGINT AS chunks FROM orders
 LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def chunk_progress(spark, d):
    return V.chunk_progress(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(spark, d, "lineitem"), "l_orderkey", ["o_orderpriority"])


@query("""SELECT n_name, l_returnflag, count(*) AS n, count(DISTINCT o_orderkey) AS documents FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""")
def edges_three_way(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    who = table(spark, d, "customer").join(small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    out = V.edges_three_way(edges, docs, who, "o_orderkey", "c_custkey", F.col("l_returnflag").isin("A", "R"))
    return out.groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("documents"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 49""")
def edges_needing_review(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = V.edges_three_way(edges, docs, table(spark, d, "customer").select("c_custkey", "c_name"), "o_orderkey", "c_custkey",
                            (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 49))
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_returnflag", "c_name")


@query("""SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE l_linestatus = 'O' GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10""")
def low_confidence_by_entity(spark, d):
    edges = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    rows = edges.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    named = V.looked_up(rows.withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), "n_nationkey", "n_name")
    return named.groupBy("n_name").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "n_name").limit(10)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM lineitem GROUP BY ALL")
def method_share(spark, d):
    return share_of_total(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS entities FROM events GROUP BY 1")
def daily_timeline(spark, d):
    return V.daily(table(spark, d, "events"), "ts", "user_id")


@query("SELECT day, count(*) AS n FROM (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1) GROUP BY day")
def daily_newly_covered(spark, d):
    return V.newly_covered(table(spark, d, "events"), "ts", "user_id")


@query("SELECT day, n, entities, (sum(n) OVER (ORDER BY day))::BIGINT AS running FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS entities FROM events GROUP BY 1)")
def daily_cumulative(spark, d):
    return V.cumulative(V.daily(table(spark, d, "events"), "ts", "user_id"))


@query("SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1 ORDER BY latest DESC, o_custkey LIMIT 20")
def latest_per_entity(spark, d):
    return V.latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", 20)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial,
 max(o_orderdate) AS last_seen FROM orders GROUP BY 1""")
def scope_pivot(spark, d):
    return V.pivot_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", {"finished": "F", "open": "O", "partial": "P"}, "o_orderdate")


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return V.duplicate_keys(table(spark, d, "documents").select(C.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash")), ["content_hash"])


@query("SELECT user_id, count(DISTINCT props) AS versions, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1 HAVING count(DISTINCT props) > 1")
def content_drift(spark, d):
    return V.content_drift(table(spark, d, "events"), "user_id", "props", "ts")


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, host LIMIT 10")
def shared_urls(spark, d):
    hosts = table(spark, d, "pages").select(C.host(F.col("url")).alias("host"))
    return V.duplicate_keys(hosts, ["host"]).orderBy(F.desc("n"), "host").limit(10)


@query("""SELECT source, count(*) AS "groups", sum(n - 1)::BIGINT AS extra FROM (SELECT source, sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY source""")
def duplicates_in_entity(spark, d):
    return V.duplicates_by_entity(table(spark, d, "documents").withColumn("h", C.content_hash(F.col("text"))), "source", "h")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def category_distribution(spark, d):
    return share_of_total(table(spark, d, "events"), ["event_type"]).orderBy(F.desc("n"), "event_type").limit(10)


@query("""SELECT count(*) AS rows, round(avg(n), 6) AS avg_len, max(n) AS max_len, min(n) AS min_len, 0.0::DOUBLE AS null_pct, round(100.0 * count(*) FILTER (n = 0) / count(*), 1)::DOUBLE AS empty_pct
 FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)""")
def array_length_stats(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turns"))
    return V.array_statistics(rows, "turns")


@query("SELECT count(*) AS n FROM conversations WHERE role = 'user' AND length(text) > 200")
def nested_condition_count(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.length("text").alias("len"))).alias("turns"))
    return V.element_count(rows, "turns", lambda t: (t["role"] == "user") & (t["len"] > 200))


STATES_SQL = f"""WITH {UNITS_SQL}, s AS (SELECT n_name, CASE WHEN pct >= 99.9 THEN 'done' WHEN pct > 0 THEN 'in progress' ELSE 'not started' END AS state, total, covered_n FROM
 (SELECT n.n_name, count(c_custkey) AS total, count(*) FILTER (covered) AS covered_n, coalesce(100.0 * count(*) FILTER (covered) / nullif(count(c_custkey), 0), 0) AS pct
  FROM nation n LEFT JOIN units u ON u.n_name = n.n_name GROUP BY 1))"""


@query(STATES_SQL + " SELECT coalesce(state, 'all') AS state, count(*) AS entities, sum(total)::BIGINT AS total, sum(covered_n)::BIGINT AS covered_n FROM s GROUP BY ROLLUP (state)")
def progress_states(spark, d):
    counted = V.coverage(units(spark, d), ["n_name"]).select("n_name", "total", "covered_n")
    return V.state_totals(V.progress_states(table(spark, d, "nation"), counted, "n_name"))


@query("""SELECT 'prices are positive' AS name, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS severity, n AS violations FROM (SELECT count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS n FROM orders)
 UNION ALL SELECT 'texts are long', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, n FROM (SELECT count(*) FILTER (NOT coalesce(length(text) >= 80, false)) AS n FROM documents)
 UNION ALL SELECT 'status is known', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n FROM (SELECT count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) AS n FROM orders)""")
def expectations(spark, d):
    orders, docs = table(spark, d, "orders"), table(spark, d, "documents")
    return V.expectations([
        ("prices are positive", "error", orders, F.col("o_totalprice") > 0), ("texts are long", "warning", docs, F.length("text") >= 80),
        ("status is known", "error", orders, F.col("o_orderstatus").isin("F", "O", "P")),
    ])


@query(f"""SELECT split_part({HOST_SQL}, '.', -1) AS suffix, count(*) AS total, round(100.0 * count(*) FILTER (url LIKE 'https:%') / count(*), 1)::DOUBLE AS secure,
 round(100.0 * count(*) FILTER (url LIKE '%?%') / count(*), 1)::DOUBLE AS parameters, round(100.0 * count(*) FILTER (url LIKE '%#%') / count(*), 1)::DOUBLE AS fragment FROM pages GROUP BY 1""")
def url_quality(spark, d):
    url = F.col("url")
    return V.shares(table(spark, d, "pages").withColumn("suffix", F.substring_index(C.host(url), ".", -1)),
                    {"secure": url.startswith("https:"), "parameters": url.contains("?"), "fragment": url.contains("#")}, ["suffix"])


@query("""SELECT l_returnflag, round(100.0 * count(*) FILTER (l_discount > 0) / count(*), 1)::DOUBLE AS discounted, round(100.0 * count(*) FILTER (l_tax > 0) / count(*), 1)::DOUBLE AS taxed, count(*) AS total FROM lineitem GROUP BY 1""")
def fill_rates(spark, d):
    return V.shares(table(spark, d, "lineitem"), {"discounted": F.col("l_discount") > 0, "taxed": F.col("l_tax") > 0}, ["l_returnflag"])


# Upserts, versions and incremental reads: orders before and from a day on.
CUT = "1996-01-01"


@query(f"""WITH old AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS price FROM orders WHERE o_orderdate < DATE '{CUT}' GROUP BY ALL),
 new AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS price FROM orders WHERE o_orderdate >= DATE '{CUT}' GROUP BY ALL)
 SELECT o_custkey, o_orderstatus, coalesce(new.price, old.price) AS price, CASE WHEN old.price IS NULL THEN 'inserted' WHEN new.price IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
 FROM old FULL JOIN new USING (o_custkey, o_orderstatus)""")
def upsert_merge(spark, d):
    orders = table(spark, d, "orders")
    part = lambda rows: rows.groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("price"))
    return S.upsert(part(orders.where(f"o_orderdate < DATE '{CUT}'")), part(orders.where(f"o_orderdate >= DATE '{CUT}'")), ["o_custkey", "o_orderstatus"])


@query(f"""WITH old AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS price FROM orders WHERE o_orderdate < DATE '{CUT}' GROUP BY ALL),
 new AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS price FROM orders WHERE o_orderdate >= DATE '{CUT}' GROUP BY ALL)
 SELECT o_custkey, o_orderstatus, coalesce(new.price, old.price) AS price FROM old FULL JOIN new USING (o_custkey, o_orderstatus)""")
def upsert_stored(spark, d):
    """The whole table as it lies there after the changes."""
    orders, keys, path = table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], work_path(spark, "orders")
    part = lambda rows: rows.groupBy(*keys).agg(F.max("o_totalprice").alias("price"))
    S.store_keyed(part(orders.where(f"o_orderdate < DATE '{CUT}'")), path, keys, 16)
    S.upsert_stored(spark, path, part(orders.where(f"o_orderdate >= DATE '{CUT}'")), keys, partitions=16)
    return spark.read.parquet(path).drop("key_partition")


@query(f"""WITH old AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '{CUT}'), new AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '{CUT}')
 SELECT CASE WHEN old.o_custkey IS NULL THEN 'inserted' WHEN new.o_custkey IS NOT NULL THEN 'updated' ELSE 'kept' END AS action, count(*) AS n FROM old FULL JOIN new ON old.o_custkey = new.o_custkey GROUP BY 1""")
def upsert_stats(spark, d):
    orders = table(spark, d, "orders")
    part = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    return S.load_statistics(S.upsert(part(orders.where(f"o_orderdate < DATE '{CUT}'")), part(orders.where(f"o_orderdate >= DATE '{CUT}'")), ["o_custkey"]))


@query("SELECT source AS url, sha256(text) AS content_hash, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS times FROM documents GROUP BY ALL")
def versioned_insert(spark, d):
    docs = table(spark, d, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))  # two crawls that together are all documents
    return S.versioned_insert(docs.where(english), docs.where(~english), "source", "text", "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def incremental_skip(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.not_done(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, coalesce(c_name, 'none') AS c_name, coalesce(c_mktsegment, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def column_refresh(spark, d):
    replica = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit("none").alias("c_name"), "o_orderpriority")
    master = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_mktsegment").alias("o_orderpriority"))
    return S.refreshed(replica, master, "o_custkey", ["c_name", "o_orderpriority"]).drop("o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')
 UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def reprocessed(spark, d):
    stored = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    return S.reprocessed(stored, new, "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def flags_reset(spark, d):
    return S.reset_flags(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderstatus") == "P", {"o_orderpriority": "unknown"}).drop("o_orderstatus")


@query("""SELECT n_nationkey, coalesce(c_top, '') AS c_top, coalesce(s_top, '') AS s_top FROM (SELECT c_nationkey AS n_nationkey, max(c_name) AS c_top FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
 FULL JOIN (SELECT s_nationkey AS n_nationkey, max(s_name) AS s_top FROM supplier GROUP BY 1) USING (n_nationkey)""")
def full_outer_merge(spark, d):
    left = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_name").alias("c_top"))
    right = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("s_top"))
    return V.merged_maps(left, right, "n_nationkey", "c_top", "s_top")


@query("SELECT s_suppkey, coalesce(n_name, '不明') AS n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def lookup_default(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return V.looked_up(rows, table(spark, d, "nation").where("n_regionkey < 3"), "n_nationkey", "n_name").select("s_suppkey", "n_name")


@query("""WITH w AS (SELECT DISTINCT r_name AS wanted FROM region UNION SELECT DISTINCT substr(n_name, 1, 3) FROM nation UNION SELECT DISTINCT n_name FROM nation),
 f AS (SELECT wanted, n_name, n_name = wanted AS exact, row_number() OVER (PARTITION BY wanted ORDER BY (n_name = wanted) DESC, n_name) AS k FROM w JOIN nation ON contains(lower(n_name), lower(wanted)))
 SELECT wanted, n_name, exact FROM f WHERE k = 1""")
def exact_else_like(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    wanted = region.select(F.col("r_name").alias("wanted")).union(nation.select(F.substring("n_name", 1, 3))).union(nation.select("n_name")).distinct()
    return V.exact_else_like(wanted, nation, "n_name").select("wanted", "n_name", "exact")


@query("""WITH w AS (SELECT DISTINCT right(c_name, 4) AS wanted FROM customer UNION SELECT upper(c_name) FROM customer),
 f AS (SELECT wanted, c_name, c_name = wanted AS exact, row_number() OVER (PARTITION BY wanted ORDER BY (c_name = wanted) DESC, c_name) AS k FROM w JOIN customer ON contains(lower(c_name), lower(wanted)))
 SELECT wanted, c_name, exact FROM f WHERE k = 1""")
def names_held(spark, d):
    """Every customer is looked up by the end of its name and by its name in capitals."""
    c = table(spark, d, "customer")
    wanted = c.select(F.substr("c_name", F.lit(-4)).alias("wanted")).union(c.select(F.upper("c_name"))).distinct()
    return V.exact_else_like(wanted, c, "c_name").select("wanted", "c_name", "exact")


@query("SELECT c_mktsegment, string_agg(c_name, ', ' ORDER BY c_name) AS names, count(*) AS n FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def units_by_type(spark, d):
    return V.units_by_type(table(spark, d, "customer"), "c_nationkey", 3, "c_mktsegment", "c_name")


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_key_events(spark, d):
    return first_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id", "ts")


@query("SELECT user_id, event_id, value, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def top_n_per_group(spark, d):
    return top_per_key(table(spark, d, "events"), ["user_id"], 3, F.desc("value"), F.col("event_id"), rank="rank").select("user_id", "event_id", "value", "rank")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 AND role IN ('user', 'assistant')""")
def last_turns(spark, d):
    from ..operators.docs import last_turns as turns

    return turns(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def forward_fill(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(own).alias("filled"))


@query(f"WITH {UNITS_SQL} SELECT n_name, count(*) FILTER (NOT covered) AS missing, count(*) FILTER (NOT covered) = 0 AS complete FROM units GROUP BY n_name")
def subset_test(spark, d):
    rows = units(spark, d)
    return V.all_covered(rows, rows.where("covered"), "n_name", "c_custkey")


@query("""SELECT o_custkey, count(DISTINCT p) AS units, max(r) AS stop_rank FROM (SELECT o_custkey, o_orderpriority AS p, min(k) AS r FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) GROUP BY 1, 2) GROUP BY 1""")
def cover_prefix(spark, d):
    from pyspark.sql import Window

    ranked = table(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return M.covering_prefix(ranked, ranked.select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "k")


@query("SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY CASE WHEN s_acctbal > 5000 THEN s_acctbal END NULLS LAST, s_name, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 50")
def ranked_listing(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "supplier").withColumn("ranked", F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")))
    top = V.ranked_listing(rows, ["ranked"], "s_name").limit(50)
    return top.select("s_suppkey", "s_name", "s_acctbal", F.row_number().over(Window.orderBy(F.col("ranked").asc_nulls_last(), "s_name", "s_suppkey")).cast("long").alias("place"))  # 50 rows


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS k, s_nationkey AS e, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
 n AS (SELECT a.k AS profile, b.k AS peer, count(DISTINCT a.p) AS shared FROM f a JOIN f b ON a.p = b.p AND a.e <> b.e GROUP BY 1, 2)
 SELECT profile, peer, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY shared DESC, peer) AS rank FROM n) WHERE rank <= 8""")
def shared_field_peers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("field"))
    named = rows.join(small(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), V.NUMBERED_ROWS), "s_suppkey")
    return V.field_peers(named, "s_suppkey", "s_nationkey", "field")


@query("SELECT n > 1000 AS is_hot, count(*) AS fields, sum(n * (n - 1))::BIGINT AS pairs FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def shared_field_pairs(spark, d):
    return V.field_pairs(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT c_nationkey, c_custkey, c_name FROM customer UNION ALL SELECT s_nationkey, s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = s_nationkey)""")
def authoritative_merge(spark, d):
    own = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    other = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return V.authoritative_merge(own, other, ["c_nationkey", "c_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'widget')")
def profile_search(spark, d):
    return V.text_search(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], "WIDGET").select("p_partkey", "p_name")


SEASON_SQL = "CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END"


@query(f"""SELECT o_orderpriority, {SEASON_SQL} AS season, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1, 2""")
def season_pivot(spark, d):
    return V.season_pivot(table(spark, d, "orders"), "o_orderpriority", F.month("o_orderdate"), "o_orderstatus", ["F", "O", "P"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def filtered_scan(spark, d):
    rows = S.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], equal={"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, present=["o_orderkey"])
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT o_custkey, c_name, score, o_orderkey FROM (SELECT o_custkey, c_name, score, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, round_no, o_orderkey) AS k FROM
 (SELECT *, min(CASE WHEN score >= 10 THEN round_no END) OVER (PARTITION BY o_custkey) AS stop FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 30000) AS score, o_orderkey % 4 AS round_no FROM orders))
 JOIN customer ON c_custkey = o_custkey WHERE score >= 3 AND (stop IS NULL OR round_no <= stop)) WHERE k = 1""")
def best_candidate(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 30000).cast("double").alias("score"), (F.col("o_orderkey") % 4).alias("round_no"))
    best = M.accepted_best(rows, "o_custkey", "score", "round_no", "o_orderkey")
    return best.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_custkey", "c_name", "score", "o_orderkey")


@query("""SELECT s_nationkey, count(*) AS rows, round(100.0 * count(*) FILTER (s_acctbal > 0) / nullif(count(*), 0), 1)::DOUBLE AS pct FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_acctbal > 0) > 0 ORDER BY pct, s_nationkey LIMIT 5""")
def bottom_n(spark, d):
    out = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s_acctbal") > 0).alias("k")).where("k > 0")
    return out.select("s_nationkey", "rows", percent(F.col("k"), F.col("rows")).alias("pct")).orderBy("pct", "s_nationkey").limit(5)
