"""Table operators on literal cases."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from sagebrook.functions import rules
from sagebrook.operators import coverage as V
from sagebrook.operators import docs as D
from sagebrook.operators import match as M
from sagebrook.operators import retrieve as R
from sagebrook.operators import web as W
from sagebrook.sources import tables as S


def sections(spark, text, heading=None):
    rows = D.sections(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text", heading or D.default_heading).orderBy("section_no").collect()
    return [(r.heading, r.content, r.page_number) for r in rows]


def test_sections(spark):
    assert sections(spark, "1. H1\n2. H2\nb") == [("冒頭", "1. H1", 1), ("2. H2", "b", 1)]
    assert sections(spark, "a\n1. H1\n2. H2\n3. H3\nb") == [("冒頭", "a", 1), ("1. H1", "2. H2", 1), ("3. H3", "b", 1)]
    assert sections(spark, "--- Page 1 ---\na\n--- Page 2 ---\n【x】y\nb\n--- Page 3 ---") == [("冒頭", "a", 2), ("【x】y", "b", 3)]
    assert sections(spark, " \n1. H1\n \n") == []


def by_loop(text, is_heading):
    """The section rule as a plain loop."""
    out, head, body, page = [], "冒頭", [], 1
    for line in text.split("\n"):
        if line.startswith("--- Page "):
            page = int(line.split()[2])
        elif is_heading(line) and body:
            out.append((head, "\n".join(body).strip(), page))
            head, body = line.strip(), []
        else:
            body.append(line)
    out.append((head, "\n".join(body).strip(), page))
    return [s for s in out if s[1]]


def test_sections_of_odd_rows(spark):
    """Null and empty texts have none; rows that share a key are documents of their own; a page number that is too large is none."""
    rows = [(1, None), (2, ""), (3, "a\n1. H\nb"), (3, "c"), (None, "d"), (4, "--- Page 2 ---\ne\n--- Page 99999999999 ---")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("section_no", F.lit("clash"))
    found = sorted((str(r.k), r.section_no, r.heading, r.content, r.page_number) for r in D.sections(df, "k", "text").collect())
    first = rules.FIRST_HEADING
    assert found == [("3", 0, first, "a", 1), ("3", 0, first, "c", 1), ("3", 1, "1. H", "b", 1), ("4", 0, first, "e", 2), ("None", 0, first, "d", 1)]
    assert D.sections(df.where("false"), "k", "text").count() == 0 and D.document_chunks(df.where("false"), "k", "text").count() == 0


@pytest.mark.parametrize("most", [10_000, 2])
def test_vectors_by_matrix_and_join(spark, monkeypatch, most):
    """Ties by id; zero, null, odd and short vectors last, without a score; filters; both ways of meeting."""
    monkeypatch.setattr(R, "MATRIX_QUERIES", most)
    vectors = {1: [1.0, 0.0], 2: [2.0, 0.0], 3: [1.0, 1.0], 4: [0.0, 0.0], 5: None, 6: [1.0], 7: [None, 1.0], 8: [0.0, -1.0], 9: [float("nan"), 1.0]}
    chunks = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in vectors.items()], "chunk_id int, vector array<double>, g string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "b"), (3, None, None), (4, [0.0, 1.0], "b")], "query_id int, vector array<double>, f string")
    rows = R.vector_top_k(queries, chunks, 9).orderBy("query_id", "rank").collect()
    of = lambda q: [(r.chunk_id, r.score) for r in rows if r.query_id == q]
    last = [(i, None) for i in (4, 5, 6, 7, 9)]
    assert of(1) == [(1, 1.0), (2, 1.0), (3, 0.707107), (8, 0.0), *last] and of(2) == of(3) == [(i, None) for i in vectors]
    assert of(4) == [(3, 0.707107), (1, 0.0), (2, 0.0), (8, -1.0), *last]
    few = R.vector_top_k(queries, chunks, 2, equal=[("f", "g")]).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in few] == [(1, 2, 1), (1, 8, 2), (2, 1, 1), (2, 3, 2), (4, 3, 1), (4, 1, 2)]


def test_bm25_counts(spark):
    """Against the formula: repeated query tokens, a token in most chunks, empty and null chunks."""
    texts = {1: "a b a", 2: "a c", 3: "a", 4: "", 5: None, 6: "a d d"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "a d d"), (2, "b"), (3, "zz")], "query_id int, query string")
    words = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in "abcd"}
    raw = {t: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    score = lambda q, w: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in q.split() if t in w)
    want = {(q, i): round(score(t, w), 6) for q, t in ((1, "a d d"), (2, "b")) for i, w in words.items() if set(t.split()) & set(w)}
    tokens = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), " "), lambda w: w != "")
    got = R.bm25_top_k(queries, chunks, 10, tokens=tokens).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in got if r.score} == pytest.approx(want)
    for q in (1, 2):  # filled up with the first chunks that have no query token
        own = sorted((r.rank, r.chunk_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, min(10, len(words)) + 1))
        assert [c for _, c, score in own if not score] == sorted(i for i in words if (q, i) not in want)[: len(own) - sum(k[0] == q for k in want)]


def test_bm25_index_grows_and_is_searched_again(spark, tmp_path):
    """Parts added one after another search like one index; known chunks aren't added again, texts aren't read by a search, an unfinished part doesn't count."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    path, tokens = f"{tmp_path}/index", lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), " "), lambda w: w != "")
    assert R.index_chunks(docs.where("chunk_id % 3 = 0"), path, tokens=tokens) == docs.where("chunk_id % 3 = 0").count()
    rest = R.index_chunks(docs, path, tokens=tokens)
    assert rest == docs.where("chunk_id % 3 <> 0").count() and R.index_chunks(docs, path, tokens=tokens) == 0
    spark.range(1).write.parquet(f"{path}/postings/part=broken/bucket=0")
    for queries in ("chunk_id < 20", "chunk_id % 50 = 7"):
        asked = docs.where(queries).select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 200).alias("query"))
        asked = spark.createDataFrame(asked.collect(), asked.schema)
        found = R.bm25_search(asked, path, 10, tokens=tokens)
        whole = R.bm25_top_k(asked, docs, 10, tokens=tokens)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and found.count() == 10 * asked.count()
        assert not [f for f in found.inputFiles() if "documents" in f]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, 0.0], [-3.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 6) for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None, -1.0]


def test_vector_index_is_exact_and_prunes(spark, tmp_path, monkeypatch):
    """Clustered vectors, copies of one vector, odd vectors: the same hits as the whole search, split or not; queries skip clusters that are too far."""
    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8)) * 4
    rows = [(n, (middle[n % 12] + rng.normal(size=8) * 0.1).tolist()) for n in range(600)] + [(n, middle[0].tolist()) for n in range(600, 800)]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(n, (middle[n % 12] + rng.normal(size=8)).tolist()) for n in range(40)], "query_id long, vector array<double>")
    R.index_vectors(chunks, f"{tmp_path}/v", 12)
    want = sorted(map(tuple, R.vector_top_k(queries, chunks, 5).collect()))
    for first, tile, block in ((1, 50_000, 10_000), (2, 60, 15), (12, 60, 15)):
        monkeypatch.setattr(R, "TILE_CHUNKS", tile)
        monkeypatch.setattr(R, "MATRIX_QUERIES", block)
        assert sorted(map(tuple, R.vector_search(queries, f"{tmp_path}/v", 5, first).collect())) == want
    assert spark.read.parquet(f"{tmp_path}/v/chunks").count() == len(rows)
    R.index_vectors(chunks.where("false"), f"{tmp_path}/none")
    assert R.vector_search(queries, f"{tmp_path}/none", 5).count() == 0


def test_many_queries_meet_tiles_of_chunks(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q, c = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    c = c.unionByName(spark.createDataFrame([(-1, None, 1), (-2, [0.0] * 64, 1), (-3, [1.0], None)], "chunk_id long, vector array<float>, label int"))
    for equal in ([], [("label", "label")]):
        want = sorted(map(tuple, R.vector_top_k(q, c, 5, equal=equal).collect()))
        monkeypatch.setattr(R, "MATRIX_QUERIES", 60)
        monkeypatch.setattr(R, "TILE_CHUNKS", 90)
        found = R.vector_top_k(q, c, 5, equal=equal)
        assert sorted(map(tuple, found.collect())) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()


def test_sections_equal_the_loop(spark):
    import random

    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["H1x", "b", "", "--- Page 2 ---", "H2x", "--- Page 7 ---"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in D.sections(df, "k", "text", lambda line: line.startswith("H")).orderBy("k", "section_no").collect():
        got.setdefault(r.k, []).append((r.heading, r.content, r.page_number))
    for k, text in enumerate(texts):
        assert got.get(k, []) == by_loop(text, lambda x: x.startswith("H")), text


def test_chunks():
    pack = lambda *parts: D.packed_sections([("冒頭", t, 1) for t in parts])
    assert pack("x" * 79) == [] and len(pack("x" * 80)) == 1
    assert [len(c[0]) for c in pack("x" * 50, "y" * 880)] == [880]
    assert [len(c[0]) for c in pack("x" * 700 + "。" + "y" * 299)] == [701, 299]
    assert [len(c[0]) for c in pack("x" * 400 + "。" + "y" * 599)] == [900, 100]
    assert [len(c[0]) for c in pack("x" * 500 + "\n\n" + "y" * 500)] == [500, 500]
    assert [len(c[0]) for c in pack("x" * 400, "y" * 499, "z" * 100)] == [901, 100] or [len(c[0]) for c in pack("x" * 400, "y" * 499, "z" * 100)] == [900, 100]


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "a" * 100 + "\n1. H\n" + "b" * 2000), (2, None), (3, "")], "doc_id int, text string")
    rows = D.chunks(D.sections(docs, "doc_id", "text"), "doc_id").orderBy("doc_id", "chunk_index").collect()
    assert D.document_chunks(docs, "doc_id", "text").orderBy("doc_id", "chunk_index").collect() == rows
    assert [r.doc_id for r in rows] == [1] * len(rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(80 <= len(r.chunk_text) <= 900 for r in rows) and rows[0].section_path == "冒頭"


def test_context(spark):
    json = '[{"type": "一般", "capacity": "30", "exam_date": null, "application_period": {"start": "1/1", "end": ""}}, {"type": "推薦", "capacity": "x", "exam_date": "2/2"}]'
    types = F.from_json(F.lit(json), D.STRUCTURED.removeprefix("exam_types "))
    line = D.context_line(F.lit("A大学"), F.lit(None).cast("string"), F.lit("令和8年度"), F.lit("graduate"), F.lit("募集要項"), types)
    assert spark.range(1).select(line.alias("x")).first().x == "[A大学 | 令和8年度 | 大学院・研究科 | 募集要項]\n[入試方式: 一般 / 推薦]\n[定員合計: 30名]\n[出願期間: 1/1]\n[試験日: 2/2]"


def test_grids(spark):
    cells = spark.createDataFrame([
        ("w", "s", 0, ["○○大学", None, None]), ("w", "s", 1, ["大学名", "学部名", "学科名"]), ("w", "s", 2, ["A", "工学部", "機械"]), ("w", "s", 3, [None, None, "電気"]),
        ("w", "s", 4, ["B", None, "x"]), ("w", "s", 5, ["B", "理学部", None]), ("w", "s", 6, ["計", None, None]), ("w", "s", 7, ["C", "文学部", None]),
    ], "workbook string, sheet string, row_idx int, cells array<string>")
    head = D.header_row(cells, {"entity": ("大学",), "unit": ("学部",), "sub": ("学科",)}).first()
    assert head.header_idx == 1 and head["columns"] == {"entity": 0, "unit": 1, "sub": 2}
    body = D.block_rows(cells, F.get("cells", F.lit(0)) == "大学名", F.get("cells", F.lit(0)) == "計")
    rows = body.select("workbook", "sheet", "row_idx", F.get("cells", F.lit(0)).alias("entity"), F.lit("学部").alias("unit_type"), F.get("cells", F.lit(1)).alias("unit"), F.get("cells", F.lit(2)).alias("sub"))
    got = [(r.entity, r.unit, r.sub) for r in D.filled_units(rows).orderBy("row_idx").collect()]
    assert got == [("A", "工学部", "機械"), ("A", "工学部", "電気"), ("B", "理学部", None)]
    first = D.first_cell(cells, lambda c: F.when(F.endswith(c, F.lit("大学")), c), 5).first()
    assert first.value == "○○大学"
    loose = D.fallback_units(cells, {"学部": ("学部",)}).orderBy("row_idx").collect()
    assert [r.unit for r in loose] == ["学部名", "工学部", "理学部", "文学部"]
    assert D.by_priority(rows.where("false"), rows).count() == rows.count()


def test_profiles(spark):
    lines = ["山田太郎", "ヤマダ タロウ  (Taro Yamada)", "所属", "A大学 工学研究科 機械専攻 准教授", "学位", "研究キーワード", "研究キーワード", "2", "ロボット", "制御", "研究分野", "研究分野", "工学 / 機械", "経歴", "更新日: 2025/01/02"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, line_no int, line string")
    r = D.profiles(df, "k", ("教授", "准教授"), ("研究分野", "経歴")).first()
    assert (r.name_ja, r.name_kana, r.name_en, r.position, r.kenkyuka_name, r.senkou_name) == ("山田太郎", "ヤマダ タロウ", "Taro Yamada", "准教授", "工学研究科", "機械専攻")
    assert r.keywords == ["ロボット", "制御"] and r.research_fields == ["工学", "機械"] and r.profile_updated == "2025/01/02"


def test_tables_and_pages(spark):
    grid = F.array(F.array(F.lit("h1"), F.lit("h2")), F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("d")))
    assert spark.range(1).select(D.markdown_table(grid).alias("m")).first().m == "| h1 | h2 |\n| --- | --- |\n| a | b |\n| d |  |"
    docs = spark.createDataFrame([(1, "intro\n--- Page 1 ---\na\n--- Page 2 ---\n\n")], "k int, t string")
    assert [(r.page_number, r.page_text) for r in D.split_pages(docs, "k", "t").collect()] == [(0, "intro"), (1, "a")]


def test_merged_extractions(spark):
    schema = "k int, types array<struct<type string, n int>>, note string"
    a = spark.createDataFrame([(1, [("x", 1), (None, 2)], "old")], schema)
    b = spark.createDataFrame([(1, [("x", 3), ("y", 4), (None, 5)], None), (2, [("z", 6)], "new")], schema)
    rows = {r.k: ([tuple(t) for t in r.types], r.note) for r in D.merged_extractions(a, b, "k", "types", ["note"]).collect()}
    assert rows == {1: ([("x", 1), (None, 2), ("y", 4), (None, 5)], "old"), 2: ([("z", 6)], "new")}


KNOWN = "block string, unit_id int, pos int, unit_type string, name string, sub string"
ITEMS = "block string, input_pos int, item_pos int, unit_type string, name string, sub string, confidence string"


def test_matching(spark):
    known = spark.createDataFrame([("u", 1, 0, "学部", "工学部", "機械"), ("u", 2, 1, "学部", "工学部", "電気"), ("u", 3, 2, "学部", "工学部", "化学"), ("u", 4, 3, "研究科", "理学研究科", None), ("v", 5, 0, "学部", "工学部", None)], KNOWN)
    exact = M.exact_matches(spark.createDataFrame([("u", 0, 0, "学部", "工学 部", None, "high")], ITEMS), known)
    assert sorted(r.unit_id for r in exact.collect()) == [1, 2, 3]
    twice = spark.createDataFrame([("u", 0, 0, None, "理学研究科A", None, "high"), ("u", 1, 0, None, "理学研究科B", None, "high")], ITEMS)
    rows = M.resolved(twice, known).collect()
    assert [(r.unit_id, r.input_pos, r.method, r.match_confidence) for r in rows] == [(4, 0, "fuzzy", "high")]
    part = spark.createDataFrame([("u", 0, 1, "学部", "工学部", "機 械", "low"), ("u", 0, 2, "学部", "工学部", "電気x", "high"), ("u", 0, 3, None, "全く別", None, "high")], ITEMS)
    got = {r.item_pos: (r.unit_id, r.method) for r in M.resolved(part, known).collect()}
    assert got == {1: (1, "exact"), 2: (2, "fuzzy")}
    assert [r.item_pos for r in M.unmatched(part, M.resolved(part, known)).collect()] == [3]


def test_prefix_and_candidates(spark):
    edges = spark.createDataFrame([("e", 1, 1), ("e", 2, 1), ("e", 2, 2), ("e", 3, 3)], "entity string, unit int, rank int")
    known = spark.createDataFrame([("e", 1), ("e", 2), ("e", 3), ("f", 1)], "entity string, unit int")
    assert {r.entity: r.stop_rank for r in M.covering_prefix(edges, known, "entity", "unit", "rank").collect()} == {"e": 3, "f": None}
    urls = spark.createDataFrame([(0, "https://a.jp/1.pdf"), (1, "https://b.jp/o"), (2, "https://a.jp/p"), (3, "https://a.jp/2.pdf")], "pos int, url string")
    order = urls.orderBy(M.candidate_rank(F.col("url"), F.col("pos"), F.lit("a.jp"))).collect()
    assert [r.pos for r in order] == [3, 0, 2, 1]
    tries = spark.createDataFrame([("a", 2.0, 0, 0), ("a", 10.0, 1, 1), ("a", 20.0, 2, 2), ("b", 2.0, 0, 0)], "g string, s double, r int, p int")
    assert [tuple(r) for r in M.accepted_best(tries, "g", "s", "r", "p").collect()] == [("a", 10.0, 1, 1)]


def test_upsert(spark):
    schema = "a string, b string, v int"
    old = spark.createDataFrame([("x", None, 1), ("y", "1", 2)], schema)
    new = spark.createDataFrame([("x", None, 5), ("z", None, 7), ("z", None, 7)], schema)
    merged = S.upsert(old, new, ["a", "b"])
    assert sorted((r.a, r.v, r.action) for r in merged.collect()) == [("x", 5, "updated"), ("y", 2, "kept"), ("z", 7, "inserted")]
    again = S.upsert(merged.drop("action"), new, ["a", "b"])
    assert sorted((r.a, r.v) for r in again.collect()) == sorted((r.a, r.v) for r in merged.collect())


def test_upsert_tells_microseconds_apart(spark):
    import datetime

    at = lambda us: datetime.datetime(2024, 1, 1, 0, 0, 0, us)
    old = spark.createDataFrame([(at(123456), 1), (at(123999), 2)], "t timestamp, v int")
    new = spark.createDataFrame([(at(123456), 9)], "t timestamp, v int")
    assert sorted((r.v, r.action) for r in S.upsert(old, new, ["t"]).collect()) == [(2, "kept"), (9, "updated")]


def test_markdown_of_all_pages(spark):
    """Against a tree of nodes that is searched from its root, on all pages; unclosed elements end with their parent."""
    import html
    import re
    import urllib.parse

    void = set("area base br col embed hr img input link meta param source track wbr".split())

    def tree(page):
        root = ["", "", []]
        path = [root]
        at = 0
        raw = re.compile(r"(?is)(<script\b[^>]*>)(.*?)(</script\s*>)|(<style\b[^>]*>)(.*?)(</style\s*>)")
        page = raw.sub("", page)
        for m in re.finditer(r"(?s)<!--.*?-->|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", page):
            path[-1][2].append(html.unescape(page[at : m.start()]).strip())
            at, name = m.end(), (m[2] or "").lower()
            if name and m[1]:
                if name in [n[0] for n in path]:
                    while path.pop()[0] != name:
                        pass
            elif name:
                href = re.search(r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", m[3])
                node = [name, html.unescape(next((g for g in href.groups() if g), "")) if href else "", []]
                path[-1][2].append(node)
                if name not in void:
                    path.append(node)
        path[-1][2].append(html.unescape(page[at:]).strip())
        return root

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node[2] if isinstance(c, str) or c[0] not in cut)

    def lines(node, url):
        for c in node[2]:
            if isinstance(c, str) or c[0] in cut:
                continue
            if t := c[0] in {"h1", "h2", "h3", "h4", "p", "li", "a"} and text(c):
                if c[0] != "a":
                    yield "- " + t if c[0] == "li" else t if c[0] == "p" else "#" * int(c[0][1]) + " " + t
                elif c[1]:
                    yield f"[{t}]({urllib.parse.urljoin(url, c[1])})"
            yield from lines(c, url)

    cut = {"script", "style", "nav", "footer", "header", "aside", "iframe"}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.m for r in pages.select("page_id", W.html_to_markdown(F.col("html"), F.col("url")).alias("m")).collect()}
    assert len(got) == 250 and all(got[p.page_id] == "\n".join(lines(tree(p.html), p.url)) for p in pages.collect())


def test_sitemap_pages(spark):
    maps = spark.createDataFrame([("i.xml", "<loc>a.xml</loc><loc>b.xml</loc><loc>https://x/1</loc>"), ("a.xml", "<loc>https://x/2</loc><loc>i.xml</loc>"), ("b.xml", "<loc>https://x/2</loc>"), ("c.xml", "<loc>https://x/3</loc>")], "map string, body string")
    found = W.sitemap_pages(maps, spark.createDataFrame([("i.xml",)], "node string"), "map", "body")
    assert sorted((r["loc"], r.depth) for r in found.collect()) == [("https://x/1", 0), ("https://x/2", 1)]


def test_field_peers_against_all_pairs(spark):
    import itertools
    import random
    from collections import Counter, defaultdict

    rng = random.Random(2)
    rows = [(k, k % 5, rng.choice([0, rng.randint(1, 12)])) for k in range(60) for _ in range(6)]
    fields = defaultdict(set)
    for k, _, f in rows:
        fields[k].add(f)
    want = set()
    for k in fields:
        shared = Counter({p: len(fields[k] & fields[p]) for p in fields if p % 5 != k % 5 and fields[k] & fields[p]})
        want |= {(k, p, n) for p, n in itertools.islice(sorted(shared.items(), key=lambda x: (-x[1], x[0])), 8)}
    df = spark.createDataFrame(rows, "k int, e int, f int")
    for hot in (1000, 30, 12, 0):  # no field hot, one, some, all
        got = V.field_peers(df, "k", "e", "f", hot=hot).collect()
        assert {(r.profile, r.peer, r.shared) for r in got} == want and len(got) == len(want)
    pairs = {r.is_hot: (r.fields, r.pairs) for r in V.field_pairs(df, "k", "f", hot=30).collect()}
    n = Counter(f for own in fields.values() for f in own)
    assert pairs[True] == (sum(c > 30 for c in n.values()), sum(c * (c - 1) for c in n.values() if c > 30))


def test_pairs_of_peers_are_combined_before_they_shuffle(spark, monkeypatch):
    """20 profiles share 50 fields: what shuffles are pairs of profiles, not pairs of each field; small slices and bounds change nothing."""
    rows = spark.createDataFrame([(k, k % 2, f) for k in range(20) for f in range(50)], "profile int, of int, field int")
    for slice_, held in ((V.PAIR_SLICE, V.PAIRS_HELD), (3, 5)):
        monkeypatch.setattr(V, "PAIR_SLICE", slice_), monkeypatch.setattr(V, "PAIRS_HELD", held)
        got = V._pair_counts(rows)
        assert {tuple(r) for r in got.collect()} == {(a, b, 50) for a in range(20) for b in range(20) if (a - b) % 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_field_peers_with_a_field_of_all(spark):
    """Profiles with enough in common needn't meet through the field that all share; lonely ones do."""
    from collections import Counter

    rows = [(k, k % 3, f) for k in range(90) for f in ([0, 1] if k % 10 == 0 else [0, k % 4 + 2, k % 4 + 10, k % 4 + 20])]
    own = {k: {f for q, _, f in rows if q == k} for k in range(90)}
    want = set()
    for k in own:
        shared = Counter({p: len(own[k] & own[p]) for p in own if p % 3 != k % 3})
        want |= {(k, p, n) for p, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:8]}
    for hot in (1000, 40, 15):
        got = V.field_peers(spark.createDataFrame(rows, "k int, e int, f int"), "k", "e", "f", hot=hot).collect()
        assert {(r.profile, r.peer, r.shared) for r in got} == want


def test_pairs_of_peers_stay_off_the_disk(spark, monkeypatch):
    """20,000 rows whose fields have 980,000 pairs, few of them alike: what is shuffled grows with the rows. Without a shared folder the result is the same."""
    from pathlib import Path

    df = spark.createDataFrame([(k, k % 7, (k * (2 * n + 1) + 37 * n * n) % 400) for k in range(1000) for n in range(20)], "k int, e int, f int")
    shuffled = lambda: {f: f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = shuffled()
    got = sorted(map(tuple, V.field_peers(df, "k", "e", "f").collect()))
    assert len(got) == 8000 and sum(n for f, n in shuffled().items() if f not in before) < 2_000_000

    def no_folder(*_):
        raise ValueError

    monkeypatch.setattr(V, "work_path", no_folder)
    assert got == sorted(map(tuple, V.field_peers(df, "k", "e", "f").collect()))


def test_field_peers_with_several_entities(spark, monkeypatch):
    """A profile may have several entities, also at one field: a field counts once for a peer. Rows may repeat, keys may be texts, slices may be small."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(5)
    rows = [(f"k{rng.randint(0, 40)}", f"e{rng.randint(0, 2)}", f"f{rng.randint(0, 25)}") for _ in range(400)] * 2 + [("k1", None, "f1"), (None, "e1", "f1"), ("k2", "e1", None)]
    at = defaultdict(set)
    for k, e, f in rows:
        if None not in (k, e, f):
            at[f].add((k, e))
    shared = Counter(pair for f in at for pair in {(a, b) for a, x in at[f] for b, y in at[f] if x != y})
    want = set()
    for k in {a for a, _ in shared}:
        want |= {(k, p, n, i + 1) for i, (p, n) in enumerate(sorted(((b, n) for (a, b), n in shared.items() if a == k), key=lambda x: (-x[1], x[0]))[:8])}
    df = spark.createDataFrame(rows, "k string, e string, f string")
    for members, lists, held in ((V.MEMBERS, V.LISTS, V.SHARD_ROWS), (7, 5, 50)):
        monkeypatch.setattr(V, "MEMBERS", members), monkeypatch.setattr(V, "LISTS", lists), monkeypatch.setattr(V, "SHARD_ROWS", held)
        got = [tuple(r) for r in V.field_peers(df, "k", "e", "f", hot=10).collect()]
        assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in V._peers_by_pairs(df.dropna(), "k", "e", "f", 8, 10).collect()} == want
    assert not V.field_peers(df.where("k = 'none'"), "k", "e", "f").collect()


def test_long_names_meet_one_row_of_a_window(spark):
    """Numbered names hold the same letters; wanted in capitals, each may still meet no more than one row."""
    names = [f"Customer#{n:09}" for n in range(300)]
    dim = spark.createDataFrame([(n,) for n in names], "name string")
    asked = spark.createDataFrame([(n.upper(),) for n in names] + [("0012",), ("R#",)], "wanted string")
    got = V.exact_else_like(asked, dim, "name")
    assert {(r.wanted, r.name, r.exact) for r in got.collect()} == {(n.upper(), n, False) for n in names} | {("0012", names[12], False), ("R#", names[0], False)}
    assert "contains(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_exact_else_like_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + [None, "ab", "AB"]
    wanted = ["".join(rng.choice("abB ") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + [None, "", "zzz", "ab", "aba"]
    dim, asked = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int"), spark.createDataFrame([(w,) for w in wanted], "wanted string")
    want = {}
    for w in {w for w in wanted if w is not None}:
        hits = sorted((n != w, n) for n in names if n is not None and w.lower() in n.lower())
        if hits:
            want[w] = (hits[0][1], not hits[0][0])
    df = V.exact_else_like(asked, dim, "name")
    got = df.collect()
    assert len(got) == len(want) and {r.wanted: (r["name"], r.exact) for r in got} == want
    assert "on true" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_versions(spark):
    schema = "u string, c string, t int"
    old = spark.createDataFrame([("a", "x", 1)], schema)
    assert S.versioned_insert(old, spark.createDataFrame([("a", "x", 5)], schema), "u", "c", "t").select("first_seen", "last_seen").collect() == [(1, 5)]
    assert S.versioned_insert(old, spark.createDataFrame([("a", "y", 5)], schema), "u", "c", "t").count() == 2


def test_fusion_and_rerank(spark):
    ranking = lambda *ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    rows = R.fused([ranking("a", "b"), ranking("b", "c")]).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("b", pytest.approx(1 / 62 + 1 / 61)), ("a", pytest.approx(1 / 61)), ("c", pytest.approx(1 / 62))]
    hits = spark.createDataFrame([(1, c, 0.8, i + 1, t) for i, (c, t) in enumerate([("a", "k1 k2"), ("b", ""), ("c", ""), ("d", ""), ("e", ""), ("f", "")])], "query_id int, chunk_id string, score double, rank int, text string")
    words = F.array(*[F.lit(w) for w in ("k1", "k2", "k3")])
    assert R.boosted(hits, words, F.col("text")).where("chunk_id = 'a'").first().hybrid_score == 0.84
    two = F.array(F.lit("k1"), F.lit("zz"))
    top = R.reranked(hits, two, F.col("text"), "score").collect()
    assert len(top) == 5 and {r.chunk_id: r.rerank_score for r in top}["a"] == 0.71
    five = R.reranked(hits.where("rank <= 5"), two, F.col("text"), "score").orderBy("rank").collect()
    assert [r.chunk_id for r in five] == list("abcde") and all(r.rerank_score is None for r in five)


def test_web(spark):
    html = '<nav><a href="/n">n</a></nav><h2>T &amp; U</h2><p>one <b>two</b></p><ul><li><a href="x.pdf">doc</a></li></ul><script>var a="<p>no</p>"</script>'
    pages = spark.createDataFrame([(1, "https://a.jp/d/", html)], "page_id int, url string, html string")
    md = pages.select(W.html_to_markdown(F.col("html"), F.col("url")).alias("m")).first().m
    assert md == "## T & U\nonetwo\n- doc\n[doc](https://a.jp/d/x.pdf)"
    more = '<p>Look <a href="/x#y">here</a> now</p><div><a href=/y>Bare</a><a>none</a></div><li><p> in </p><b>side</b></li><p></p>'
    md = spark.createDataFrame([(more,)], "html string").select(W.html_to_markdown(F.col("html"), F.lit("https://a.jp/d/")).alias("m")).first().m
    assert md == "Lookherenow\n[here](https://a.jp/x#y)\n[Bare](https://a.jp/y)\n- inside\nin"
    links = W.page_links(pages)
    assert sorted((r.link_text, r.link_url) for r in links.collect()) == [("doc", "https://a.jp/d/x.pdf"), ("n", "https://a.jp/n")]
    assert W.best_link(links, "page_id", ".pdf", ("doc",)).first().score == 13
    maps = spark.createDataFrame([(1, "<urlset><url><loc> https://a/1 </loc></url><sitemap><loc>https://a/s.xml</loc></sitemap></urlset>"), (2, "https://b/1\nhttps://b/2"), (3, '<a href="https://c/1">x</a>')], "k int, body string")
    assert sorted((r.k, r.loc, r.is_sitemap) for r in W.sitemap_urls(maps, "k", "body").collect()) == [(1, "https://a/1", False), (1, "https://a/s.xml", True), (2, "https://b/1", False), (2, "https://b/2", False), (3, "https://c/1", False)]
    robots = spark.createDataFrame([(1, "User-agent: *\nSITEMAP: https://a/s.xml")], "k int, body string")
    assert W.robots_sitemaps(robots, "k", "body").first().sitemap_url == "https://a/s.xml"
    text = spark.createDataFrame([(1, "PDF: 要項 → https://a/x.pdf\nPDF: 要項 → https://a/x.pdf\n[t](https://a/y) https://a/z, https://b/w")], "k int, t string")
    assert [r.link_url for r in W.rendered_links(text, "k", "t", lambda a, b: F.lit(True)).collect()] == ["https://a/x.pdf"]
    assert sorted(r.link_url for r in W.bare_urls(text, "k", "t", F.lit("a")).collect()) == ["https://a/y", "https://a/z"]
    assert [r.link_url for r in W.markdown_links(text, "k", "t").collect()] == ["https://a/y"]


def test_reachable_many_levels(spark, monkeypatch):
    """A chain of twelve levels beside a circle and a node with very many edges; a level's plan doesn't grow, and doesn't shuffle the edges."""
    plans = []
    real = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    rows = [(f"c{n}", f"c{n + 1}", 0) for n in range(20)] + [("c20", "c0", 0), (None, "c1", 0), ("c1", None, 1)] + [("c2", f"leaf{n}", n + 1) for n in range(500)]
    edges = spark.createDataFrame(rows, "src string, dst string, pos int")
    got = {r.node: r.depth for r in W.reachable(edges, spark.createDataFrame([("c0",), ("c0",), (None,)], "node string"), 12).collect()}
    assert got == {f"c{n}": n for n in range(13)} | {f"leaf{n}": 3 for n in range(500)}
    levels = [p for p in plans if "Bucketed: true" in p and "LeftAnti" in p]
    assert len(levels) == 12 and len(levels[-1].splitlines()) == len(levels[1].splitlines())
    small = spark.createDataFrame([("a", "b", 0)], "src string, dst string, pos int")
    assert {r.node: r.depth for r in W.reachable(small, spark.createDataFrame([("a",)], "node string"), 12).collect()} == {"a": 0, "b": 1}
    assert W.reachable(small, spark.createDataFrame([], "node string"), 2).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith(("edges_", "visited_"))]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "d", 1), ("d", "e", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in W.reachable(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r.node for r in W.reachable(edges, seeds, 2, most=1).collect()} == {"a", "b", "c"}


def test_sites_and_search(spark):
    results = spark.createDataFrame([(1, "https://x.com/", 0), (1, "https://www.u.jp/", 1), (2, "https://y.com", 0)], "q int, url string, pos int")
    assert {r.q: r.site for r in W.own_site(results, "q", "url", "pos").collect()} == {1: "u.jp", 2: "y.com"}
    units = spark.createDataFrame([("A", "学部", f"u{i}", i) for i in range(4)], "entity string, kind string, name string, pos int")
    assert W.search_queries(units, "entity", "kind", "name", "pos", ["%s %s 募集", "%s %s 要項"]).first().queries == ["A u0 募集", "A u1 募集", "A u0 要項", "A u1 要項"]


def test_last_turns(spark):
    turns = spark.createDataFrame([(1, t, "system" if t == 4 else "user") for t in range(1, 9)], "c int, t int, role string")
    assert sorted(r.t for r in D.last_turns(turns, "c", "t", "role").collect()) == [3, 5, 6, 7, 8]


def test_states_and_merge(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string")
    counted = spark.createDataFrame([("a", 4, 4), ("b", 4, 1)], "k string, total long, covered_n long")
    assert {r.k: r.state for r in V.progress_states(listed, counted, "k").collect()} == {"a": "done", "b": "in progress", "c": "not started"}
    merged = V.ordered_merge([counted.select("k", F.lit("g").alias("g"), F.lit(0).alias("pos")), listed.select("k", F.lit("g").alias("g"), F.lit(1).alias("pos"))], "k", "pos", "g", 2)
    assert sorted((r.k, r.source_no) for r in merged.collect()) == [("a", 0), ("b", 0)]


def test_better_titles_keep_links(spark):
    """A URL with several titles gives no link twice; the longest fitting title counts."""
    links = spark.createDataFrame([(1, "u", "link"), (2, "u", None), (3, "v", "link"), (4, None, "link"), (5, "u", "a very long text of a link that says all")], "n int, link_url string, link_text string")
    titles = spark.createDataFrame([("u", "Guide"), ("u", "Microsoft Word - a much longer name"), ("u", "Guide of fees"), ("u", "Rules of fees"), ("v", "file_1"), ("v", None), (None, "Guide")], "link_url string, title string")
    got = sorted((r.n, r.link_text) for r in W.with_better_titles(links, titles).collect())
    assert got == [(1, "Guide of fees"), (2, "Guide of fees"), (3, "link"), (4, "link"), (5, "a very long text of a link that says all")]


def test_upgraded_link_texts_of_repeated_urls(spark, tmp_path):
    from sagebrook import plans

    spark.createDataFrame([(0, "u"), (1, "u"), (2, "u"), (3, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.link_url, r.link_text) for r in plans.queries()["upgraded_link_texts"](spark, str(tmp_path)).collect())
    assert got == [(0, "u", "募集要項 0"), (1, "u", "link"), (2, "u", "link"), (3, None, "募集要項 3")]


def test_candidates_are_not_broadcast(spark):
    """Spark takes exploded keys for as small as their file: the meeting of keys must shuffle."""
    df = spark.createDataFrame([("u", "ab"), ("u", "abc")], "block string, a string")
    plan = M.candidates(df, df.withColumnRenamed("a", "b"), ["block"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [block" in line]


def test_fuzzy_steps(spark):
    """Equal keys, near ones and far ones are found in steps; of units with the same sorted tokens the first counts."""
    known = spark.createDataFrame([("u", 1, 5, "t", "b\ta", None), ("u", 2, 3, "t", "a\tb", None), ("u", 3, 9, "t", "abcdefghijkl", None), ("u", 4, 1, "t", "vwxyz", None)], KNOWN)
    items = spark.createDataFrame([("u", n, 0, None, name, None, "high") for n, name in enumerate(["b\ta", "abcdefghijkl", "abcdefghijklm", "vwxy", "qqqq", None])], ITEMS)
    got = {r.input_pos: (r.unit_id, round(r.score, 1)) for r in M.fuzzy_matches(items, known).collect()}
    assert got == {0: (2, 100.0), 1: (3, 100.0), 2: (3, 96.0), 3: (4, 88.9)}


def test_sub_units_in_two_steps(spark, monkeypatch):
    """Only keys without a match of 90 meet the wide candidates."""
    met, real = [], M.candidates
    monkeypatch.setattr(M, "candidates", lambda asked, units, on, least, sql: met.append((least, {r.a for r in asked.collect()})) or real(asked, units, on, least, sql))
    known = spark.createDataFrame([("u", 1, 1, "t", "abcdefghijkl", "north"), ("u", 2, 2, "t", "vwxyz", "s")], KNOWN)
    items = spark.createDataFrame([("u", n, 0, "t", name, sub, "high") for n, (name, sub) in enumerate([("abcdefghijkl", "north"), ("abcdefghijk", "north"), ("vwxz", "s")])], ITEMS)
    got = {r.input_pos: (r.unit_id, round(r.score, 1)) for r in M.fuzzy_matches(items, known).collect()}
    assert got == {0: (1, 100.0), 1: (1, 97.1), 2: (2, 92.3)} and [m for m in met if m[1]] == [(90.0, {"abcdefghijk/north", "vwxz/s"})]


def test_one_off_keys_meet_no_candidates(spark, monkeypatch):
    """Of many keys those with a unit of one character more or less are answered by joins, with the results that candidates give, for both ratios."""
    import random

    draw = random.Random(7)
    words = lambda n: sorted({"".join(draw.choice("ab c") for _ in range(draw.randrange(1, 8))) for _ in range(n)} | {"部学ab", "ab"})
    known = spark.createDataFrame([("u", k, None if k == 4 else 50 - k, "st"[k % 2], w, "n") for k, w in enumerate(words(40))], KNOWN)
    items = spark.createDataFrame([("u", n, 0, "st"[n % 2], w, "n", "high") for n, w in enumerate(words(60) + ["部ab", "x" * 300, "x" * 299])], ITEMS)
    known = known.unionByName(spark.createDataFrame([("u", 90 + t, 90, "st"[t], "x" * 300, "n") for t in (0, 1)], KNOWN))
    rows = lambda sql, least: sorted(map(tuple, M.fuzzy_matches(items, known, sql=sql, least=least).collect()))
    want = {a: rows(*a) for a in ((False, 60.0), (True, 75.0))}
    monkeypatch.setattr(M, "FEW_KEYS", 0)
    assert {a: rows(*a) for a in want} == want
    met, real = set(), M.candidates
    monkeypatch.setattr(M, "candidates", lambda asked, units, on, least, sql: met.update(r.a for r in asked.collect()) or real(asked, units, on, least, sql))
    known = spark.createDataFrame([("u", 1, 1, "t", "abcdefghijkl", "north"), ("u", 2, 2, "t", "vwxyz", "s")], KNOWN)
    items = spark.createDataFrame([("u", n, 0, "t", name, "north", "high") for n, name in enumerate(["abcdefghijk", "abcdefghijklm", "abcdefghij"])], ITEMS)
    assert {r.input_pos: round(r.score, 1) for r in M.fuzzy_matches(items, known).collect()} == {0: 97.1, 1: 97.3, 2: 94.1} and met == {"abcdefghij/north"}


def test_resolved_meets_first_items_only(spark):
    """Of 2,000 items and 2,000 records of a name the pairs aren't made: a unit goes to the first item, of its type or without one."""
    known = spark.range(2000).selectExpr("'u' block", "cast(id as int) unit_id", "cast(id as int) pos", "if(id % 2 = 0, 's', 't') unit_type", "'abc' name", "cast(null as string) sub")
    items = spark.range(2000).selectExpr("'u' block", "cast(id as int) input_pos", "0 item_pos", "if(id < 5, 't', if(id < 7, null, 's')) unit_type", "'abc' name", "cast(null as string) sub", "'high' confidence")
    out = M.resolved(items, known)
    assert {tuple(r) for r in out.groupBy(F.col("unit_id") % 2, "input_pos", "method").count().collect()} == {(0, 5, "exact", 1000), (1, 0, "exact", 1000)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 4  # the items of a name are cut to the first before they meet records


def test_exact_matches_in_parts(spark, monkeypatch):
    """A name with many items and records: all pairs, each once, in many tasks."""
    monkeypatch.setattr(M, "SIDE", 7)
    monkeypatch.setattr(M, "PAIRS", 500)
    known = spark.range(60).selectExpr("if(id < 0, 'v', 'u') block", "cast(id as int) unit_id", "cast(id as int) pos", "if(id % 2 = 0, 's', 't') unit_type", "if(id < 50, 'abc', 'x') name", "cast(null as string) sub")
    items = spark.range(80).selectExpr("if(id < 0, 'v', 'u') block", "cast(id as int) input_pos", "0 item_pos", "if(id % 3 = 0, 't', null) unit_type", "if(id < 70, 'ａbc', 'x') name", "cast(null as string) sub", "'high' confidence")
    out = M.exact_matches(items, known, full=False)
    got = [(r.input_pos, r.unit_id) for r in out.collect()]
    want = {(i, k) for i in range(80) for k in range(60) if (i < 70) == (k < 50) and (i % 3 or k % 2)}
    assert len(got) == len(set(got)) and set(got) == want and out.rdd.getNumPartitions() >= 7


def test_bm25_in_tasks_and_by_pairs(spark, monkeypatch):
    """Scores from tasks are those of the shuffled pairs, also without hits, with null texts; only repeated ids need the pairs."""
    split = lambda c: F.split(c, " ")
    random = __import__("random").Random(3)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 30))) for _ in range(200)]
    chunks = spark.createDataFrame([*enumerate(texts), (200, None), (201, "")], "chunk_id int, text string").repartition(5)
    queries = spark.createDataFrame([(1, "a b b"), (2, "c zz"), (3, "zz"), (4, "h g f")], "query_id int, query string")
    calls, real = [], R._lexical
    monkeypatch.setattr(R, "_lexical", lambda *a: calls.append(1) or real(*a))
    ranked = lambda c: sorted(map(tuple, R.bm25_top_k(queries, c, 7, tokens=split).collect()))
    got = ranked(chunks)
    assert calls == [1] and len(got) == 28
    ranked(chunks.unionByName(chunks.limit(1)))
    monkeypatch.setattr(R, "CELLS", 0)
    assert ranked(chunks) == got and calls == [1]


def test_bm25_of_more_weights_than_a_driver_takes(spark, monkeypatch):
    """Each query keeps all its hits where its tokens are few, but the weights of all queries are more than are collected; so do fused and hybrid rankings."""
    split = lambda c: F.split(c, " ")
    chunks = spark.createDataFrame([(n, "abcdef"[n % 6] + " " + "abcdef"[n // 6 % 6] + " g") for n in range(40)], "chunk_id int, text string")
    queries = spark.createDataFrame([(n, f"a b {'cdef'[n % 4]}", [1.0, n / 3]) for n in range(9)], "query_id int, query string, vector array<double>")
    vectors = spark.createDataFrame([(n, [n / 5, 1.0]) for n in range(40)], "chunk_id int, vector array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())
    lexical = lambda: R.bm25_top_k(queries, chunks, 5, tokens=split)
    rankings = [lexical, lambda: R.fused([R.vector_top_k(queries, vectors, 5), lexical()]), lambda: R.hybrid_search(queries, chunks, 5, 5, tokens=split, vectors=vectors)]
    want = [rows(r()) for r in rankings]
    assert all({q for q, *_ in w} == set(range(9)) for w in want) and all(score > 0 for _, _, score, _ in want[0])
    monkeypatch.setattr(R, "BROADCAST_ROWS", 10)  # 6 tokens, 27 weights
    assert [rows(r()) for r in rankings] == want


def test_bm25_fills_up_with_different_chunks(spark):
    """Chunks whose id repeats more often than 2 k times don't take the places of others."""
    chunks = spark.createDataFrame([(1, "x")] * 10 + [(2, "y"), (3, "x"), (4, "y")], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "zz"), (2, "y")], "query_id int, query string")
    got = R.bm25_top_k(queries, chunks, 3, tokens=lambda c: F.split(c, " ")).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 2, 4), (2, 3, 1)]


def test_bm25_tokenises_a_chunk_once(spark):
    """Frequencies of the corpus and of the queries' tokens come from one pass."""
    chunks = spark.createDataFrame([(n, "a b" if n % 2 else "c d e") for n in range(40)], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "a c")], "query_id int, query string")
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        if len(text) != 3 or text != "a c":
            seen.add(1)
        return text.split(" ")

    got = R.bm25_top_k(queries, chunks, 3, tokens=F.udf(words, "array<string>").asNondeterministic()).collect()
    assert len(got) == 3 and seen.value == 40


def test_index_search_scores_in_tasks(spark, monkeypatch, tmp_path):
    """Postings are scored in tasks, not as pairs of query and chunk; the results are the same, with chunks over several splits and parts."""
    split = lambda c: F.split(c, " ")
    random = __import__("random").Random(5)
    chunks = spark.createDataFrame([(n, " ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 30)))) for n in range(150)], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "a b b"), (2, "c zz"), (3, "zz"), (4, "h g f")], "query_id int, query string")
    monkeypatch.setattr(R, "SPLIT", 40)
    R.index_chunks(chunks.where("chunk_id < 50"), f"{tmp_path}/i", tokens=split)
    R.index_chunks(chunks, f"{tmp_path}/i", tokens=split)
    calls, real = [], R._lexical
    monkeypatch.setattr(R, "_lexical", lambda *a: calls.append(1) or real(*a))
    ranked = lambda: sorted(map(tuple, R.bm25_search(queries, f"{tmp_path}/i", 7, tokens=split).collect()))
    got = ranked()
    assert calls == [1] and got == sorted(map(tuple, R.bm25_top_k(queries, chunks, 7, tokens=split).collect()))
    monkeypatch.setattr(R, "CELLS", 0)
    assert ranked() == got and calls == [1, 1]


def test_hybrid_search_with_vectors_of_their_own(spark, monkeypatch):
    """No text meets a vector; vectors without a chunk don't count."""
    split = lambda c: F.split(c, " ")
    texts = spark.createDataFrame([(n, f"word{n % 3} x{n}") for n in range(12)], "chunk_id int, text string")
    vectors = spark.createDataFrame([(n, [1.0, n / 7]) for n in range(2, 20)], "chunk_id int, vector array<double>")
    queries = spark.createDataFrame([(1, "word1 x4", [1.0, 0.5]), (2, "x7", [0.0, 1.0])], "query_id int, query string, vector array<double>")
    given, real = [], R.vector_top_k
    monkeypatch.setattr(R, "vector_top_k", lambda q, c, *a: given.append(c.columns) or real(q, c, *a))
    got = R.hybrid_search(queries, texts, tokens=split, vectors=vectors)
    want = R.hybrid_search(queries, texts.join(vectors, "chunk_id", "left"), tokens=split)
    columns = ["query_id", "chunk_id", "score", "rerank_score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and "text" not in given[0]


def test_document_chunks_take_one_python_pass(spark):
    """Sections and chunks of a document come from one worker, with Unicode's outer white space off."""
    from sagebrook.operators import docs as D

    texts = ["\u3000Title\n" + "body text. " * 20 + "\x85\u2003", "one\n\x1ctwo " + "x" * 90 + "\x1c", None, "", "\n\n", "A head\n" + "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    heading = lambda line: F.length(line) < 8
    got = D.document_chunks(df, "k", "t", heading)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.chunks(D.sections(df, "k", "t", heading), "k").collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
