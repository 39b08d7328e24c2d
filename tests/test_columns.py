"""Column functions and rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from sagebrook.functions import columns as C
from sagebrook.functions import rules
from sagebrook.operators import filters as P


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_year(spark):
    given = ["2025年度", "2026年10月入学", "R7", "r8年度", "R07", "令和8年度（2026年度）", "令和7", "平成27年度", "令和元年度", "不明", "2040年度", "2019年度", "令和７年度", "平成２９年度", "２０４０年度", "２０２５年度", "", None]
    want = ["令和7年度", "令和8年度", "令和7年度", "令和8年度", "令和07年度", "令和8年度", "令和7年度", "平成27年度", "令和元年度", "不明", "2040年度", "令和元年度", "令和７年度", "平成２９年度", "２０４０年度", "２０２５年度", "", ""]
    assert each(spark, given, C.normal_year) == want


def test_outdated_year(spark):
    given = ["平成27年度", "令和6年度", "令和元年度", "2023年度", "2026年度", "2028年度", "令和7年度", "", None]
    assert each(spark, given, C.outdated_year) == [True, True, True, True, False, True, False, False, False]


def test_exclusion(spark):
    reason = lambda units: (lambda url: P.exclusion_reason(url, F.lit(""), F.lit(units)))
    assert each(spark, ["https://www.benesse.ne.jp/x"], reason(True)) == ["除外ドメイン: benesse.ne.jp"]
    assert each(spark, ["https://a.jp/result", "https://a.jp/result/seiseki", "https://a.jp/x", None], reason(True)) == [None, "合格発表・成績URL（covered_unitsあり）: seiseki", None, None]
    assert each(spark, ["https://a.jp/result"], reason(False)) == ["非募集要項URLパターン（covered_units無し）: result"]
    assert each(spark, ["https://mext.go.jp/shinro"], reason(True)) == ["文科省統計ページ: shinro"]
    content = lambda text: P.exclusion_reason(F.lit("https://a.jp/"), text, F.lit(False))
    assert each(spark, ["シラバス 2025", "募集"], content) == ["非募集要項キーワード（covered_units無し）: シラバス", None]


def test_routing(spark):
    urls = [f"https://a.jp/{p}" for p in ("syllabus/boshu.pdf", "boshu/", "x.pdf", "about")]
    assert each(spark, urls, P.routed) == ["exclude", "keep_keyword", "keep_document", "undecided"]


@pytest.mark.parametrize("hits, kept", [(9, 100), (10, 10)])
def test_prefilter(spark, hits, kept):
    rows = spark.createDataFrame([("s", f"boshu{i}" if i < hits else f"x{i}") for i in range(100)], "site string, url string")
    assert P.prefiltered(rows, "site", F.col("url")).count() == kept


def test_match_keys(spark):
    assert each(spark, ["情報・工学 部", "情報工学部", "ｶﾞｸﾌﾞ", None], C.match_key) == ["情報工学部", "情報工学部", "ガクブ", ""]
    assert each(spark, ["Ａ 学部"], lambda x: C.composite_key(x, F.lit("機械 科"))) == ["A学部/機械科"]


def test_scope(spark):
    assert each(spark, ["工学部", "研究科", "学部と修士", "なし"], C.scope_of_text) == ["undergraduate", "graduate", "combined", "combined"]


def test_hosts(spark):
    assert each(spark, ["https://www.naist.jp/a", "http://a.b.tohoku.ac.jp:80/?q", "x"], C.host) == ["naist.jp", "a.b.tohoku.ac.jp", ""]
    assert each(spark, ["naist.jp", "a.b.tohoku.ac.jp", "x.y.example.com", "com"], C.registrable_domain) == ["naist.jp", "tohoku.ac.jp", "example.com", "com"]


def test_absolute_url(spark):
    base = "https://a.jp/d/e.html?q=1#f"
    given = ["http://b.jp/x#y", "/r", "s/t", "//c.jp/z", "?p=2", "#top", "mailto:a@b"]
    want = ["http://b.jp/x", "https://a.jp/r", "https://a.jp/d/s/t", "https://c.jp/z", "https://a.jp/d/e.html?p=2", "https://a.jp/d/e.html?q=1", "mailto:a@b"]
    assert each(spark, given, lambda x: C.absolute_url(x, F.lit(base))) == want
    assert each(spark, ["x"], lambda x: C.absolute_url(x, F.lit("https://a.jp"))) == ["https://a.jp/x"]


def test_json_recovery(spark):
    fenced = '<think>{"a": 0}</think>\n```json\n{"a": [1, 2,], "b": {"c": 3,},}\n```'
    assert each(spark, [fenced], lambda x: F.get_json_object(C.recovered_json(x), "$.b.c")) == ["3"]
    assert each(spark, ["no json", "{broken", None], C.recovered_json) == [None, None, None]


def test_year_of_json(spark):
    given = ['{"academic_year": "不明", "year": "R7"}', '{"covered_units": [{"academic_year": "令和8年度"}]}', "{}", "bad"]
    assert each(spark, given, C.year_of_json) == ["R7", "令和8年度", None, None]


def test_similarity(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("工学部", "工学部"), ("", ""), ("a b", "b a"), (None, "x")], "a string, b string")
    got = [r.s for r in rows.select(C.indel_ratio("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(200 * 2 / 6) and got[1:4] == [100.0, 100.0, 100.0]
    assert got[4] is None or got[4] != got[4]


def test_indel_ratio_equals_the_table(spark):
    import random

    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(200)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(C.indel_ratio("a", "b").alias("s")).collect()]
    assert got == pytest.approx([200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in pairs])


def test_confidence(spark):
    rows = spark.createDataFrame([(90.0, "high"), (89.9, "high"), (75.0, "high"), (75.0, "low"), (74.9, "high"), (95.0, "low")], "s double, c string")
    assert [r.x for r in rows.select(C.match_confidence(F.col("s"), F.col("c")).alias("x")).collect()] == ["high", "medium", "medium", "low", "low", "medium"]


def test_tags_and_types(spark):
    assert each(spark, ["AO入試と留学生", "x"], lambda x: F.array_join(C.tags_of(x), ",")) == ["総合型選抜,外国人留学生", ""]
    assert each(spark, ["Syllabus handbook", "x"], lambda x: C.doc_type(x, F.lit(False))) == ["学生便覧", "その他"]
    assert each(spark, ["社会人"], lambda x: F.array_join(C.chunk_tags(F.array(F.lit("後期"), F.lit("推薦")), x), ",")) == ["一般選抜,学校推薦型選抜"]
    assert each(spark, ["社会人"], lambda x: F.array_join(C.chunk_tags(F.array(F.lit("他")), x), ",")) == ["社会人入試"]


def test_owner_score(spark):
    urls = ["https://x.u-tokyo.ac.jp/lab/a/", "https://researchmap.jp/a"]
    assert each(spark, urls, lambda u: C.owner_url_score(u, F.lit("u-tokyo.ac.jp"))) == [20, 0]


def test_noise_and_cells(spark):
    assert each(spark, ["計", "1,234", "注1", " ", None, "工学部"], P.noise_name) == [True, True, True, True, True, False]
    assert each(spark, ["​ a　 b ", "  ", None], C.clean_cell) == ["a b", None, None]
    assert each(spark, ["国立 東京大学 (The University)"], C.clean_entity_name) == ["東京大学"]
    assert each(spark, ["〒 東京都文京区", "x"], C.prefecture) == ["東京都", None] and len(rules.PREFECTURES) == 47


def test_queries_words(spark):
    assert each(spark, ["令和8年度の一般選抜の定員"], lambda q: F.array_join(C.query_keywords(q), ",")) == ["令和8年度,一般選抜,定員"]
    assert each(spark, ["出願 abc de 期間"], lambda q: F.array_join(C.query_terms(q), ",")) == ["出願,abc,期間"]
    assert each(spark, ["ab c", "", None], lambda q: F.array_join(C.bigram_tokens(q), "|")) == ["ab|b | c|ab|c", "", ""]


def test_titles(spark):
    assert each(spark, ["1\n令和8年度\n学生募集要項について\nx", ""], C.title_of_text) == ["令和8年度 学生募集要項について", ""]
    rows = spark.createDataFrame([("Microsoft Word - x", "a"), ("file_name", "a"), ("募集要項", "こちら"), ("短い", "とても長いリンクのテキスト"), ("", "x"), (None, "x")], "n string, o string")
    assert [r.b for r in rows.select(C.better_title(F.col("n"), F.col("o")).alias("b")).collect()] == [False, False, True, False, False, False]


def test_safe_url(spark):
    given = ["https://a.jp/募集 要項*.pdf?q=a+b,c;d&e=%2F#章 1", "http://a.jp/%E5%8B%9F:@,;+?", " HTTPS://a.jp/~x/%25 "]
    want = [
        "https://a.jp/%E5%8B%9F%E9%9B%86%20%E8%A6%81%E9%A0%85%2A.pdf?q=a%2Bb%2Cc%3Bd&e=%2F#章 1", "http://a.jp/%E5%8B%9F:@%2C%3B%2B", "https://a.jp/~x/%25",
    ]
    assert each(spark, given, C.safe_url) == want


def test_page_link(spark):
    urls = ["https://a.jp/x.pptx", "https://a.jp/x.PDF?y", "https://a.jp/x.ppt", "https://b.jp/x", "https://a.jp/p#q", "https://a.jp/x"]
    assert each(spark, urls, lambda u: P.page_link(u, F.lit("https://a.jp/p"), F.lit("a.jp"))) == [False, False, True, False, False, True]


def test_scans_and_numbers(spark):
    rows = spark.createDataFrame([(0, "", "x", 499), (0, None, "x" * 100, 900), (1, "", "", 900), (0, "", "", 900)], "n int, notes string, text string, chars int")
    assert [r.s for r in rows.select(C.likely_scan(F.col("n"), F.col("notes"), F.col("text"), F.col("chars")).alias("s")).collect()] == [True, False, False, True]
    values = F.array(F.lit("12"), F.lit("若干名"), F.lit(None), F.lit("30"))
    assert each(spark, ["x"], lambda x: C.capacity_sum(values)) == [42] and each(spark, ["x"], lambda x: C.first_present(F.array(F.lit(None), F.lit(""), x))) == ["x"]
