"""Column functions over every document, each of which takes one of the function's cases.

A query gives each row of ``documents`` the case with its number modulo the number of cases; its SQL
takes what the rule says of that case from a list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import coverage as V
from ..operators import filters as P
from .registry import query, table


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, given: list, want: list[str | None], apply) -> None:
    """Registers ``name``: ``apply`` of the case's column, or columns if a case is a tuple, as text."""
    rows = [g if isinstance(g, tuple) else (g,) for g in given]

    def run(spark, d):
        at = (F.col("doc_id") % len(rows)).cast("int")
        columns = [F.get(F.array(*[F.lit(r[k]).cast("string") for r in rows]), at) for k in range(len(rows[0]))]
        return table(spark, d, "documents").select("doc_id", apply(*columns).cast("string").alias("result"))

    run.__name__ = name
    query(f"SELECT doc_id, ([{', '.join(map(_sql, want))}])[doc_id % {len(want)} + 1] AS result FROM documents")(run)


def bar(values: Column) -> Column:
    return F.array_join(values, "|")


cases("normal_years", ["2025年度", "2026年10月入学", "R7", "r8年度", "R07", "令和8年度（2026年度）", "令和7", "平成27年度", "令和元年度", "不明", "2040年度", "平成２９年度", "２０２５年度", "２０４０年度", None],
      ["令和7年度", "令和8年度", "令和7年度", "令和8年度", "令和07年度", "令和8年度", "令和7年度", "平成27年度", "令和元年度", "不明", "2040年度", "平成２９年度", "２０２５年度", "２０４０年度", ""], C.normal_year)
cases("outdated_years", ["平成27年度", "令和6年度", "令和元年度", "2023年度", "2026年度", "2028年度", "令和7年度", ""], ["true", "true", "true", "true", "false", "true", "false", "false"], C.outdated_year)
cases("safe_urls", ["https://a.jp/募集 要項*.pdf?q=a+b,c;d&e=%2F#章 1", "http://a.jp/%E5%8B%9F:@,;+", " https://a.jp/~x/%25 "],
      ["https://a.jp/%E5%8B%9F%E9%9B%86%20%E8%A6%81%E9%A0%85%2A.pdf?q=a%2Bb%2Cc%3Bd&e=%2F#章 1", "http://a.jp/%E5%8B%9F:@%2C%3B%2B", "https://a.jp/~x/%25"], C.safe_url)
cases("page_links_by_suffix", ["https://a.jp/x.pptx", "https://a.jp/x.PDF?y", "https://a.jp/x.ppt", "https://b.jp/x", "https://a.jp/p#q", "https://a.jp/x"],
      ["false", "false", "true", "false", "false", "true"], lambda u: P.page_link(u, F.lit("https://a.jp/p"), F.lit("a.jp")))
cases("headings", ["第1章 総則", "第１章 総則", "第2節 出願", "(1) 日程", "（２）日程", "1. 概要", "1.2 概要", "■ 日程", "【注意】", "〔別表〕", "本文である", "章 1"],
      ["true"] * 10 + ["false"] * 2, lambda x: x.rlike("(?U)" + "|".join(rules.HEADING_PATTERNS)))
cases("entity_names", ["国立 東京大学 (The University)", "京都大学", "公立 大阪（Osaka Univ.）", "私立大学"], ["東京大学", "京都大学", "大阪", "私立大学"], C.clean_entity_name)
cases("prefectures", ["〒 東京都文京区", "大阪府と京都府", "外国", "北海道札幌市"], ["東京都", "京都府", None, "北海道"], C.prefecture)
cases("better_titles", [("Microsoft Word - x", "a"), ("file_name", "a"), ("募集要項", "こちら"), ("短い", "とても長いリンクのテキスト"), ("", "x"), ("Guide to it", "")],
      ["false", "false", "true", "false", "false", "true"], C.better_title)
cases("json_years", ['{"academic_year": "不明", "year": "R7"}', '{"covered_units": [{"academic_year": "令和8年度"}]}', "{}", "bad"], ["R7", "令和8年度", None, None], C.year_of_json)
cases("chunk_tag_sets", [("後期,推薦", "社会人"), ("他", "社会人"), ("", "編入と留学生"), ("AO", "")], ["一般選抜|学校推薦型選抜", "社会人入試", "外国人留学生|編入学", "総合型選抜"],
      lambda types, text: bar(C.chunk_tags(F.split(types, ","), text)))
cases("exam_tag_sets", ["AO入試と留学生", "x", "前期日程", "大学院修士"], ["総合型選抜|外国人留学生", "", "一般選抜|前期日程", "大学院"], lambda x: bar(C.tags_of(x)))
cases("document_types", ["Syllabus handbook", "学生募集要項", "選抜要項", "x"], ["学生便覧", "募集要項", "選抜要項", "その他"], lambda x: C.doc_type(x, F.lit(False)))
cases("likely_scans", [("0", "", "x", "499"), ("0", "備考", "x", "900"), ("1", "", "", "900"), ("0", "", "", "900")], ["true", "false", "false", "true"],
      lambda n, notes, text, chars: C.likely_scan(n.cast("int"), notes, text, chars.cast("int")))
cases("query_keyword_lists", ["令和8年度の一般選抜の定員", "2026年度と平成30年度", "配点と総合型"], ["令和8年度|一般選抜|定員", "2026年度|平成30年度", "総合型|配点"], lambda q: bar(C.query_keywords(q)))
cases("bigram_token_lists", ["ab c", "", "募集要項"], ["ab|b | c|ab|c", "", "募集|集要|要項|募集要項"], lambda q: bar(C.bigram_tokens(q)))
cases("position_titles", ["特任准教授 工学", "准教授", "教授", "学生"], ["特任准教授", "准教授", "教授", None], lambda x: C.position_of(x, ("教授", "准教授", "特任准教授")))
cases("suffix_tokens", ["東京大学 工学系研究科 機械", "理学部", "情報学研究科附属 x"], ["工学系研究科", "", "情報学研究科"], lambda x: C.suffix_token(x, "研究科"))
cases("field_lists", ["情報通信 / 計算機\nなし\nものづくり / 機械 / 機械", "a/b", "ab/cd"], ["情報通信|計算機|ものづくり|機械", "", "ab|cd"], lambda x: bar(C.split_fields(F.split(x, "\n"))))
cases("composite_keys", [("情報・工学 部", "機械 科"), ("工学部", ""), ("Ａ学部", None)], ["情報工学部/機械科", "工学部", "A学部"], lambda a, b: C.composite_key(a, b, full=False))
cases("capacities", ["12,若干名,30", "", "5", "x,y"], ["42", "0", "5", "0"], lambda x: C.capacity_sum(F.split(x, ",")))
cases("first_periods", [",,4月,5月", "3月", ","], ["4月", "3月", None], lambda x: C.first_present(F.split(x, ",")))
cases("profile_urls", ["https://x.u-tokyo.ac.jp/lab", "https://researchmap.jp/u-tokyo.ac.jp", "https://y.jp/", "https://u-tokyo.ac.jp/NEWS/1", None], ["true", "false", "false", "false", "false"],
      lambda u: P.own_profile_url(u, F.lit("u-tokyo.ac.jp")))
cases("usable_pages", [("a,b,c,d,e", "title"), ("a,b,c,d", "title"), ("a,403 Forbidden,c,d,e", "t"), ("a,b,c,d,e", "researchmap"), ("a,b,c,d,e", None)], ["true", "false", "false", "false", "false"],
      lambda lines, title: P.usable_page(F.split(lines, ","), title))
cases("shaped_names", [("学部", "工学部"), ("学部", "機械"), ("研究科", "理学研究科"), ("その他", "x")], ["true", "false", "true", "true"],
      lambda kind, name: P.shaped_name(kind, name, {"学部": ("学部", "学群"), "研究科": ("研究科", "学府")}))
cases("noise_names", ["計", "1,234", "注1", " ", "工学部"], ["true", "true", "true", "true", "false"], P.noise_name)
cases("registrable_domains", ["naist.jp", "a.b.tohoku.ac.jp", "x.y.example.com", "com"], ["naist.jp", "tohoku.ac.jp", "example.com", "com"], C.registrable_domain)
cases("tag_unions", [("b,a", "c,a"), ("", "x"), ("z", "")], ["a|b|c", "|x", "|z"], lambda a, b: bar(V.tag_union(F.split(a, ","), F.split(b, ","))))
cases("match_confidences", [("90", "high"), ("89.9", "high"), ("75", "high"), ("75", "low"), ("74.9", "high"), ("95", "low")], ["high", "medium", "medium", "low", "low", "medium"],
      lambda score, given: C.match_confidence(score.cast("double"), given))
