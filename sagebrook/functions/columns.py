"""Scalar functions: each takes columns and returns a column, inside Spark's own expressions.

gives null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

_ANY_SPACE = r"(?U)\s+"


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def quoted(values: Sequence[str]) -> str:
    """One alternation that finds any of the strings, taken literally."""
    return "|".join(r"\Q" + v + r"\E" for v in values)


def contains_any(text: Column, values: Sequence[str]) -> Column:
    """Whether any of the strings occurs: a single regular expression instead of a test for each."""
    return text.rlike(quoted(values)) if values else F.lit(False)


def first_contained(text: Column, values: Sequence[str]) -> Column:
    """The first string of the list that occurs in the text, else null."""
    return F.get(F.filter(_list(values), lambda v: F.contains(text, v)), F.lit(0))


def all_contained(text: Column, values: Sequence[str]) -> Column:
    """Array of the strings of the list that occur, in list order."""
    return F.filter(_list(values), lambda v: F.contains(text, v))


#: Unicode's white space, as ``strip`` takes it; Python's own also takes \\x1c to \\x1f.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Outer white space off, Unicode's too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_cell(text: Column) -> Column:
    """zero-width characters off, white space runs to one blank, empty to null."""
    visible = F.regexp_replace(strip(text), "[\u200b\u200c\u200d\ufeff\u3000]", "")
    return F.nullif(strip(F.regexp_replace(visible, _ANY_SPACE, " ")), F.lit(""))


def clean_entity_name(name: Column) -> Column:
    """Latin text in brackets and a founder prefix off."""
    plain = strip(F.regexp_replace(name, r"[（(][A-Za-z0-9\s\-,.&]+[）)]", ""))
    return strip(F.regexp_replace(plain, r"(?U)^(国立|公立|私立)\s+", ""))


def fold_width(text: Column) -> Column:
    """Full-width ASCII to ASCII: the part of NFKC that SQL can express."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Full NFKC, for which Spark has no function; Arrow batches."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def match_key(text: Column, full: bool = True) -> Column:
    """normalised text without blanks and separators; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    if full:  # NFKC leaves ASCII as it is, so such texts don't travel
        normal = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    else:
        normal = fold_width(text)
    return F.translate(normal, " 　・･／", "")


def sorted_tokens(text: Column) -> Column:
    """The white-space tokens of a text in order, with one blank between them: what ``indel_ratio`` compares."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)[\s\x1C-\x1F]+"), lambda t: t != "")), " ")


def numbered_characters(text: Column) -> Column:
    """The characters of a text, each with how many of it came before, as one number: two texts share as many of these as characters, repeats included."""
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (a lambda's variable is evaluated once, not once a character)
    signs = lambda t: F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substr(t, i, F.lit(1))))
    return once(text, lambda t: once(signs(t), lambda s: F.transform(s, lambda c, i: F.ascii(c) * F.lit(1 << 32) + i - F.array_position(s, c))))


def composite_key(name: Column, sub: Column, full: bool = True) -> Column:
    """the unit's key, or unit/sub-unit."""
    sub_key = match_key(sub, full)
    return F.when(sub_key == "", match_key(name, full)).otherwise(F.concat_ws("/", match_key(name, full), sub_key))


def clean_title(text: Column) -> Column:
    """white space to blanks, CJK radicals and compatibility forms and control characters off."""
    blank = strip(F.regexp_replace(text, _ANY_SPACE, " "))
    return strip(F.regexp_replace(F.regexp_replace(blank, "[⺀-⻿⼀-⿟︰-﹏]", ""), r"[\x00-\x1f\x7f]", ""))


def prefecture(text: Column) -> Column:
    """the first prefecture of the official list that the text holds."""
    return first_contained(text, rules.PREFECTURES)


def title_of_text(text: Column, noise: str = r"^[\d\s\-–—.・]+$", least: int = 4, enough: int = 15, most: int = 80) -> Column:
    """of the first five lines that aren't noise, those with ``least`` characters until ``enough`` are together; three at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), clean_title), lambda x: (x != "") & ~x.rlike(noise))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"))

    def step(acc, line):
        take = (F.length(line) >= least) & (acc["n"] < enough)
        return F.struct(
            F.when(take, F.array_append(acc["parts"], line)).otherwise(acc["parts"]).alias("parts"),
            F.when(take, acc["n"] + F.length(line)).otherwise(acc["n"]).alias("n"),
        )

    parts = F.aggregate(F.slice(lines, 1, 5), start, step, lambda acc: acc["parts"])
    return strip(F.substring(F.array_join(F.slice(parts, 1, 3), " "), 1, most))


def better_title(new: Column, old: Column) -> Column:
    """whether a document's title says more than the link text."""
    old = F.coalesce(old, F.lit(""))
    office = new.startswith("Microsoft Word") | new.startswith("Microsoft Excel")
    file_name = new.rlike(r"^[A-Za-z0-9_\-]+$") & (F.length(new) < 30)
    short = (F.length(new) < F.length(old) * 0.5) & (F.length(old) > 10)
    words = new.rlike("[぀-鿿]") | new.rlike("[A-Za-z]{4,}")
    return F.coalesce((new != "") & ~office & ~file_name & ~short & words, F.lit(False))


def content_hash(text: Column) -> Column:
    """F8: SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def page_key(url: Column) -> Column:
    """F8, S3: MD5 of the URL."""
    return F.md5(url)


def host(url: Column) -> Column:
    """lower-case host without a leading ``www.``; null if the URL has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def registrable_domain(host_name: Column) -> Column:
    """the last two labels, three under a second-level label such as ``ac``."""
    parts = F.split(host_name, r"\.")
    n = F.size(parts)
    long = (n >= 3) & F.get(parts, n - 2).isin(*rules.SECOND_LEVEL)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(long, 2).otherwise(1)), 3), ".")


def _encoded(text: Column, safe: str) -> Column:
    """Percent-encoded UTF-8 but for letters, digits, ``_.-~`` and ``safe``."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for letter in sorted(safe.replace("%", "")):
        out = F.replace(out, F.lit(f"%{ord(letter):02X}"), F.lit(letter))
    return F.replace(out, F.lit("%25"), F.lit("%")) if "%" in safe else out  # last, so that what was encoded stays


def safe_url(url: Column) -> Column:
    """path and query percent-encoded but for ``/%:@`` and ``=&%:@/?``; scheme, host and fragment as they are."""
    pattern = r"(?s)^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    url = strip(url)
    part = lambda k: F.regexp_extract(url, pattern, k)
    after = lambda mark, text: F.when(text == "", text).otherwise(F.concat(F.lit(mark), text))
    return F.concat(F.lower(part(1)), part(2), _encoded(part(3), "/%:@"), after("?", _encoded(part(4), "=&%:@/?")), after("#", part(5)))


def absolute_url(href: Column, base: Column, fragment: bool = False) -> Column:
    """``href`` seen from page ``base``, without its fragment unless ``fragment`` is set."""
    plain = F.regexp_replace(href, "#.*$", "")
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    site = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/(?:.*/)?)[^/]*$", "$1")
    folder = F.when(folder.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    whole = (
        F.when(plain.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), plain)
        .when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain))
        .when(plain.startswith("/"), F.concat(site, plain))
        .when(plain == "", F.regexp_replace(base, "#.*$", ""))
        .when(plain.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), plain))
        .otherwise(F.concat(folder, plain))
    )
    return F.concat(whole, F.regexp_extract(href, "(#.+)$", 1)) if fragment else whole


def normal_year(raw: Column) -> Column:
    """notations of an era year to one; what isn't known stays. Null and empty give empty.

    Digits of any script count as digits, but only ASCII years have an era; none is rewritten.
    """
    year = strip(F.coalesce(raw, F.lit("")))

    def era(digits: Column) -> Column:
        n = F.when(digits.rlike("^[0-9]+$"), digits).try_cast("int") - 2018
        return F.when(n == 1, F.lit("令和元年度")).when(n.between(2, 12), F.concat(F.lit("令和"), n.cast("string"), F.lit("年度"))).otherwise(year)

    western = r"(?U)^(\d{4})年(?:度|\d+月入学)$"
    return (
        F.when(year.rlike(r"(?U)^(令和|平成)\d+年度$"), year)
        .when(year.rlike(western), era(F.regexp_extract(year, western, 1)))
        .when(year.rlike(r"(?U)^[Rr]\d{1,2}(年度)?$"), F.concat(F.lit("令和"), F.regexp_extract(year, r"(?U)(\d+)", 1), F.lit("年度")))
        .when(year.rlike(r"(?U)^令和\d+年度[（(].*[）)]"), F.regexp_extract(year, r"(?U)^(令和\d+年度)", 1))
        .when(year.rlike(r"(?U)^令和\d+$"), F.concat(year, F.lit("年度")))
        .otherwise(year)
    )


def year_of_json(document: Column) -> Column:
    """the year named at the top level of a JSON object, else in its first nested unit; unknown ones are skipped."""
    known = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "不明", "unknown"), c)
    paths = ("$.academic_year", "$.year", "$.nendo", "$.covered_units[0].academic_year", "$.covered_units[0].year")
    return F.coalesce(*[known(F.get_json_object(document, p)) for p in paths])


def outdated_year(year: Column) -> Column:
    """Heisei, Reiwa up to 6, and any ``YYYY年度`` but 2026 and 2027. Null and empty are not outdated."""
    reiwa = F.regexp_extract(year, "^令和([0-9]+)年度", 1).try_cast("int")
    western = year.rlike("^[0-9]{4}年度$") & ~year.isin("2026年度", "2027年度")
    return F.coalesce(year.startswith("平成") | (year == "令和元年度") | western | F.coalesce(reiwa <= 6, F.lit(False)), F.lit(False))


def scope_of_text(text: Column, given: Column | None = None) -> Column:
    """undergraduate, graduate or combined by two patterns; a given value wins."""
    under, grad = text.rlike(rules.UNDERGRADUATE_PATTERN), text.rlike(rules.GRADUATE_PATTERN)
    found = F.when(grad & ~under, F.lit("graduate")).when(under & ~grad, F.lit("undergraduate")).otherwise("combined")
    return found if given is None else F.coalesce(given, found)


def doc_type(text: Column, has_units: Column, types: Mapping[str, Sequence[str]] = rules.DOC_TYPES) -> Column:
    """the first type with a keyword in the lower-cased text; the default depends on nested units."""
    text = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for name, words in types.items():
        out = out.when(contains_any(text, words), F.lit(name))
    return out.otherwise(F.when(has_units, F.lit(rules.DOC_TYPE_WITH_UNITS)).otherwise(rules.DOC_TYPE_OTHER))


def tags_of(text: Column, tags: Mapping[str, Sequence[str]] = rules.EXAM_TAGS) -> Column:
    """F16: array of all tags with a keyword in the text, in table order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(tag)) for tag, words in tags.items()]))


def chunk_tags(types: Column, text: Column, by_type: Mapping[str, Sequence[str]] = rules.CHUNK_TYPE_TAGS, by_text: Mapping[str, Sequence[str]] = rules.CHUNK_TEXT_TAGS) -> Column:
    """sorted tags of the nested types, or those of the text if the types give none."""

    def has(words: Sequence[str]) -> Column:
        return F.coalesce(F.exists(types, lambda t: t.rlike(quoted(words))), F.lit(False))

    nested = F.array_sort(F.array_compact(F.array(*[F.when(has(words), F.lit(tag)) for tag, words in by_type.items()])))
    return F.when(F.size(nested) > 0, nested).otherwise(tags_of(text, by_text))


def likely_scan(n_units: Column, notes: Column, representation: Column, char_count: Column) -> Column:
    """nothing extracted and little text."""
    empty = (F.coalesce(n_units, F.lit(0)) == 0) & (F.coalesce(notes, F.lit("")) == "") & (F.length(F.coalesce(representation, F.lit(""))) < 100)
    return empty | (F.coalesce(char_count, F.lit(0)) < 500)


def recovered_json(text: Column) -> Column:
    """the outermost object of a model's answer: thoughts and fences off, trailing commas too; null if it doesn't parse."""
    plain = F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    body = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(body).isNotNull(), body)


def indel_score(x: str, y: str) -> float:
    """F20 of two strings: 200 x longest common subsequence / total length, of their sorted tokens; 100 for two empty ones."""
    x, y = (" ".join(sorted(t.split())) for t in (x, y))
    if not x and not y:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    row = 0
    for c in y:  # bit-parallel rows of the table
        both = where.get(c, 0) | row
        row = both & (both ^ (both - (row << 1 | 1)))
    return 200.0 * row.bit_count() / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel_score`` in Arrow batches; null if either is."""
    return pd.Series([None if x is None or y is None else indel_score(x, y) for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """F20 for SQL: 100 x (1 - Levenshtein distance / longer length)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(F.lit(100.0) * (longer - F.levenshtein(a, b)) / longer)


def match_confidence(score: Column, given: Column) -> Column:
    """confidence of a match by its score and the input's own confidence."""
    return (
        F.when(score >= 90, F.when(given == "high", F.lit("high")).otherwise("medium"))
        .when(score >= 75, F.when(F.coalesce(given, F.lit("")) != "low", F.lit("medium")).otherwise("low"))
        .otherwise("low")
    )


def query_keywords(query: Column, year_pattern: str = rules.QUERY_YEAR_PATTERN, words: Sequence[str] = rules.QUERY_EXAM_WORDS, topics: Sequence[str] = rules.QUERY_TOPIC_WORDS) -> Column:
    """years, then exam words, then topic words of the query."""
    return F.concat(F.regexp_extract_all(query, F.lit(f"({year_pattern})"), 1), all_contained(query, words), all_contained(query, topics))


def query_terms(query: Column) -> Column:
    """runs of two or more kanji or kana, or of three or more Latin letters."""
    return F.regexp_extract_all(query, F.lit("([一-鿿぀-ヿ]{2,}|[a-zA-Z]{3,})"), 1)


def bigram_tokens(text: Column) -> Column:
    """overlapping character pairs, then white-space tokens; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.coalesce(pairs, F.array().cast("array<string>")), words)


def position_of(text: Column, titles: Sequence[str]) -> Column:
    """the longest title that the text holds."""
    return first_contained(text, sorted(titles, key=len, reverse=True))


def suffix_token(text: Column, suffix: str) -> Column:
    """the first token up to the last such suffix in it; empty if none."""
    return F.regexp_extract(text, rf"(?U)(\S+\Q{suffix}\E)", 1)


def split_fields(lines: Column, most: int = 10) -> Column:
    """slash-separated parts of 2 to 39 characters, distinct, at most ``most``."""
    parts = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("/"))), lambda x: F.transform(F.split(x, "/"), strip)))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p).between(2, 39))), 1, most)


def join_present(separator: str, *parts: Column) -> Column:
    """what is neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def capacity_sum(values: Column) -> Column:
    """sum over the values that are digits only."""
    numbers = F.transform(F.filter(values, lambda v: v.rlike("^[0-9]+$")), lambda v: v.cast("long"))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def first_present(values: Column) -> Column:
    """the first that is neither null nor empty."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def owner_url_score(url: Column, domain: Column, exclude: Sequence[str] = rules.SCORE_EXCLUDE, words: Sequence[str] = rules.SCORE_KEYWORDS, suffix: str = ".ac.jp") -> Column:
    """10 for the owner's domain, 5 for a keyword, 3 for the suffix, 2 for four slashes; 0 if excluded."""
    points = (
        F.when(F.contains(url, domain), 10).otherwise(0) + F.when(contains_any(F.lower(url), words), 5).otherwise(0)
        + F.when(F.contains(url, F.lit(suffix)), 3).otherwise(0) + F.when(F.regexp_count(url, F.lit("/")) >= 4, 2).otherwise(0)
    )
    return F.when(url.rlike("(?i)" + "|".join(exclude)), 0).otherwise(points)


def length_tier(text: Column) -> Column:
    """SHORT up to 15,000 characters, MEDIUM up to 60,000, else LONG."""
    return F.when(F.length(text) <= 15_000, "SHORT").when(F.length(text) <= 60_000, "MEDIUM").otherwise("LONG")
