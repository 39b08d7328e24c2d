"""Rule cascades, routing and filters. Rules are column expressions; verdicts come with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def _reason(prefix: str, found: Column) -> Column:
    return F.when(found.isNotNull(), F.concat(F.lit(prefix), found))


def exclusion_reason(
    url: Column, text: Column, has_units: Column, *, hosts: Sequence[str] = rules.EXCLUDED_HOSTS, statistics_host: str = rules.STATISTICS_HOST,
    statistics: Sequence[str] = rules.STATISTICS_PATTERNS, url_patterns: Sequence[str] = rules.URL_PATTERNS, strong_url: Sequence[str] = rules.STRONG_URL_PATTERNS,
    content: Sequence[str] = rules.CONTENT_KEYWORDS, strong_content: Sequence[str] = rules.STRONG_CONTENT_KEYWORDS,
) -> Column:
    """Why a document is excluded, null if it isn't; the first rule that holds names its pattern.

    Rules: an excluded host, a statistics page, a URL pattern, a content keyword
    (in text and URL). With nested units only the strong patterns and
    keywords count. Null URL and text count as empty.
    """
    url, text = F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))
    own_host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    strong_u = [p for p in url_patterns if p in strong_url]
    strong_c = [k for k in content if k in strong_content]
    low, whole = F.lower(url), F.concat_ws(" ", text, url)
    return F.coalesce(
        _reason(rules.REASONS["host"], C.first_contained(own_host, hosts)),
        F.when(F.contains(url, F.lit(statistics_host)), _reason(rules.REASONS["statistics"], C.first_contained(url, statistics))),
        F.when(~has_units, _reason(rules.REASONS["url"], C.first_contained(low, url_patterns))).otherwise(
            _reason(rules.REASONS["url_strong"], C.first_contained(low, strong_u))
        ),
        F.when(~has_units, _reason(rules.REASONS["content"], C.first_contained(whole, content))).otherwise(
            _reason(rules.REASONS["content_strong"], C.first_contained(whole, strong_c))
        ),
    )


def excluded_keyword(url: Column, exclude: Sequence[str] = rules.CANDIDATE_EXCLUDE) -> Column:
    """The first exclusion keyword in the lower-cased URL, else null."""
    return C.first_contained(F.lower(F.coalesce(url, F.lit(""))), exclude)


def routed(url: Column, exclude: Sequence[str] = rules.CANDIDATE_EXCLUDE, positive: Sequence[str] = rules.CANDIDATE_POSITIVE, suffix: str = ".pdf") -> Column:
    """Exclude, keep (keyword), keep (suffix) or undecided."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(C.contains_any(low, exclude), "exclude").when(C.contains_any(low, positive), "keep_keyword")
        .when(F.contains(low, F.lit(suffix)), "keep_document").otherwise("undecided")
    )


def prefiltered(df: DataFrame, group: str, text: Column, keywords: Sequence[str] = rules.PREFILTER_KEYWORDS, least: int = 10) -> DataFrame:
    """Rows with a keyword, or all rows of a group that has fewer than ``least`` such rows."""
    hit = C.contains_any(F.lower(F.coalesce(text, F.lit(""))), keywords)
    return df.withColumn("_hit", hit).withColumn("_hits", F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(group))).where(
        F.col("_hit") | (F.col("_hits") < least)
    ).drop("_hit", "_hits")


def relevant_link(text: Column, url: Column, exclude: Sequence[str] = rules.LINK_TEXT_EXCLUDE, positive: Sequence[str] = rules.LINK_TEXT_POSITIVE, url_positive: Sequence[str] = rules.LINK_URL_POSITIVE) -> Column:
    """P5: not excluded by its text, and kept by its text or by its lower-cased URL."""
    text, url = F.coalesce(text, F.lit("")), F.coalesce(url, F.lit(""))
    return ~C.contains_any(text, exclude) & (C.contains_any(text, positive) | C.contains_any(F.lower(url), url_positive))


def document_url(url: Column, how: str = "path", suffix: str = ".pdf") -> Column:
    """(anywhere) the suffix's letters anywhere, (path) the part before ``?`` ends in it, (file) before ``?`` or ``#``."""
    low = F.lower(url)
    if how == "anywhere":
        return F.contains(low, F.lit(suffix.lstrip(".")))
    return F.regexp_replace(low, r"\?.*$" if how == "path" else "[?#].*$", "").endswith(suffix)


def same_site(url: Column, domain: Column) -> Column:
    """The URL's host holds the domain."""
    return F.contains(C.host(url), domain)


def page_link(url: Column, page: Column, domain: Column, suffixes: Sequence[str] = rules.BINARY_SUFFIXES) -> Column:
    """A page of the same site, neither a file nor the page itself; fragments don't count."""
    plain = F.regexp_replace(url, "#.*$", "")
    binary = F.lower(F.regexp_replace(plain, r"\?.*$", "")).rlike("(" + C.quoted(suffixes) + ")$")
    return same_site(plain, domain) & ~binary & (plain != F.regexp_replace(page, "#.*$", ""))


def metadata_filter(df: DataFrame, *, entity: tuple[str, str] | None = None, year: tuple[str, str] | None = None, unit: tuple[str, str] | None = None,
                    scopes: tuple[str, Sequence[str]] | None = None, limit: int | None = 500) -> DataFrame:
    """Equal entity and year, unit name contained in any case, scope in a list; each a (column, value) or None."""
    for pair in (entity, year):
        if pair:
            df = df.where(F.col(pair[0]) == F.lit(pair[1]))
    if unit:
        df = df.where(F.contains(F.lower(unit[0]), F.lit(unit[1].lower())))
    if scopes:
        df = df.where(F.col(scopes[0]).isin(*scopes[1]))
    return df if limit is None else df.limit(limit)


def noise_name(name: Column, names: Sequence[str] = rules.NOISE_NAMES, prefixes: Sequence[str] = rules.NOISE_PREFIXES) -> Column:
    """Totals, headers, numbers, notes, and what is empty or null."""
    text = C.strip(F.coalesce(name, F.lit("")))
    prefix = F.lit(False)
    for p in prefixes:
        prefix = prefix | text.startswith(p)
    return (text == "") | text.isin(*names) | text.rlike("^[0-9,.]+$") | prefix


def consistent_owner(claimed: Column, owner: Column, least: float = 80.0, sql: bool = False) -> Column:
    """The claimed name is like the owner's; a missing claim passes. ``sql`` takes the edit ratio instead of the Indel ratio."""
    score = C.edit_ratio(claimed, owner) if sql else C.indel_ratio(claimed, owner)
    return claimed.isNull() | (claimed == "") | (score >= least)


def own_profile_url(url: Column, domain: Column, exclude: Sequence[str] = rules.PROFILE_EXCLUDE) -> Column:
    """A URL in the owner's domain that no exclusion pattern finds; null is no such URL."""
    return F.coalesce(F.contains(url, domain) & ~url.rlike("(?i)" + "|".join(exclude)), F.lit(False))


def unfilled(df: DataFrame, column: str, name: str, without: str) -> DataFrame:
    """Rows with a null column whose name doesn't hold a word, in any case."""
    return df.where(F.col(column).isNull() & ~F.contains(F.lower(name), F.lit(without.lower())))


def usable_page(lines: Column, title: Column, placeholders: Sequence[str] = ("", "研究者検索", "researchmap"), least: int = 5) -> Column:
    """No error page, enough lines, and a title of its own."""
    body = F.array_join(lines, "\n")
    return ~F.contains(body, F.lit("403 Forbidden")) & (F.size(lines) >= least) & ~F.coalesce(title, F.lit("")).isin(*placeholders)


def shaped_name(unit_type: Column, name: Column, suffixes: dict[str, Sequence[str]]) -> Column:
    """The name holds a suffix of its type; types without suffixes pass."""
    out = F.when(F.lit(False), F.lit(True))
    for kind, values in suffixes.items():
        out = out.when(unit_type == kind, C.contains_any(name, values))
    return F.coalesce(out.otherwise(F.lit(True)), F.lit(False))


def chunkable(df: DataFrame, types: Sequence[str], doc_type: str = "doc_type", excluded: str = "is_excluded", text: str = "text", least: int = 80) -> DataFrame:
    """Kept documents of these types with enough text."""
    return df.where(F.col(doc_type).isin(*types) & (F.coalesce(F.col(excluded), F.lit(False)) == F.lit(False)) & (F.length(text) >= least))


def status_label(covered: Column, total: Column) -> Column:
    """Complete, partial or none."""
    return F.when((total > 0) & (covered == total), "complete").when(covered > 0, "partial").otherwise("none")


def uncovered(df: DataFrame, column: str, target: object) -> DataFrame:
    """Null or another value than the target."""
    return df.where(~F.col(column).eqNullSafe(F.lit(target)))
