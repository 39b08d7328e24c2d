"""Links, sitemaps and reachability over a table of pages (url, html)."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .common import first_per_key, top_per_key, work_path

_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a\s*>"""
#: Entities of HTML that texts commonly hold.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for name, letter in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def plain(html: Column) -> Column:
    """Text without tags, entities resolved, white space to blanks."""
    return C.strip(F.regexp_replace(unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


#: Elements whose content is no text of the page, those that make a line, and those without an end.
FURNITURE = frozenset(("script", "style", "nav", "footer", "header", "aside", "iframe"))
LINES = frozenset(("h1", "h2", "h3", "h4", "p", "li", "a"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Outline(HTMLParser):
    """Lines of one page. Open elements lie on a stack; an end tag closes all above the last element of its name."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.lines, self.stack, self.text = url, [], [], ""
        self.hidden = 0

    def _text(self) -> None:
        piece, self.text = self.text.strip(), ""
        if piece and not self.hidden:
            for _, line in self.stack:
                if line is not None:
                    line[2].append(piece)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._text()
        line = None
        if tag in LINES and not self.hidden:
            line = (tag, dict(reversed(attrs)).get("href") or "", [])
            self.lines.append(line)
        if tag not in VOID:
            self.stack.append((tag, line))
            self.hidden += tag in FURNITURE

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._text()
        if any(name == tag for name, _ in self.stack):
            while (name := self.stack.pop()[0]) is not None:
                self.hidden -= name in FURNITURE
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.text += data

    def handle_comment(self, data: str) -> None:
        self._text()

    def markdown(self) -> str:
        self._text()
        out = []
        for tag, href, pieces in self.lines:
            text = "".join(pieces)
            if text and tag != "a":
                out.append("- " + text if tag == "li" else text if tag == "p" else "#" * int(tag[1]) + " " + text)
            elif text and href:
                try:
                    out.append(f"[{text}]({urljoin(self.url, href)})")
                except ValueError:  # no URL at all
                    out.append(f"[{text}]({href})")
        return "\n".join(out)


#: Pages of a batch that a task holds as texts at a time.
SLICE = 64


@F.arrow_udf(T.StringType())
def html_to_markdown(html: pa.Array, url: pa.Array) -> pa.Array:
    """H1: headings, paragraphs, list items and links as lines, in the order in which they begin; scripts, styles and page furniture cut out first.

    An element inside another gives a line of its own; a link's line is ``[text](absolute URL)``, its text that
    of all pieces between tags, each without outer white space. Elements nest as the mark-up says, and unclosed ones
    end with what they stand in; regular expressions can't follow that, so pages are parsed, in slices of Arrow batches. Null stays null.
    """

    def one(page: str | None, at: str | None) -> str | None:
        if page is None:
            return None
        outline = _Outline(at or "")
        outline.feed(page)
        outline.close()
        return outline.markdown()

    slices = ((html.slice(at, SLICE).to_pylist(), url.slice(at, SLICE).to_pylist()) for at in range(0, len(html), SLICE))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(one, h, u), pa.string()) for h, u in slices)])


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """H2: (key, page_url, pos, link_text, link_url): links of the page's HTML, absolute, the first of each URL."""
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), 2).alias("text")
    )
    rows = pages.select(key, F.col(url).alias("page_url"), F.posexplode(both).alias("pos", "a"))
    rows = rows.select(key, "page_url", "pos", plain(F.col("a.text")).alias("link_text"), C.absolute_url(C.strip(unescaped(F.col("a.href"))), F.col("page_url")).alias("link_url"))
    return first_per_key(rows.where(F.col("link_url").rlike("^https?://")), [key, "link_url"], F.col("pos"))


def markdown_links(texts: DataFrame, key: str, text: str) -> DataFrame:
    """H2: (key, pos, link_text, link_url): ``[text](url)`` links, the first of each URL."""
    pattern = r"\[([^\]]*)\]\((https?://[^)]+)\)"
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), 1).alias("t"), F.regexp_extract_all(F.col(text), F.lit(pattern), 2).alias("u"))
    rows = texts.select(key, F.posexplode(both).alias("pos", "a")).select(key, "pos", C.strip(F.col("a.t")).alias("link_text"), C.strip(F.col("a.u")).alias("link_url"))
    return first_per_key(rows, [key, "link_url"], F.col("pos"))


def document_links(links: DataFrame, is_document: Column, relevant: Column) -> DataFrame:
    """H3: links that are documents and relevant, with their source page."""
    return links.where(is_document & relevant)


def likely_documents(links: DataFrame, key: str, word: str = "pdf", most: int = 10) -> DataFrame:
    """H4: links with the word in URL or text, at most ``most`` for each page, in order."""
    hit = F.contains(F.lower("link_url"), F.lit(word)) | F.contains(F.lower("link_text"), F.lit(word))
    return top_per_key(links.where(hit), [key], most, F.col("pos"))


def best_link(links: DataFrame, key: str, suffix: str, keywords: Sequence[str]) -> DataFrame:
    """The best link of each page: 10 for the suffix, 3 for each keyword in text or URL; ties in document order."""
    both = F.concat_ws(" ", F.lower("link_text"), F.lower("link_url"))
    score = F.when(F.lower("link_url").endswith(suffix), 10).otherwise(0)
    for word in keywords:
        score = score + F.when(F.contains(both, F.lit(word)), 3).otherwise(0)
    return first_per_key(links.withColumn("score", score).where("score > 0"), [key], F.desc("score"), F.col("pos"))


def sitemap_urls(sitemaps: DataFrame, key: str, body: str, most: int = 3000) -> DataFrame:
    """H5: (key, pos, loc, is_sitemap): locations of a sitemap in XML, plain lines of a text one, links of an HTML one."""
    xml = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), 1)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), C.strip), lambda x: x.rlike("^https?://\\S+$"))
    links = F.filter(F.regexp_extract_all(F.col(body), F.lit(_ANCHOR), 1), lambda x: x.rlike("^https?://"))
    found = F.when(F.size(xml) > 0, xml).when(F.size(lines) > 0, lines).otherwise(links)
    return sitemaps.select(key, F.posexplode(F.slice(found, 1, most)).alias("pos", "loc")).withColumn("is_sitemap", F.lower("loc").rlike(r"\.xml(\.gz)?$"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """H6, H8: (node, depth): what is reached from ``seeds`` (node) over ``edges`` (src, dst, pos), each node once.

    Edges and visited nodes are stored once, in buckets by node, so that a level shuffles only its new nodes: it joins the last level's nodes with the
    edges where they lie, takes out what was visited before, and is added as one more partition. A level's plan is as small at the twelfth
    as at the first. Levels end early when nothing is new. ``most`` keeps the first children of a node, in order of ``pos``. The tables'
    names are dropped at the end, their files stay in the shared folder; all levels run when this is called.
    """
    spark = edges.sparkSession
    if most is not None:
        edges = top_per_key(edges, ["src"], most, F.col("pos"), F.col("dst"))
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), work_path(spark, "reach")
    known, visited = (f"{name}_{path.rsplit('-', 1)[1]}" for name in ("edges", "visited"))

    def add(level: DataFrame, number: int) -> None:
        rows = level.withColumn("depth", F.lit(number)).repartition(buckets, "node")
        rows.write.mode("append").partitionBy("depth").bucketBy(buckets, "node").option("path", f"{path}/visited").saveAsTable(visited)

    try:
        edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").repartition(buckets, "src").write.bucketBy(buckets, "src").option("path", f"{path}/edges").saveAsTable(known)
        add(seeds.select("node").where("node IS NOT NULL").distinct(), 0)
        for level in range(1, depth + 1):
            before = spark.table(visited)
            last = before.where(F.col("depth") == level - 1)
            if last.isEmpty():
                break
            step = last.join(spark.table(known), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            add(step.join(before.select("node"), "node", "left_anti"), level)
        kind = spark.table(visited).schema["node"].dataType.simpleString()
    finally:
        for name in (known, visited):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.schema(f"node {kind}, depth int").parquet(f"{path}/visited")


def sitemap_pages(sitemaps: DataFrame, seeds: DataFrame, key: str, body: str, depth: int = 5, most: int = 3000) -> DataFrame:
    """H6: (loc, depth): page URLs of the ``seeds`` (node) and of all sitemaps that they and their children name.

    ``sitemaps`` has a row for each fetched sitemap: its URL and its body. A sitemap is opened once.
    """
    found = sitemap_urls(sitemaps, key, body, most)
    indexes = found.where("is_sitemap").select(F.col(key).alias("src"), F.col("loc").alias("dst"), "pos")
    opened = reachable(indexes, seeds, depth).select(F.col("node").alias(key), "depth")
    return found.where(~F.col("is_sitemap")).join(opened, key).groupBy("loc").agg(F.min("depth").alias("depth"))


def robots_sitemaps(robots: DataFrame, key: str, body: str) -> DataFrame:
    """H7: the URLs of ``Sitemap:`` lines."""
    lines = robots.select(key, F.explode(F.split(body, r"\r?\n")).alias("line")).where(F.col("line").rlike("(?i)^sitemap:"))
    return lines.select(key, C.strip(F.regexp_replace("line", "(?i)^sitemap:", "")).alias("sitemap_url"))


def own_site(results: DataFrame, by: str, url: str, pos: str, preferred: str = r"\.jp$") -> DataFrame:
    """H9: the first result's host of a preferred kind, else the first host."""
    rows = results.withColumn("_host", C.host(F.col(url))).where("_host <> ''")
    return rows.groupBy(by).agg(F.coalesce(F.min_by("_host", F.when(F.col("_host").rlike(preferred), F.col(pos))), F.min_by("_host", pos)).alias("site"))


def with_better_titles(links: DataFrame, titles: DataFrame, url: str = "link_url", text: str = "link_text") -> DataFrame:
    """The document's title instead of the link text where it says more; every link once.

    Of several titles of a URL (or of another key that both tables have) the longest one counts that could be better than any text, on a tie the first.
    """
    fit = titles.where(C.better_title(F.col("title"), F.lit(""))).groupBy(url).agg(F.min_by("title", F.struct(-F.length("title"), "title")).alias("_title"))
    better = C.better_title(F.col("_title"), F.col(text))
    return links.join(fit, url, "left").withColumn(text, F.when(better, F.col("_title")).otherwise(F.col(text))).drop("_title")


def first_spreadsheet(links: DataFrame, key: str) -> DataFrame:
    """The first spreadsheet link of each page."""
    return first_per_key(links.where(F.col("link_url").rlike("(?i)[.]xlsx?$")), [key], F.col("pos"))


def rendered_links(texts: DataFrame, key: str, text: str, relevant) -> DataFrame:
    """Lines ``PDF: text → url`` as rows, relevant ones, the first of each URL."""
    pattern = "^\\s*PDF:\\s*(.*?)\\s*→\\s*(\\S+)"
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    rows = rows.select(key, "pos", F.regexp_extract("line", pattern, 1).alias("link_text"), F.regexp_extract("line", pattern, 2).alias("link_url"))
    return first_per_key(rows.where(relevant(F.col("link_text"), F.col("link_url"))), [key, "link_url"], F.col("pos"))


def bare_urls(texts: DataFrame, key: str, text: str, domain: Column, suffix: str = ".pdf") -> DataFrame:
    """URLs in a text that lie on the site and are no documents, without punctuation at their end."""
    rows = texts.select(key, domain.alias("_domain"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(https?://[^\s\])>\"']+)"), 1)).alias("pos", "u"))
    rows = rows.withColumn("link_url", F.regexp_replace("u", "[.,)]+$", ""))
    own = F.contains(C.host(F.col("link_url")), F.col("_domain")) & ~F.contains(F.lower("link_url"), F.lit(suffix))
    return first_per_key(rows.where(own), [key, "link_url"], F.col("pos")).select(key, "pos", "link_url")


def search_queries(units: DataFrame, entity: str, unit_type: str, name: str, pos: str, templates: Sequence[str], per_type: int = 2, most: int = 5) -> DataFrame:
    """F32: (entity, queries): templates with the entity and its first units of each type, distinct, at most ``most``."""
    top = top_per_key(units, [entity, unit_type], per_type, F.col(pos), F.col(name))
    names = top.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(name).alias("n")))), lambda x: x["n"]).alias("names"))

    def filled(template: str) -> Column:
        return F.transform("names", lambda n: F.format_string(template, F.col(entity), n))

    made = [filled(t) for t in templates]
    return names.select(entity, F.slice(F.array_distinct(F.flatten(F.array(*made))), 1, most).alias("queries"))
