"""Documents to sections, chunks and records; spreadsheet grids to records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from .common import first_per_key

PAGE_MARKER = "^--- Page ([0-9]+) ---"
CHUNK_MOST, CHUNK_LEAST = 900, 80


def default_heading(line: Column) -> Column:
    """Whether a line has the shape of a heading."""
    stripped = C.strip(line)
    return stripped.rlike("(?U)" + "|".join(rules.HEADING_PATTERNS)) & (F.length(stripped) > 2)


def split_sections(text: str, headings: Sequence[bool | None]) -> list[tuple[int, str | None, str, int]]:
    """Sections (number, heading, content, page) of one document, of which ``headings`` says the heading lines."""
    out: list[tuple[int, str | None, str, int]] = []
    body: list[str] = []
    title, page = None, 1
    number = 0
    for line, is_heading in zip(text.split("\n"), headings):
        if marker := re.match(PAGE_MARKER, line):
            page = int(marker[1]) if int(marker[1]) < 2**31 else page
        elif is_heading and body:
            out.append((number, title, "\n".join(body), page))
            number, title, body = number + 1, line, []
        else:
            body.append(line)
    return [*out, (number, title, "\n".join(body), page)]


_PART = pa.struct([("section_no", pa.int64()), ("heading", pa.string()), ("content", pa.string()), ("page_number", pa.int32())])


def _lines(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column]) -> DataFrame:
    """(key, text, headings): which lines of each text are headings."""
    return docs.where(F.col(text).isNotNull()).select(key, text, F.transform(F.split(text, "\n"), heading).alias("headings"))


def _parts(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column]) -> DataFrame:
    """(key, parts): the sections of each text as one array, blank ones too. No shuffle: a text's lines lie in one row.

    The heading rule is evaluated by Spark; the fold over the lines is a small helper in Arrow batches.
    """
    rows = _lines(docs, key, text, heading)
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # long texts: few rows at a time
                part = batch.slice(at, 64)
                found = [split_sections(t.as_py(), h.as_py()) for t, h in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_PART))], [key, "parts"])

    return rows.mapInArrow(work, f"`{key}` {kind}, parts array<struct<section_no: bigint, heading: string, content: string, page_number: int>>")


def sections(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column] = default_heading, first: str = rules.FIRST_HEADING) -> DataFrame:
    """(key, section_no, heading, content, page_number); each row of ``docs`` is a document of its own.

    A heading line starts a section if some line came since the last start; so
    in a run of heading lines every other one does, from the first on, or from
    the second if the run begins the document. Page markers are no lines; a
    section's page is the one at its end. Sections without visible text go; null
    texts have none. Nothing shuffles. ``heading`` is a condition on a line.
    """
    part = _parts(docs, key, text, heading).select(key, F.explode("parts").alias("p"))
    return part.select(
        key, "p.section_no", F.coalesce(C.strip(F.col("p.heading")), F.lit(first)).alias("heading"), C.strip(F.col("p.content")).alias("content"), "p.page_number"
    ).where("content <> ''")


def forced_parts(text: str, most: int = CHUNK_MOST, ends: Sequence[str] = rules.SENTENCE_ENDS) -> list[str]:
    """D3: parts of at most ``most`` characters, cut after the last sentence end in the upper half of each window."""
    parts: list[str] = []
    while len(text) > most:
        cut = max(text.rfind(e, most // 2 + 1, most) for e in ends) + 1
        head, text = text[: cut or most].strip(), text[cut or most :].strip()
        parts.append(head)
    return [p for p in (*parts, text) if p]


class _Packer:
    """Fills a buffer up to ``most`` characters and cuts what is flushed; the separator isn't counted."""

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.text, self.place = "", ("", 1)
        self.out: list[tuple[str, str, int]] = []

    def flush(self) -> None:
        if len(self.text) >= self.least:
            self.out += [(p, *self.place) for p in forced_parts(self.text.strip(), self.most) if len(p) >= self.least]
        self.text = ""

    def add(self, piece: str, place: tuple[str, int]) -> None:
        """Joins ``piece`` to the buffer or starts a new one with it."""
        if len(self.text) + len(piece) <= self.most:
            if not self.place[0]:
                self.place = place
            self.text += ("\n\n" if self.text else "") + piece
        else:
            self.flush()
            self.text, self.place = piece, place


def packed_sections(parts: Sequence[tuple[str, str, int]], most: int = CHUNK_MOST, least: int = CHUNK_LEAST, first: str = rules.FIRST_HEADING) -> list[tuple[str, str, int]]:
    """Chunks (text, section, page) from sections (heading, content, page) of one document.

    Sections join while they fit; one that is too long goes by paragraphs. What
    is shorter than ``least`` when its buffer is flushed is dropped.
    """
    packer = _Packer(most, least)
    for heading, content, page in parts:
        text = content if heading == first else f"{heading}\n{content}"
        if len(packer.text) + len(text) <= most or len(text) <= most:
            packer.add(text, (heading, page))
            continue
        packer.flush()
        packer.place = (heading, page)
        for paragraph in re.split(r"\n{2,}", text):
            packer.add(paragraph, (heading, page))
    packer.flush()
    return packer.out


def chunks(sectioned: DataFrame, key: str, most: int = CHUNK_MOST, least: int = CHUNK_LEAST) -> DataFrame:
    """(key, chunk_index, chunk_text, section_path, page_number) from a table of sections, which shuffles by document."""
    part = F.struct("section_no", "heading", "content", "page_number")
    return _packed(sectioned.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts")), key, most, least, lambda parts: [(p["heading"], p["content"], p["page_number"]) for p in parts])


def document_chunks(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column] = default_heading, most: int = CHUNK_MOST, least: int = CHUNK_LEAST,
                    first: str = rules.FIRST_HEADING) -> DataFrame:
    """``chunks`` of ``sections`` without a shuffle, in one Python pass; each row of ``docs`` is a document of its own."""

    def parts(text: str, headings: Sequence[bool | None]) -> list[tuple[str, str, int]]:
        found = [(first if title is None else title.strip(C.SPACES), body.strip(C.SPACES), page) for _, title, body, page in split_sections(text, headings)]
        return [p for p in found if p[1]]

    return _packed(_lines(docs, key, text, heading), key, most, least, parts)


def _packed(rows: DataFrame, key: str, most: int, least: int, parts_of: Callable[..., list[tuple[str, str, int]]]) -> DataFrame:
    """Chunks of rows (key, values ...), of which ``parts_of`` makes the sections; the fold is a small helper in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [
                    (k, i, *c)
                    for k, *values in zip(*(c.to_pylist() for c in part.columns))
                    for i, c in enumerate(packed_sections(parts_of(*values), most, least))
                ]
                columns = list(zip(*found)) if found else [()] * 5
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "chunk_index", "chunk_text", "section_path", "page_number"])

    return rows.mapInArrow(work, f"`{key}` {kind}, chunk_index int, chunk_text string, section_path string, page_number int")


#: The part of a structured record that the context needs.
STRUCTURED = ("exam_types array<struct<type string, target string, application_period struct<start string, `end` string, notes string>, exam_date string, "
              "result_date string, enrollment_deadline string, capacity string, qualification string, notes string>>")


def context_line(entity: Column, unit: Column, year: Column, scope: Column, kind: Column, types: Column | None, labels: Mapping[str, str] = rules.SCOPE_LABELS) -> Column:
    """A document's context: its description, then types, capacity, first period and first date where there are any."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    base = C.join_present(" | ", entity, unit, year, F.element_at(names, F.coalesce(scope, F.lit(""))), kind)
    types = F.from_json(F.lit("[]"), STRUCTURED.removeprefix("exam_types ")) if types is None else types
    present = F.filter(F.transform(types, lambda t: t["type"]), lambda t: t.isNotNull() & (t != ""))
    total = C.capacity_sum(F.transform(types, lambda t: F.coalesce(t["capacity"].cast("string"), F.lit(""))))
    periods = F.transform(types, lambda t: F.concat_ws(" ~ ", F.nullif(t["application_period"]["start"], F.lit("")), F.nullif(t["application_period"]["end"], F.lit(""))))
    period, date = C.first_present(periods), C.first_present(F.transform(types, lambda t: t["exam_date"]))
    return F.concat_ws(
        "\n", F.concat(F.lit("["), base, F.lit("]")),
        F.when(F.size(present) > 0, F.concat(F.lit("[入試方式: "), F.array_join(F.slice(present, 1, 5), " / "), F.lit("]"))),
        F.when(total > 0, F.concat(F.lit("[定員合計: "), total.cast("string"), F.lit("名]"))),
        F.when(period.isNotNull(), F.concat(F.lit("[出願期間: "), period, F.lit("]"))),
        F.when(date.isNotNull(), F.concat(F.lit("[試験日: "), date, F.lit("]"))),
    )


def enriched_chunks(chunked: DataFrame, docs: DataFrame, key: str, context: Column, doc_tags: Column, unit: Column) -> DataFrame:
    """Chunks with their document's context before the text, tags of document and chunk, and the unit's name."""
    own = docs.select(key, context.alias("chunk_context"), doc_tags.alias("_doc_tags"), unit.alias("unit_name"))
    return chunked.join(own, key).withColumns({
        "chunk_text_with_context": C.join_present("\n", F.col("chunk_context"), F.col("chunk_text")),
        "exam_types": F.array_sort(F.array_union("_doc_tags", C.tags_of(F.col("chunk_text"), rules.CHUNK_TEXT_TAGS))),
    }).drop("_doc_tags")


def split_pages(docs: DataFrame, key: str, text: str, marker: str = r"--- Page ([0-9]+) ---") -> DataFrame:
    """(key, page_number, page_text) by markers; page 0 is what has none before it; blank pages go."""
    parts = F.split(text, marker.replace("(", "(?:"))
    numbers = F.concat(F.array(F.lit("0")), F.regexp_extract_all(F.col(text), F.lit(marker), 1))
    both = F.arrays_zip(numbers.alias("number"), parts.alias("part"))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(both).alias("p")).select(
        key, F.col("p.number").cast("int").alias("page_number"), C.strip(F.col("p.part")).alias("page_text")
    ).where("page_text <> ''")


def markdown_table(rows: Column, most: int = 50) -> Column:
    """An array of rows of cells as a Markdown table: empty rows off, ``most`` rows, cells cut or filled to the header's number."""
    text = lambda row: F.transform(row, lambda c: F.regexp_replace(C.strip(F.coalesce(c, F.lit(""))), r"\s*\n\s*", " "))
    full = F.filter(F.transform(rows, text), lambda r: F.exists(r, lambda c: c != ""))

    def table(found: Column) -> Column:
        width = F.size(F.get(found, F.lit(0)))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        body = F.transform(F.slice(found, F.lit(2), F.greatest(F.lit(0), F.least(F.size(found), F.lit(most)) - 1)), line)
        more = F.when(F.size(found) > most, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.array(line(F.get(found, F.lit(0))), rule), body, more), "\n")

    return F.when(F.size(full) > 0, F.transform(F.array(full), table)[0]).otherwise("")


def pages_to_documents(pages: DataFrame, key: str, page_no: str, text: str, most: int = 50) -> DataFrame:
    """(key, full_text, page_count, char_count): the first ``most`` pages in order, each after its marker."""
    page = F.concat(F.lit("--- Page "), F.col(page_no).cast("string"), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    out = pages.where(F.col(page_no) <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page_no), page.alias("page")))).alias("p"))
    full = F.array_join(F.col("p.page"), "\n")
    return out.select(key, full.alias("full_text"), F.size("p").alias("page_count"), F.length(full).alias("char_count"))


def merged_extractions(a: DataFrame, b: DataFrame, key: str, types: str, scalars: Sequence[str]) -> DataFrame:
    """Of two extractions the first entry of each type, untyped entries all, and the second's other values where it has them."""
    joined = a.select(key, F.col(types).alias("_t1"), *[F.col(s).alias(f"_a_{s}") for s in scalars]).join(
        b.select(key, F.col(types).alias("_t2"), *[F.col(s).alias(f"_b_{s}") for s in scalars]), key, "full_outer"
    )
    every = F.concat(F.coalesce("_t1", F.expr("slice(_t2, 1, 0)")), F.coalesce("_t2", F.expr("slice(_t1, 1, 0)")))
    names = F.transform(every, lambda t: t["type"])
    kept = F.filter(every, lambda t, i: t["type"].isNull() | (t["type"] == "") | (F.array_position(names, t["type"]) == i + 1))
    return joined.select(key, kept.alias(types), *[F.coalesce(f"_b_{s}", f"_a_{s}").alias(s) for s in scalars])


def labelled_values(lines: DataFrame, key: str, label: str) -> DataFrame:
    """The line after each line that is ``label``."""
    after = F.lead("line").over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("value", after).where(F.col("line") == label).select(key, "line_no", "value")


def labelled_block(lines: DataFrame, key: str, label: str, stops: Sequence[str]) -> DataFrame:
    """(key, line_no, line) from the second line that is ``label``, or the only one, to the next stop line."""
    hits = lines.where(F.col("line") == label).groupBy(key).agg(F.slice(F.array_sort(F.collect_list("line_no")), 1, 2).alias("h"))
    begun = lines.join(hits.select(key, F.element_at("h", -1).alias("_from")), key).where(F.col("line_no") > F.col("_from"))
    stop = F.min(F.when(F.col("line").isin(*stops), F.col("line_no"))).over(Window.partitionBy(key))
    return begun.withColumn("_to", stop).where(F.col("_to").isNull() | (F.col("line_no") < F.col("_to"))).select(key, "line_no", "line")


#: Labels of a profile page.
PROFILE_LABELS = {"affiliation": "所属", "keywords": "研究キーワード", "fields": "研究分野"}
AFFILIATION_STOPS = ("学位", "研究者番号", "J-GLOBAL ID", "researchmap会員ID", "外部リンク")


def profiles(lines: DataFrame, key: str, titles: Sequence[str], stops: Sequence[str], labels: Mapping[str, str] = PROFILE_LABELS) -> DataFrame:
    """Name, kana, latin name, affiliation, position, keywords, fields and update of each page of ``lines`` (key, line_no, line).

    The name is the page's first line. Lines shuffle by page once; all else is windows and aggregates by page.
    """
    own = Window.partitionBy(key).orderBy("line_no")
    name = lines.groupBy(key).agg(F.min_by("line", "line_no").alias("name_ja"), F.count(F.lit(1)).alias("n"), F.max(F.regexp_extract("line", "更新日[:：]?\\s*([0-9/]+)", 1)).alias("profile_updated"))
    after = lines.withColumn("next", F.lead("line").over(own)).groupBy(key).agg(F.min_by("next", "line_no").alias("next"))
    both = "^([゠-ヿ\\s]+?)\\s{2,}\\((.+?)\\)$"
    kana = F.when(F.col("next").rlike(both), C.strip(F.regexp_extract("next", both, 1))).when(F.col("next").rlike("^[゠-ヿ\\s]+$"), F.col("next")).otherwise("")
    latin = F.when(F.col("next").rlike(both), C.strip(F.regexp_extract("next", both, 2))).when(F.col("next").rlike("^[A-Za-z\\s.\\-]+$"), F.col("next")).otherwise("")

    def joined(label: str, ends: Sequence[str], column: str) -> DataFrame:
        rows = labelled_block(lines, key, label, ends)
        return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias(column))

    affiliation = joined(labels["affiliation"], AFFILIATION_STOPS, "_a")
    words, fields = joined(labels["keywords"], stops, "_k"), joined(labels["fields"], stops, "_f")
    out = name.join(after, key).join(affiliation, key, "left").join(words, key, "left").join(fields, key, "left")
    place = F.left(F.array_join(F.slice(F.coalesce("_a", F.array().cast("array<string>")), 1, 9), " "), F.lit(400))
    plain = F.filter(F.coalesce("_k", F.array().cast("array<string>")), lambda w: ~w.rlike("^[0-9]+$") & F.length(w).between(2, 49))
    return out.select(
        key, "name_ja", kana.alias("name_kana"), latin.alias("name_en"), place.alias("affiliation"), F.coalesce(C.position_of(place, titles), F.lit("")).alias("position"),
        C.suffix_token(place, "研究科").alias("kenkyuka_name"), C.suffix_token(place, "専攻").alias("senkou_name"), plain.alias("keywords"),
        C.split_fields(F.coalesce("_f", F.array().cast("array<string>"))).alias("research_fields"), "profile_updated",
    )


# Spreadsheet grids: cells (workbook, sheet, row_idx, cells array<string>).

SHEET = ("workbook", "sheet")


def header_row(cells: DataFrame, aliases: Mapping[str, Sequence[str]], least: int = 2) -> DataFrame:
    """(workbook, sheet, header_idx, columns map): the first row in which ``least`` canonical names have a cell that holds an alias."""

    def first_hit(values: Sequence[str]) -> Column:
        return F.get(F.filter(F.transform(F.col("cells"), lambda c, i: F.when(C.contains_any(c, values), i)), lambda i: i.isNotNull()), F.lit(0))

    found = [F.struct(F.lit(name).alias("key"), first_hit(values).alias("value")) for name, values in aliases.items()]
    columns = F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))
    return cells.withColumn("columns", columns).where(F.size("columns") >= least).groupBy(*SHEET).agg(
        F.min("row_idx").alias("header_idx"), F.min_by("columns", "row_idx").alias("columns")
    )


def first_cell(cells: DataFrame, value, rows: int) -> DataFrame:
    """(workbook, sheet, value): the first that ``value`` finds in a cell of the first ``rows`` rows, row by row."""
    every = cells.where(F.col("row_idx") < rows).select(*SHEET, "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
    return every.withColumn("value", value(F.col("cell"))).where(F.col("value").isNotNull()).groupBy(*SHEET).agg(
        F.min_by("value", F.struct("row_idx", "col_idx")).alias("value")
    )


def block_rows(cells: DataFrame, starts: Column, stops: Column) -> DataFrame:
    """The rows after the first that ``starts``, up to the first after it that ``stops``. Conditions on ``cells``."""
    own = Window.partitionBy(*SHEET)
    begun = cells.withColumn("_from", F.min(F.when(starts, F.col("row_idx"))).over(own)).where(F.col("row_idx") > F.col("_from"))
    return begun.withColumn("_to", F.min(F.when(stops, F.col("row_idx"))).over(own)).where(F.col("_to").isNull() | (F.col("row_idx") < F.col("_to"))).drop("_from", "_to")


def filled_units(rows: DataFrame, entity: str = "entity", unit_type: str = "unit_type", unit: str = "unit", sub: str = "sub") -> DataFrame:
    """(workbook, sheet, row_idx, entity, unit_type, unit, sub) of merged cells filled down.

    A new entity forgets type and unit. A row with a sub-unit gives a record, as does the first row of a unit; a record needs entity and unit.
    """
    whole = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(entity, F.last(entity, ignorenulls=True).over(whole))
    before = F.lag(entity).over(Window.partitionBy(*SHEET).orderBy("row_idx"))
    out = out.withColumn("_new", (~F.col(entity).eqNullSafe(before)).cast("int")).withColumn("_part", F.sum("_new").over(whole))
    part = Window.partitionBy(*SHEET, "_part").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_named", F.col(unit).isNotNull())
    out = out.withColumns({unit_type: F.last(unit_type, ignorenulls=True).over(part), unit: F.last(unit, ignorenulls=True).over(part)})
    return out.where(F.col(entity).isNotNull() & F.col(unit).isNotNull() & (F.col(sub).isNotNull() | F.col("_named"))).select(*SHEET, "row_idx", entity, unit_type, unit, sub)


def fallback_units(cells: DataFrame, types: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every cell that looks like a unit's name, once for each type and name."""
    from .filters import noise_name

    every = cells.select(*SHEET, "row_idx", F.posexplode("cells").alias("col_idx", "cell")).withColumn("unit", C.clean_cell(F.col("cell")))
    kind = F.when(F.lit(False), F.lit(""))
    for name, suffixes in types.items():
        kind = kind.when(C.contains_any(F.col("unit"), suffixes), F.lit(name))
    found = every.withColumn("unit_type", kind).where(F.col("unit_type").isNotNull() & ~noise_name(F.col("unit")))
    return first_per_key(found, [*SHEET, "unit_type", "unit"], F.col("row_idx"), F.col("col_idx")).select(*SHEET, "row_idx", "unit_type", "unit")


def by_priority(*results: DataFrame) -> DataFrame:
    """For each sheet the rows of the first result that has any."""
    every = None
    for n, r in enumerate(results):
        part = r.withColumn("_p", F.lit(n))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return every.withColumn("_best", F.min("_p").over(Window.partitionBy(*SHEET))).where("_p = _best").drop("_p", "_best")


def last_turns(turns: DataFrame, conversation: str, turn: str, role: str, n: int = 6, roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """The last ``n`` turns of each conversation, then only these roles."""
    own = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).drop("_n").where(F.col(role).isin(*roles))
