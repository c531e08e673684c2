"""HTML tables as cells (row, col, text): spans, headers, and text made of them.

A table is a small document, so it is parsed where it lies, in Arrow batches; what follows are relational operators on cells.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.text import has_letters, is_cell_number

MAX_HEADER_ROWS = 3


class _Cells(HTMLParser):
    """Collects (row, colspan, rowspan, text) of td and th elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cells, self.cell = 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows += 1
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            span = {k: int(v) if v and v.strip().isdigit() else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = [self.rows - 1, max(1, span.get("colspan", 1)), max(1, span.get("rowspan", 1)), []]
            self.cells.append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell[3].append(data.strip())


def grid_cells(html: str | None) -> list[tuple[int, int, str]]:
    """(row, col, text) of a table: a cell goes to the first free column of its row and fills the free places of its span."""
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    placed: dict[tuple[int, int], str] = {}
    for row, across, down, parts in parser.cells:
        col = 0
        while (row, col) in placed:
            col += 1
        for r in range(row, row + min(down, 10_000)):
            for c in range(col, col + min(across, 10_000)):
                placed.setdefault((r, c), "".join(parts))
    return [(r, c, t) for (r, c), t in sorted(placed.items())]


def cells(tables: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, col, text): the cells of every table."""
    kind = tables.schema[key].dataType.simpleString()

    def parse(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, r, c, t) for k, h in zip(frame[key], frame[html], strict=True) for r, c, t in grid_cells(h)]
            yield pd.DataFrame(rows, columns=[key, "row", "col", "text"])

    return tables.select(key, html).mapInPandas(parse, f"`{key}` {kind}, row int, col int, text string")


def header_rows(cell: DataFrame, key: str) -> DataFrame:
    """(key, header_rows): how many leading rows, three at most, look like headers.

    A row does if two neighbours are equal (a span), if below more than a third of the columns turn from text to
    numbers, or if more than half change kind; the first row also if both rows are text and more than half differ.
    A table of one row has one.
    """
    place = Window.partitionBy(key, "row").orderBy("col")
    below = cell.select(F.col(key).alias("_k"), (F.col("row") - 1).alias("_r"), F.col("col").alias("_c"), F.col("text").alias("below"))
    pairs = cell.withColumn("next", F.lead("text").over(place)).join(below, (F.col(key) == F.col("_k")) & (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left")
    now, then = is_cell_number(F.col("text")), is_cell_number(F.col("below"))
    both = F.col("below").isNotNull()
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    rows = pairs.groupBy(key, "row").agg(
        n((F.col("text") != "") & (F.col("text") == F.col("next"))).alias("spans"), n(both & ~now & then).alias("to_number"), n(both & (now != then)).alias("mixed"),
        n(both & (F.col("text") != F.col("below"))).alias("differ"), n((F.col("text") != "") & now).alias("numbers"), n((F.col("below") != "") & then).alias("numbers_below"),
    )
    size = cell.groupBy(F.col(key).alias("_k")).agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("n_rows"))
    plain = (F.col("row") == 0) & (F.col("numbers") == 0) & (F.col("numbers_below") == 0) & (F.col("differ") > F.col("cols") / 2)
    is_header = (F.col("to_number") > F.col("cols") / 3) | (F.col("spans") > 0) | (F.col("mixed") > F.col("cols") / 2) | plain
    judged = rows.join(size, F.col(key) == F.col("_k")).where((F.col("row") < MAX_HEADER_ROWS) & (F.col("row") < F.col("n_rows") - 1)).withColumn("stop", F.when(is_header, None).otherwise(F.col("row")))
    found = judged.groupBy(key).agg(F.coalesce(F.min("stop"), F.max("row") + 1).alias("header_rows"))
    return size.select(F.col("_k").alias(key), "n_rows").join(found, key, "left").select(key, F.coalesce("header_rows", F.lit(1)).cast("int").alias("header_rows"))


def column_headers(cell: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """(key, headers): `A > B` for each column, distinct and sorted."""
    top = cell.join(headers, key).where((F.col("row") < F.col("header_rows")) & (F.trim("text") != ""))
    paths = top.groupBy(key, "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("text").alias("t")))), lambda x: x["t"])), " > ").alias("path"))
    return paths.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("headers"))


def column_counts(cell: DataFrame, key: str) -> DataFrame:
    return cell.groupBy(key).agg((F.max("col") + 1).alias("n_cols"))


def body_lines(cell: DataFrame, key: str) -> DataFrame:
    """(key, lines): each row's cells joined by bars, rows in order."""
    rows = cell.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("t")))), lambda x: x["t"]), " | ").alias("line"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))


def to_text(tables: DataFrame, key: str, html: str, caption: str, footnote: str) -> DataFrame:
    """(key, text): caption, columns, body and footnote, each where there is one."""
    cell = cells(tables, key, html).persist()
    parts = tables.select(key, caption, footnote).join(body_lines(cell, key), key, "left").join(column_headers(cell, header_rows(cell, key), key), key, "left")
    some = lambda c, pre: F.when(F.length(c) > 0, F.concat(F.lit(pre), c))
    columns = F.when(F.col("lines").isNotNull(), F.concat(F.lit("This table contains the following columns:\n"), F.array_join(F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.concat(F.lit(" - "), h, F.lit("\n"))), "")))
    return parts.select(key, F.concat_ws("\n", some(F.col(caption), "Caption: "), columns, F.concat(F.lit("Table Body:\n"), F.array_join("lines", "\n")), some(F.col(footnote), "Footnote: ")).alias("text"))


def linearise(cell: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, text): the labels of a table of which `threshold` or more of the filled cells hold no letters, else a line for each row."""
    full = cell.where("text <> ''")
    share = full.groupBy(key).agg(F.avg((~has_letters(F.col("text"))).cast("double")).alias("share"))
    labels = full.where(has_letters(F.col("text"))).groupBy(key, "text").agg(F.max((F.col("row") < 2).cast("int")).alias("top"), F.max((F.col("col") < 2).cast("int")).alias("side"))
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("text"))))
    sets = labels.groupBy(key).agg(pick(F.col("top") == 1).alias("tops"), pick(F.col("side") == 1).alias("sides"), pick((F.col("top") == 0) & (F.col("side") == 0)).alias("others"))
    line = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name} Labels: "), F.array_join(c, ", ")))
    data = F.concat_ws("\n", F.lit("Type: Data-heavy table (schema summary)"), line("Column", "tops"), line("Row", "sides"), line("Other", "others"))
    head = full.where("row = 0").select(F.col(key).alias("_k"), F.col("col").alias("_c"), F.col("text").alias("head"))
    said = full.where("row > 0").join(head, (F.col(key) == F.col("_k")) & (F.col("col") == F.col("_c")), "left")
    rows = said.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("col", F.concat(F.lit("'"), "head", F.lit("' is '"), "text", F.lit("';")).alias("s"))))), lambda x: x["s"]), " ").alias("s"))
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "s"))), lambda x: F.rtrim(F.concat(F.lit("Row "), x["row"].cast("string"), F.lit(": "), x["s"]))), "\n").alias("body"))
    text = F.concat_ws("\n", F.lit("Type: Text-heavy table (full linearization)"), "body")
    return share.join(sets, key, "left").join(body, key, "left").select(key, F.when(F.col("share") >= threshold, data).otherwise(text).alias("text"))


def continuations(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pdf_id, previous_id): tables without caption and footnote, with the last table before them if that stands on
    the page before or the same and has as many columns. blocks: pdf_id, page_idx, type, n_cols, has_caption."""
    before = Window.partitionBy(doc).orderBy("pdf_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type") == "table", F.struct("pdf_id", "page_idx", "n_cols")), ignorenulls=True).over(before)
    near = (F.col("page_idx") - F.col("last.page_idx")).between(0, 1) & (F.col("n_cols") == F.col("last.n_cols"))
    return blocks.withColumn("last", last).where((F.col("type") == "table") & ~F.col("has_caption") & near).select(doc, "pdf_id", F.col("last.pdf_id").alias("previous_id"))


def html_blocks(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = ("h1", "h2", "h3", "p", "li")) -> DataFrame:
    """(key, position, tag, text): elements of some kinds in the order of the page, scripts, styles and comments left out."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    pattern = rf"(?is)<({'|'.join(map(re.escape, tags))})\b[^>]*>(.*?)(?=</\1>|<(?:{'|'.join(map(re.escape, tags))})\b)"
    found = pages.select(key, F.posexplode(F.regexp_extract_all(bare, F.lit(pattern), F.lit(0))).alias("position", "_m"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("_m", r"(?is)^<[^>]*>(.*)$", 1), r"<[^>]*>", " "), r"\s+", " "))
    return found.select(key, "position", F.lower(F.regexp_extract("_m", "^<([A-Za-z0-9]+)", 1)).alias("tag"), text.alias("text")).where("text <> ''")


def html_headings(pages: DataFrame, key: str, html: str, tag: str = "h1") -> DataFrame:
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "heading"))


