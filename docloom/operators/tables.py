"""Tables in documents as cells (table, row, col, text), from HTML and from the results of document analysis.

A cell that spans rows or columns fills every place of the grid that it covers. In HTML a cell's column is not written
down: it is the first place of its row that no cell above it covers, so rows are laid out one after the other. The results
of an analysis name the row and column of each cell, and are flattened by DataFrame functions alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows or columns that one cell may span, as browsers have it.
MOST_ROWS, MOST_COLUMNS = 65_534, 1000
CELLS = "table int, row int, col int, text string, header boolean, anchor boolean"
ROWS = 50_000  #: of a batch that goes out, about
ROOM = 200_000  #: for places of the layouts that a task keeps, and characters of their tags
#: A tag whose attributes leave no room for error, and what cannot stand in or between such tags.
_ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z]+)=(?:'([^'<>&]*)'|"([^"<>&]*)"|([^\s'"<>=`&/]+))(?=[ \t\n\r\f>]|$)"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r'\((?!\?)', '(?:', _ATTRIBUTE)})*)>")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_ANY_TAG = re.compile("(<[^<>]*>)")
#: Elements whose content is not read as markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Table:
    """A table being read: its cells (row, column, rows, columns, header, words), and which columns are taken until when."""

    def __init__(self, number: int):
        self.number, self.cells, self.row, self.open = number, [], -1, None
        self.taken: dict[int, int] = {}  #: column to the first row in which it is free again

    def new_row(self) -> None:
        self.open = None
        self.row += 1
        self.taken = {c: until for c, until in self.taken.items() if until > self.row}

    def new_cell(self, header: bool, rows: int, columns: int) -> None:
        if self.row < 0:
            self.new_row()
        # The first free column after the last cell of this row.
        row, taken = self.row, self.taken
        last = self.cells[-1] if self.cells else None
        col = last[1] + last[3] if last and last[0] == row else 0
        while taken.get(col, 0) > row:
            col += 1
        self.open = (row, col, rows, columns, header, [])
        self.cells.append(self.open)
        until = row + rows
        for c in range(col, col + columns):
            if taken.get(c, 0) < until:
                taken[c] = until

    def grid(self) -> Iterator[tuple[int, int, int, str, bool, bool]]:
        """(table, row, column, text, header, anchor) of every place that a cell covers."""
        texts = [" ".join("".join(words).split()) for *_, words in self.cells]
        return ((self.number, r, c, texts[n], header, anchor) for r, c, n, header, anchor in self.places())

    def places(self) -> Iterator[tuple[int, int, int, bool, bool]]:
        """(row, column, number of the cell, header, anchor) of every place that a cell covers; a row span ends with the table,
        and a place covered twice is the first cell's."""
        met = set()
        for n, (row, col, rows, columns, header, _) in enumerate(self.cells):
            if rows == columns == 1:
                if (row, col) not in met:
                    met.add((row, col))
                    yield row, col, n, header, True
                continue
            for r in range(row, min(row + rows, self.row + 1)):
                for c in range(col, col + columns):
                    if (r, c) not in met:
                        met.add((r, c))
                        yield r, c, n, header, (r, c) == (row, col)


class _Reader(HTMLParser):
    """The tables of a page, by the order of their start tags; a table within a cell is a table of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[_Table] = []
        self.stack: list[_Table] = []

    @staticmethod
    def _span(attributes: dict, name: str, most: int) -> int:
        value = (attributes.get(name) or "").strip()
        return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 10 else 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            table = _Table(len(self.done))
            self.done.append(table)
            self.stack.append(table)
        elif self.stack and tag == "tr":
            self.stack[-1].new_row()
        elif self.stack and tag in ("td", "th"):
            if not attrs:
                self.stack[-1].new_cell(tag == "th", 1, 1)
                return
            given = dict(attrs)
            rows = MOST_ROWS if (given.get("rowspan") or "").strip() == "0" else self._span(given, "rowspan", MOST_ROWS)
            self.stack[-1].new_cell(tag == "th", rows, self._span(given, "colspan", MOST_COLUMNS))
        elif self.stack and self.stack[-1].open and tag in ("br", "p", "div", "li"):
            self.stack[-1].open[5].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.stack and tag in ("td", "th", "tr"):
            self.stack[-1].open = None
        elif self.stack and tag == "table":
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].open:
            self.stack[-1].open[5].append(data)


@functools.lru_cache(1000)
def _tag(tag: str) -> tuple[bool, str, list | tuple] | None:
    """Whether a plain tag is an end tag, its name and its attributes; none if it is not plain."""
    found = _TAG.fullmatch(tag)
    slash, name, given = found.groups() if found else ("", "", "")
    if not found or slash and given or name.lower() in _RAW:
        return None
    return bool(slash), name.lower(), [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTES.findall(given)] if given else ()


def _read(tags: list[str], texts: Iterable, reader: _Reader) -> bool:
    """Read tags, each with the text after it, or what stands for it; false if any of them is not plain."""
    start, end, stack = reader.handle_starttag, reader.handle_endtag, reader.stack
    for tag, text in zip(tags, texts, strict=True):
        if not (found := _tag(tag) if len(tag) < 1000 else _tag.__wrapped__(tag)):
            return False
        if found[0]:
            end(found[1])
        else:
            start(found[1], found[2])
        if text != "" and stack and (cell := stack[-1].open):
            cell[5].append(text)
    return True


def _plain(page: str, reader: _Reader) -> bool:
    """Read a page of plain tags alone; false if there is anything else to it: then the parser must."""
    pieces = _ANY_TAG.split(page)  # text, then a tag and the text after it, and so on
    return "&" not in page and page.count("<") == len(pieces) // 2 and _read(pieces[1::2], pieces[2::2], reader)


def _tables_of(page: str) -> list[_Table]:
    reader = _Reader()
    if not _plain(page, reader):
        reader = _Reader()
        reader.feed(page)
        reader.close()
    return reader.done


def _of_width(tables: list[_Table], width: int | None) -> list[_Table]:
    """Tables of that width. One is at least as wide as any cell reaches, so most others are told before they are laid out."""
    return [t for t in tables if width is None or max((c + w for _, c, _, w, *_ in t.cells), default=0) == width]


class _Layout:
    """The grids of all pages with the same tags: table, row, col, header and anchor of their places, and which pieces of a
    page's text are in each."""

    def __init__(self, tables: list[_Table]):
        places = [(t.number, r, c, header, anchor) for t in tables for r, c, _, header, anchor in t.places()]
        self.columns = np.array(places, np.int32).reshape(-1, 5)
        # A cell's words are numbers of pieces, and spaces. Where no cell has two pieces, they are taken at once; cells without
        # any have the empty one after the last.
        self.size, self.words = len(places), [t.cells[n][5] for t in tables for _, _, n, *_ in t.places()]
        many = any(sum(w != " " for w in cell[5]) > 1 for t in tables for cell in t.cells)
        self.single = None if many else [next((w for w in words if w != " "), -1) for words in self.words]

    def texts(self, pieces: list[str]) -> list[str]:
        if self.single is not None:
            pieces.append("")
            return [t if t.isalnum() else " ".join(t.split()) for t in [pieces[i] for i in self.single]]
        return [" ".join("".join([" " if w == " " else pieces[w] for w in ws]).split()) for ws in self.words]


class _Pages:
    """Reads pages one after the other. Those with the same plain tags have the same layout, which is made when the second of
    them comes, and kept while there is room."""

    def __init__(self, width: int | None = None):
        self.width, self.held = width, 0
        self.known: dict[str, _Layout | bool] = {}  #: by tags; true where met once, false where not plain or too large

    def read(self, page: str) -> tuple[_Layout, list[str]] | list[tuple[int, int, int, str, bool, bool]]:
        """The layout of a page and the text of each of its places, or the cells of a page by itself."""
        pieces = _ANY_TAG.split(page)  # text, then a tag and the text after it, and so on
        tags = pieces[1::2]
        if "&" not in page and page.count("<") == len(tags):
            key = "".join(tags)
            layout = False if len(key) > ROOM // 10 else self.known.get(key)
            if layout is None:
                self._keep(key, True, len(key))
            elif layout is True:
                reader = _Reader()
                made = _read(tags, range(len(tags)), reader) and _Layout(_of_width(reader.done, self.width))
                layout = made if made and made.size <= ROOM // 10 else False
                self._keep(key, layout, layout.size if layout else 0)
            if isinstance(layout, _Layout):
                return layout, layout.texts(pieces[2::2])
        return [cell for table in _of_width(_tables_of(page), self.width) for cell in table.grid()]

    def _keep(self, key: str, layout: _Layout | bool, weight: int) -> None:
        if self.held + weight > ROOM:
            self.known, self.held = {}, 0
        self.known[key] = layout
        self.held += weight


def cells_of(page: str) -> list[tuple[int, int, int, str, bool, bool]]:
    """(table, row, column, text, header, anchor) of every place of every table of a page."""
    return [cell for table in _tables_of(page) for cell in table.grid()]


def html_cells(pages: DataFrame, *, width: int | None = None) -> DataFrame:
    """page_id, table, row, col, text, header, anchor: every place of the grid of every table of `pages` (page_id, html), or of
    those tables alone that are `width` columns wide.

    `anchor` marks a cell's own place, others are covered by its span. Null pages and pages without tables have no rows.
    """
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["page_id", *(c.split()[0] for c in CELLS.split(", "))]

    def parts(batch: pa.RecordBatch, ids: list[int], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *columns], names)
        return (made.slice(at, ROWS) for at in range(0, len(made), ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Pages(width)
        for batch in batches:
            alone, cells, ids, layouts, texts = [], [], [], [], []

            # Pages go out together. One page's grid may be large: it goes out in parts.
            def out() -> Iterator[pa.RecordBatch]:
                if cells:
                    yield from parts(batch, alone, [pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)])
                if texts:
                    columns = np.concatenate([x.columns for x in layouts]).T
                    table, row, col, header, anchor = (pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types[:3] + types[4:], strict=True))
                    yield from parts(batch, np.repeat(ids, [x.size for x in layouts]), [table, row, col, pa.array(texts, pa.string()), header, anchor])

            for i, page in enumerate(batch.column(1).to_pylist()):
                found = reader.read(page) if page else []
                if isinstance(found, list):
                    alone += [i] * len(found)
                    cells += found
                elif found[1]:
                    ids.append(i)
                    layouts.append(found[0])
                    texts += found[1]
                if len(cells) + len(texts) >= ROWS:
                    yield from out()
                    alone, cells, ids, layouts, texts = [], [], [], [], []
            yield from out()

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {id_type}, {CELLS}")


def html_key_values(pages: DataFrame) -> DataFrame:
    """`key_values` of `pages` (page_id, html). A table's width is known where it is read, so only cells of tables with two
    columns are sent on."""
    return _pairs(html_cells(pages, width=2))


def key_values(cells: DataFrame) -> DataFrame:
    """page_id, table, row, key, value: the rows of tables with two columns, read as keys and values; rows without a key, and
    header rows, are left out."""
    wide = cells.groupBy("page_id", "table").agg(F.max("col").alias("last")).where("last = 1").select("page_id", "table")
    return _pairs(cells.join(wide, ["page_id", "table"]))


def _pairs(cells: DataFrame) -> DataFrame:
    two = cells.groupBy("page_id", "table", "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("text"))).alias("key"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("value"), F.bool_and("header").alias("header")
    )
    return two.where("not header and key <> ''").select("page_id", "table", "row", F.rtrim(F.col("key"), F.lit(" :")).alias("key"), "value")


ANALYSIS = (
    "content string, pages array<struct<page_number:int,lines:array<struct<content:string>>>>, "
    "tables array<struct<row_count:int,column_count:int,cells:array<struct<content:string,row_index:int,column_index:int,row_span:int,column_span:int>>>>, "
    "key_value_pairs array<struct<key:struct<content:string>,value:struct<content:string>,confidence:double>>"
)


def analysed(results: DataFrame) -> DataFrame:
    """doc_id and a: the JSON results of `results` (doc_id, result), as structs; null where they are no JSON."""
    return results.select("doc_id", F.from_json("result", ANALYSIS).alias("a"))


def analysis_lines(results: DataFrame) -> DataFrame:
    """doc_id, page_number, line, content of `analysed` results, lines counted from 0 on each page."""
    pages = results.select("doc_id", F.inline("a.pages"))
    return pages.select("doc_id", "page_number", F.posexplode("lines").alias("line", "l")).select("doc_id", "page_number", "line", "l.content")


def analysis_cells(results: DataFrame) -> DataFrame:
    """doc_id, table, row, col, content: every place of the grids of `analysed` results; spans end with the table."""
    tables = results.select("doc_id", F.posexplode("a.tables").alias("table", "t"))
    cells = tables.select("doc_id", "table", F.col("t.row_count").alias("rows"), F.col("t.column_count").alias("cols"), F.inline("t.cells"))
    until = lambda start, span, count: F.least(F.col(start) + F.coalesce(span, F.lit(1)), F.coalesce(count, F.col(start) + F.coalesce(span, F.lit(1)))) - 1
    inside = cells.where((F.col("row_index") < F.coalesce("rows", F.col("row_index") + 1)) & (F.col("column_index") < F.coalesce("cols", F.col("column_index") + 1)))
    rows = inside.withColumn("row", F.explode(F.sequence("row_index", until("row_index", "row_span", "rows"))))
    return rows.select("doc_id", "table", "row", F.explode(F.sequence("column_index", until("column_index", "column_span", "cols"))).alias("col"), "content")


def analysis_pairs(results: DataFrame) -> DataFrame:
    """doc_id, key, value, confidence of `analysed` results; a key may have no value."""
    pairs = results.select("doc_id", F.inline("a.key_value_pairs"))
    return pairs.select("doc_id", F.col("key.content").alias("key"), F.col("value.content").alias("value"), "confidence")
