"""Grids of tables with spans against a plain layout, and worked cases."""

import random

from docloom.operators import tables


def plain_grid(rows):
    """Lay out rows of (text, rowspan, colspan) place by place, as the standard's algorithm says."""
    taken = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in taken:
                c += 1
            for i in range(down):
                for j in range(across):
                    if r + i < len(rows):
                        taken.setdefault((r + i, c + j), text)
            c += across
    return taken


def as_html(rows):
    out = "".join("<tr>" + "".join(f"<td rowspan={d} colspan='{a}'>{t}</td>" for t, d, a in row) + "</tr>" for row in rows)
    return f"<div><table>{out}</table></div>"


def test_grids_by_a_plain_layout():
    made = random.Random(3)
    for _ in range(400):
        n = 0
        rows = []
        for _ in range(made.randint(1, 6)):
            row = []
            for _ in range(made.randint(0, 4)):
                row.append((f"t{n}", made.choice([1, 1, 1, 2, 3]), made.choice([1, 1, 1, 2, 4])))
                n += 1
            rows.append(row)
        got = {(r, c): t for _, r, c, t, *_ in tables.cells_of(as_html(rows))}
        assert got == plain_grid(rows), rows


def test_odd_tables():
    cells = lambda page: [(t, r, c, x) for t, r, c, x, *_ in tables.cells_of(page)]
    assert cells("<table><tr><td>a<td>b<tr><td colspan=x rowspan=-1>c&amp;d\n e") == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c&d e")]
    assert cells("<table><td rowspan=0>a</td><td>b</td><tr><td>c</table>") == [(0, 0, 0, "a"), (0, 1, 0, "a"), (0, 0, 1, "b"), (0, 1, 1, "c")]
    assert cells("<table><tr><td>a<table><tr><td>in</table>b</td><td>c</table>") == [(0, 0, 0, "ab"), (0, 0, 1, "c"), (1, 0, 0, "in")]
    assert cells("<td>no table</td>") == [] == cells("<table></table>") == cells("")
    assert len(cells("<table><tr><td colspan=99999999999>a</table>")) == 1 and len(cells("<table><tr><td colspan=5000>a</table>")) == 1000
    assert cells("<table><tr><td>a<br>b<p>c</p></table>") == [(0, 0, 0, "a b c")]


def test_html_cells(spark):
    pages = [(1, as_html([[("k", 1, 1), ("v", 1, 1)], [("Name:", 1, 1), ("x", 1, 1)], [("", 1, 1), ("y", 1, 1)]])), (2, None), (3, "<p>none</p>"), (1, as_html([[("one", 1, 1)]])), (None, as_html([[("two", 1, 2)]]))]
    table = spark.createDataFrame(pages, "page_id long, html string")
    got = tables.html_cells(table)
    assert got.count() == 6 + 1 + 2
    assert {(r.page_id, r.col, r.anchor) for r in got.where("text = 'two'").collect()} == {(None, 0, True), (None, 1, False)}
    assert [(r.row, r.key, r.value) for r in tables.key_values(tables.html_cells(table.limit(1))).orderBy("row").collect()] == [(0, "k", "v"), (1, "Name", "x")]
    assert tables.html_cells(table.limit(0)).count() == 0


def test_analysis(spark):
    one = '{"pages": [{"page_number": 2, "lines": []}, {"page_number": 3, "lines": [{"content": "a"}]}], "tables": [{"row_count": 2, "column_count": 2, "cells": [{"content": "x", "row_index": 0, "column_index": 0, "row_span": 9, "column_span": 1}, {"content": "y", "row_index": 5, "column_index": 0}]}]}'
    found = tables.analysed(spark.createDataFrame([(1, one), (2, "no json"), (3, None), (4, "{}")], "doc_id int, result string"))
    assert [tuple(r) for r in tables.analysis_lines(found).collect()] == [(1, 3, 0, "a")]
    assert sorted(map(tuple, tables.analysis_cells(found).collect())) == [(1, 0, 0, 0, "x"), (1, 0, 1, 0, "x")]
    assert tables.analysis_pairs(found).count() == 0


def test_plain_pages_as_the_parser_reads_them():
    def parsed(page):
        reader = tables._Reader()
        reader.feed(page)
        reader.close()
        return [cell for table in reader.done for cell in table.grid()]

    made, plain = random.Random(1), 0
    pieces = ["<table>", "</table>", "<tr>", "<td>", "<TD colspan=2>", "<th rowspan='2'>", "</td>", "a b", "&amp;", "<", ">", '<td colspan="3" >', "<br/>", "<!-- x -->", "<td x>", "<script>", "<td colspan=2/>",
              "<td rowspan=2 rowspan=3>", "<td\x0ba=1>", "<td a='1'b='2'>", "<plaintext>", "<td rowspan=0>", "</ td>"]
    for i in range(3000):
        page = "<table><tr><td>" * (i % 2) + "".join(made.choice(pieces) for _ in range(made.randint(1, 9)))
        plain += tables._plain(page, tables._Reader())
        assert tables.cells_of(page) == parsed(page), page
    assert plain > 300


def test_key_values_of_pages(spark):
    two, three = "<table><tr><td>k :<td>v{0}</tr><tr><th>h<th>g</tr></table>", "<table><tr><td colspan=2>a<td>b</table>"
    pages = spark.createDataFrame([(i, three + two.format(i) + "<table></table>") for i in range(50)] + [(99, None)], "page_id long, html string").coalesce(1)
    want = tables.key_values(tables.html_cells(pages))
    assert sorted(tables.html_key_values(pages).collect()) == sorted(want.collect()) == [(i, 1, 0, "k", f"v{i}") for i in range(50)]


def test_pages_with_the_same_tags(spark, monkeypatch):
    made = random.Random(9)
    tags = ["<table>", "</table>", "<tr>", "<td>", "<td colspan=2>", "<th rowspan='2'>", "</td>", "<p>", "<br/>", "<td x>", "<script>", "<td rowspan=0>"]
    shapes = [["<table>", "<tr>", "<td>", *(made.choice(tags) for _ in range(made.randint(1, 9)))] for _ in range(200)]
    words = ["", " ", "a", "b  c\n", "&amp;", "d>e", "<", "\xa0f"]
    pages = ["".join(t + made.choice(words[:3] if i < 3 else words) for t in shape) for i in range(6) for shape in shapes]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(2)
    for width in (None, 2):
        wide = lambda cells: {t for t in {c[0] for c in cells} if width is None or max(c[2] for c in cells if c[0] == t) == width - 1}
        want = sorted((i, *cell) for i, page in enumerate(pages) for cells in [tables.cells_of(page)] for cell in cells if cell[0] in wide(cells))
        assert sorted(map(tuple, tables.html_cells(table, width=width).collect())) == want
    read, count = tables._read, []
    monkeypatch.setattr(tables, "_read", lambda *a: count.append(1) or read(*a))
    reader, alike = tables._Pages(), as_html([[("t{0}", 1, 2)], [("u", 1, 1), ("{0} v", 2, 1)]])
    found = [reader.read(alike.format(i)) for i in range(1000)]
    assert found[999][1] == ["t999", "t999", "u", "999 v"] and len(count) == 2  # the first by itself, the second for the layout


def test_room_for_layouts(monkeypatch):
    monkeypatch.setattr(tables, "ROOM", 2000)
    reader = tables._Pages()
    for i in range(300):
        page = as_html([[(f"t{i}", 1, 1 + i % 30)] * (1 + i % 7)])
        found = reader.read(page)
        cells = found if isinstance(found, list) else [(*map(int, c[:3]), t, bool(c[3]), bool(c[4])) for c, t in zip(found[0].columns, found[1], strict=True)]
        assert cells == tables.cells_of(page) and reader.held <= 2000
