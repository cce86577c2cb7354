"""Tables from an engine's blocks: values by where they stand, marks, lines outside tables."""

import pytest

from veridoc.operators import tables

BLOCK = "page_id long, block_no int, block_id string, kind string, text string, row_idx int, col_idx int, left double, width double, selected boolean, children array<string>"
COLUMNS = [(0.05, 0.45), (0.45, 0.58), (0.58, 0.71), (0.71, 0.84), (0.84, 0.97)]


class Page:
    def __init__(self, number):
        self.number, self.rows = number, []

    def add(self, kind, text=None, r=None, c=None, left=None, right=None, selected=None, children=None):
        n = len(self.rows)
        self.rows.append((self.number, n, f"b{n}", kind, text, r, c, left, None if right is None else right - left, selected, children))
        return f"b{n}"

    def cell(self, r, c, *words, selected=None):
        """words: (text, left, right)."""
        left, right = COLUMNS[c - 1]
        kids = [self.add("WORD", t, left=a, right=b) for t, a, b in words]
        if selected is not None:
            kids.append(self.add("SELECTION_ELEMENT", selected=selected))
        return self.add("CELL", r=r, c=c, left=left, right=right, children=kids or None)

    def comparative(self, *rows, filler=8):
        ids = [self.cell(1, 1), *[self.cell(1, c, (t, *COLUMNS[c - 1])) for c, t in enumerate(("COOL", "STYLE", "CVT", "EXCITE"), 2)]]
        for r, (label, values) in enumerate(rows, 2):
            ids.append(self.cell(r, 1, (label, 0.06, 0.2)))
            ids += [self.cell(r, c, *values.get(c, ())) for c in range(2, 6)]
        for r in range(30, 30 + filler):
            ids.append(self.cell(r, 1, (f"Equipo {r}", 0.06, 0.2)))
            ids += [self.cell(r, c) for c in range(2, 6)]
        return self.add("TABLE", left=0.0, right=1.0, children=ids)


def texts(spark, *pages, ink=None):
    frame = spark.createDataFrame([r for p in pages for r in p.rows], BLOCK)
    drawn = spark.createDataFrame(ink, "page_id long, block_id string, ink double, compact boolean") if ink else None
    return {r["page_id"]: r["text"] for r in tables.blocks_to_pages(frame, drawn).collect()}


def test_values_are_given_to_columns_by_their_place(spark):
    p = Page(1)
    p.comparative(
        ("Largo", {3: [("4,113", 0.70, 0.72)]}),
        ("Transmision", {2: [("MT", 0.50, 0.53)], 5: [("CVT", 0.88, 0.92)]}),
        ("Potencia", {3: [("108", 0.66, 0.68), ("HP", 0.69, 0.705)], 4: [("rpm", 0.707, 0.75)]}),
        ("Rines", {2: [("16", 0.50, 0.52)], 3: [("17", 0.525, 0.56)]}),
    )
    lines = texts(spark, p)[1].split("\n")
    assert lines[:4] == ["Largo: 4,113", "Transmision: MT (COOL); CVT (EXCITE)", "Potencia: 108 HP rpm", "Rines: 16 17 (COOL, STYLE)"]
    assert lines[4:] == [f"## Equipo {r}" for r in range(30, 38)]


def test_marks_name_columns_by_the_tables_own_threshold(spark):
    p = Page(1)
    p.comparative(("Quemacocos", {}), ("Bolsas", {}))
    at = {(r[5], r[6]): r[2] for r in p.rows if r[3] == "CELL"}
    empty = [r[2] for r in p.rows if r[3] == "CELL" and not r[10]]
    drawn = {at[2, 5], *[at[3, c] for c in range(2, 6)]}
    ink = [(1, b, 0.005 if b in drawn else 0.0001, b in drawn) for b in empty]
    lines = texts(spark, p, ink=ink)[1].split("\n")
    assert lines[:2] == ["Quemacocos: solo en EXCITE", "Bolsas: en todas las columnas (COOL, STYLE, CVT, EXCITE)"]
    shaded = [(1, b, 0.2, False) for b in empty]  # all the same: nothing can be told
    assert texts(spark, p, ink=shaded)[1].split("\n")[:2] == ["## Quemacocos", "## Bolsas"]


def test_lines_of_tables_are_said_once_and_others_come_first(spark):
    p, q = Page(1), Page(2)
    title = [p.add("WORD", w) for w in ("Ficha", "técnica")]
    in_table = p.cell(2, 1, ("Largo", 0.06, 0.2))
    ids = [p.cell(1, 1, ("Dato", 0.1, 0.2)), p.cell(1, 2, ("Valor", 0.5, 0.6)), in_table, p.cell(2, 2, ("4", 0.5, 0.51)), p.cell(3, 1, ("Ancho", 0.06, 0.2)), p.cell(3, 2, selected=True)]
    p.add("TABLE", children=[*ids, "missing"])
    p.add("LINE", "Largo 4", children=[r[2] for r in p.rows if r[4] in ("Largo", "4")])
    p.add("LINE", "Ficha técnica", children=title)
    p.add("LINE", "nota", children=None)
    p.cell(9, 1, ("suelta", 0.1, 0.2))  # a cell of no table
    # the same ids on another page are other blocks
    for text in ("uno", "dos"):
        q.add("LINE", text, children=[q.add("WORD", text)])
    q.add("LINE", None)
    got = texts(spark, p, q)
    assert got == {1: "Ficha técnica\nnota\nDato: Largo | Valor: 4\nDato: Ancho | Valor: sí", 2: "uno\ndos"}
    assert texts(spark, Page(3)) == {}


def test_tables_without_labels_headers_or_rows(spark):
    p = Page(1)
    p.comparative(("", {2: [("x", 0.5, 0.52)]}), ("Sin", {}), filler=6)
    assert texts(spark, p)[1].split("\n")[0] == "## Sin"
    q = Page(2)
    q.add("TABLE", children=[q.cell(1, 1, ("solo", 0.1, 0.2))])
    r = Page(3)
    r.add("TABLE", children=[])
    r.add("LINE", "fuera")
    assert texts(spark, q, r) == {3: "fuera"}


@pytest.mark.parametrize("gap,merged", [(0.0099, True), (0.0101, False)])
def test_gap_between_values(spark, gap, merged):
    p = Page(1)
    p.comparative(("A", {2: [("1", 0.5, 0.52)], 3: [("2", 0.52 + gap, 0.58)]}))
    line = texts(spark, p)[1].split("\n")[0]
    assert line == ("A: 1 2 (COOL, STYLE)" if merged else "A: 1 (COOL); 2 (STYLE)")
