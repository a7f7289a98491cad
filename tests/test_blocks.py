"""Paragraphs and tables on pages, against a plain walk from the top of the first page."""

import random

from ledgerloom.operators import layout

SCHEMA = "doc_id long, blocks array<struct<text:string,cells:array<array<string>>,height:double>>"


def walked(blocks):
    """Every span of one document, placed one after the other."""
    page, y, on_page, out = 1, 150.0, 0, []

    def move(height):
        nonlocal page, y, on_page
        y += height
        if y > 2188.0:
            page, y, on_page = page + 1, 150.0, 0

    def span(text, x1, wide, height, block, row, col):
        nonlocal on_page
        out.append((page, on_page, text, block, row, col, round(x1, 6), y, round(x1 + wide, 6), y + height))
        on_page += 1

    for i, b in enumerate(blocks or []):
        if b is None:
            continue
        text, cells, height = b
        height = 44.0 if height is None or height < 0 else height
        if cells is None:
            text = (text or "").strip()
            if text:
                span(text, 150.0, min(len(text) * 15.0, 1354.0), height, i, None, None)
                move(height)
            continue
        wide = 1354.0 / max([len(r or []) for r in cells] + [1])
        for k, r in enumerate(cells):
            for c, cell in enumerate(r or []):
                if (cell or "").strip():
                    span(cell.strip(), 150.0 + c * wide, wide, height, i, k, c)
            move(height)
    return out


def placed(spark, docs):
    got = {}
    for r in layout.block_layout(spark.createDataFrame(docs, SCHEMA)).collect():
        row = (r.page, r.order, r.text, r.block, r.row, r.col, round(r.x1, 6), r.y1, round(r.x2, 6), r.y2)
        got.setdefault(r.doc_id, []).append(row)
    return {k: sorted(v, key=lambda t: t[:2]) for k, v in got.items()}


def test_random_documents(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", " b ", "", None, "long " * rng.randint(1, 40), "\t", "née "])

    def block():
        kind = rng.random()
        if kind < 0.05:
            return None
        height = rng.choice([None, None, 10.0, 66.0, 100.5, 2500.0, 0.0, -3.0])
        if kind < 0.5:
            return (word(), None, height)
        return (word(), [None if rng.random() < 0.1 else [word() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 30))], height)

    docs = [(i, [block() for _ in range(rng.randint(0, 25))]) for i in range(120)] + [(500, None), (501, [])]
    want = {i: w for i, b in docs if (w := walked(b))}
    assert placed(spark, docs) == want
    assert max(r[0] for w in want.values() for r in w) > 3


def test_a_page_ends_inside_a_table(spark):
    rows = [[f"r{i}", f"v{i}"] for i in range(60)]
    got = placed(spark, [(1, [("Heading", None, None), (None, rows, None)])])[1]
    assert [r[0] for r in got] == [1] * (1 + 46 * 2) + [2] * (14 * 2)
    first = got[1 + 46 * 2]
    assert first == (2, 0, "r46", 1, 46, 0, 150.0, 150.0, 827.0, 194.0)


def test_pages_without_text_are_counted(spark):
    got = placed(spark, [(1, [(None, [[""]] * 47, None), ("after", None, None)])])
    assert got[1] == [(2, 0, "after", 1, None, None, 150.0, 150.0, 225.0, 194.0)]
