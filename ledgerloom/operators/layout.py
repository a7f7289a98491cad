"""Page geometry: lines, neighbours, page statistics, characters to spans, text to a synthetic layout."""

from __future__ import annotations

from collections.abc import Iterable
from math import inf
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.geometry import overlap
from ledgerloom.functions.text import strip

PAGE = ("doc_id", "page")
PACKET_PAGE = ("packet_id", "doc_id", "page")  # documents are numbered inside their packet
# A4 at 200 dots per inch, margin, line and character pitch in inches.
DPI, PAGE_W_IN, PAGE_H_IN, MARGIN_IN, LINE_IN, CHAR_IN = 200, 8.27, 11.69, 0.75, 0.22, 0.075


BOX = ("x1", "y1", "x2", "y2")


def beside(max_gap: float) -> Column:
    """struct<direction, ratio> of a span (b_ columns) as seen from a caption (a_ columns); null if it is not beside it.
    Rules apply in the order right, below, left, above, and one whose gap is too wide gives way to the next."""
    u = F.col("a_unit")
    v = overlap(F.col("a_y1"), F.col("a_y2"), F.col("b_y1"), F.col("b_y2"))
    h = overlap(F.col("a_x1"), F.col("a_x2"), F.col("b_x1"), F.col("b_x2"))
    aligned = (h >= 0.15) | (F.abs(F.col("a_x1") - F.col("b_x1")) <= 2 * u)
    slack = 0.3 * u
    rules = (
        ("right", (v >= 0.3) & (F.col("b_x1") >= F.col("a_x2") - slack), F.col("b_x1") - F.col("a_x2")),
        ("below", (F.col("b_y1") >= F.col("a_y2") - slack) & aligned, F.col("b_y1") - F.col("a_y2")),
        ("left", (v >= 0.3) & (F.col("b_x2") <= F.col("a_x1") + slack), F.col("a_x1") - F.col("b_x2")),
        ("above", (F.col("b_y2") <= F.col("a_y1") + slack) & aligned, F.col("a_y1") - F.col("b_y2")),
    )
    return F.coalesce(*[
        F.when(holds & (F.greatest(F.lit(0.0), gap) <= max_gap * u), F.struct(F.lit(name).alias("direction"), (F.greatest(F.lit(0.0), gap) / u / max_gap).alias("ratio")))
        for name, holds, gap in rules
    ])


def sides(captions: DataFrame, spans: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The captions' and the spans' columns that ``beside`` reads, with their ids."""
    a = captions.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("span_id", *BOX, "unit")])
    return a, spans.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("span_id", *BOX)])


def neighbours(captions: DataFrame, spans: DataFrame, max_gap: float = 6.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Spans beside each caption on its page: direction, same_line, distance_ratio.

    An equi-join on the page with the geometry (``beside``) as residual condition."""
    a, b = sides(captions, spans, keys)
    joined = a.join(b, list(keys)).where("a_span_id <> b_span_id").withColumn("hit", beside(max_gap)).where("hit is not null")
    return joined.select(*keys, "a_span_id", "b_span_id", "hit.direction", F.col("hit.ratio").alias("distance_ratio"), F.col("hit.direction").isin("right", "left").alias("same_line"))


def neighbour_counts(captions: DataFrame, spans: DataFrame, max_gap: float = 6.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """``neighbours`` counted by page, direction and distance_ratio: n, and the smallest b_span_id as first_span.

    Whether and where a span is beside a caption depends on the two boxes only, so equal boxes of a page are counted first
    and each pair of different boxes is looked at once: work grows with the spans and with the pairs of boxes, not with the pairs
    of spans. A caption that its own span would be beside (one narrower or flatter than 0.3 units) must not count that one, so
    such captions are joined span by span."""
    a, b = sides(captions, spans, keys)
    own = a.join(b.withColumnRenamed("b_span_id", "a_span_id"), [*keys, "a_span_id"])
    own = own.where(beside(max_gap).isNotNull()).select(*keys, F.col("a_span_id").alias("span_id")).distinct()
    told = [*keys, "hit.direction", F.col("hit.ratio").alias("distance_ratio")]
    by_box = (
        a.where("a_span_id is not null").join(own.withColumnRenamed("span_id", "a_span_id"), [*keys, "a_span_id"], "left_anti").groupBy(*keys, *[f"a_{c}" for c in (*BOX, "unit")]).agg(F.count("*").alias("captions"))
        .join(b.where("b_span_id is not null").groupBy(*keys, *[f"b_{c}" for c in BOX]).agg(F.count("*").alias("spans"), F.min("b_span_id").alias("first")), list(keys))
        .withColumn("hit", beside(max_gap)).where("hit is not null").select(*told, (F.col("captions") * F.col("spans")).alias("n"), "first")
    )
    by_span = neighbours(captions.join(own, [*keys, "span_id"], "left_semi"), spans, max_gap, keys).select(*keys, "direction", "distance_ratio", F.lit(1).cast("long").alias("n"), F.col("b_span_id").alias("first"))
    return by_box.unionByName(by_span).groupBy(*keys, "direction", "distance_ratio").agg(F.sum("n").alias("n"), F.min("first").alias("first_span"))


def pages_of(spans: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """One row a page, its spans in arrays ``s``. As many partitions as a shuffle has: the bytes of a page don't tell what a
    fold in Python over it costs, so Spark must not join small partitions to one task."""
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("s"))


def numbers(values: Iterable[float | None]) -> list[float]:
    return [float("nan") if v is None else float(v) for v in values]


def known(x: float) -> float:
    """For sorting: unknown places come last."""
    return inf if x != x else x


def usual_height(y1: list[float], y2: list[float]) -> float:
    """The median of the positive heights, 1 without any."""
    heights = [low - top for top, low in zip(y1, y2, strict=True) if low - top > 0]
    return median(heights) if heights else 1.0


def line_numbers(ids: list[int], x1: list[float], y1: list[float], y2: list[float]) -> tuple[list[int], list[int], list[int]]:
    """Span ids of a page in reading order, their lines and their order."""
    reach = max(0.6 * usual_height(y1, y2), 1.0)
    sums: list[float] = []
    counts: list[int] = []
    tops: list[float] = []
    own = [0] * len(ids)
    for i in sorted(range(len(ids)), key=lambda i: (known(y1[i]), known(x1[i]), ids[i])):
        cy = (y1[i] + y2[i]) / 2
        at = next((k for k, (s, n) in enumerate(zip(sums, counts, strict=True)) if abs(s / n - cy) <= reach), None)
        if at is None:
            at = len(sums)
            sums.append(0.0)
            counts.append(0)
            tops.append(inf)
        sums[at] += cy
        counts[at] += 1
        tops[at] = min(tops[at], known(y1[i]))
        own[i] = at
    rank = {k: r for r, k in enumerate(sorted(range(len(tops)), key=lambda k: tops[k]))}
    read = sorted(range(len(ids)), key=lambda i: (rank[own[i]], known(x1[i]), ids[i]))
    return [ids[i] for i in read], [rank[own[i]] for i in read], list(range(len(ids)))


def lines(spans: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Adds line (from 0) and order per page. In order of the upper edge and x1 a span joins the first line whose running
    mean centre lies within 0.6 of the page's median height (1 at least); this depends on the order, so it is a fold per
    page. Lines are numbered by their upper edge. A page's spans are few; pages are the parallel units, and many are folded
    in one batch."""

    @F.pandas_udf("struct<span_id:array<long>,line:array<int>,order:array<int>>")
    def fold(ids: pd.Series, x1: pd.Series, y1: pd.Series, y2: pd.Series) -> pd.DataFrame:
        out = [line_numbers(list(map(int, i)), numbers(a), numbers(b), numbers(c)) for i, a, b, c in zip(ids, x1, y1, y2, strict=True)]
        return pd.DataFrame(out, columns=["span_id", "line", "order"])

    page = pages_of(spans, ("span_id", "x1", "y1", "y2"), keys).select(*keys, fold("s.span_id", "s.x1", "s.y1", "s.y2").alias("f"))
    return page.select(*keys, F.explode(F.arrays_zip("f.span_id", "f.line", "f.order")).alias("z")).select(*keys, "z.span_id", "z.line", "z.order")


def sessions(chars: DataFrame, gap_factor: float = 2.5, default_width: float = 4.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Characters (doc_id, page, i, ch, x1, y1, x2, y2) to spans: a new one after a line break, where vertical overlap
    with the character before is below a half, or after a gap of more than gap_factor median widths."""
    w = Window.partitionBy(*keys).orderBy("i")
    page = chars.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col("x2") > F.col("x1"), F.col("x2") - F.col("x1")), 0.5), F.lit(default_width)).alias("width"))
    lag = lambda c: F.lag(c).over(w)
    apart = (overlap(F.col("y1"), F.col("y2"), F.col("p_y1"), F.col("p_y2")) < 0.5) | (F.col("x1") - F.col("p_x2") > gap_factor * F.col("width"))
    marked = (
        chars.join(page, list(keys)).withColumns({"p_y1": lag("y1"), "p_y2": lag("y2"), "p_x2": lag("x2"), "p_ch": lag("ch")})
        .withColumn("new", F.coalesce((F.col("ch") == "\n") | (F.col("p_ch") == "\n") | apart, F.lit(True)).cast("int"))
        .withColumn("session", F.sum("new").over(w))
        .where("ch <> '\n'")
    )
    return marked.groupBy(*keys, "session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda s: s["ch"]), "").alias("text"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


def synthetic_layout(docs: DataFrame) -> DataFrame:
    """Lines of plain text as spans on pages: all lines are equally high, so page and place have a closed form. A line that
    begins above the bottom margin still belongs to its page; a line is as wide as its text, up to the room."""
    margin, pitch, char = int(MARGIN_IN * DPI), int(LINE_IN * DPI), int(CHAR_IN * DPI)
    per_page = (int(PAGE_H_IN * DPI) - 2 * margin) // pitch + 1
    stripped = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip)
    rows = docs.select("doc_id", F.posexplode(F.filter(stripped, lambda s: s != "")).alias("row", "text"))
    y1 = F.lit(margin) + (F.col("row") % per_page) * pitch
    x2 = F.lit(margin) + F.least(F.length("text") * char, F.lit(int(PAGE_W_IN * DPI) - 2 * margin))
    return rows.select(
        "doc_id", (F.floor(F.col("row") / per_page) + 1).cast("int").alias("page"), F.col("row").alias("order"), "text", F.lit(margin).alias("x1"), y1.alias("y1"), x2.alias("x2"), (y1 + pitch).alias("y2"),
    )


def places(heights: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Page, upper edge and number of the first span of each row of each document, from the rows' heights and numbers of
    spans. The next page begins as soon as the edge has passed the bottom margin; how far depends on all rows before, so it
    is a fold, linear in the rows of one document, which are one value already."""
    bottom, out = (PAGE_H_IN - MARGIN_IN) * DPI, []
    for hs, ns in zip(heights, spans, strict=True):
        page, y, first, own = 1, MARGIN_IN * DPI, 0, ([], [], [])
        for h, n in zip(hs, ns, strict=True):
            for values, value in zip(own, (page, y, first), strict=True):
                values.append(value)
            y, first = y + h, first + n
            if y > bottom:
                page, y, first = page + 1, MARGIN_IN * DPI, 0
        out.append(own)
    return pd.DataFrame(out, columns=["page", "y", "first"])


def block_layout(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs and tables, ``blocks`` of each document in order, as spans on pages: keys, page, order, text, block, row,
    col (null for paragraphs) and the box.

    ``blocks`` is array<struct<text, cells array<array<string>>, height>>: with ``cells`` a table, else a paragraph. Every
    row of a table moves on, also one without text; a blank paragraph does not. The cells of a row share its upper edge;
    columns are equally wide, as many as the longest row has. ``height`` is of each row, in pixels; without one (or below
    zero) it is a line's. Pages go on inside a table; a page without spans gives no rows but counts. Null blocks, rows and
    cells are empty ones. All in the document's own row: no shuffle."""
    line, room, left = LINE_IN * DPI, (PAGE_W_IN - 2 * MARGIN_IN) * DPI, MARGIN_IN * DPI
    full = lambda x: strip(F.coalesce(x, F.lit("")))
    nothing = F.array().cast("array<string>")

    def rows_of(b: Column, i: Column) -> Column:
        height = F.when(b["height"] >= 0, b["height"]).otherwise(line)
        cells = lambda r: F.filter(F.transform(F.coalesce(r, nothing), lambda c, k: F.struct(k.cast("int").alias("col"), full(c).alias("text"))), lambda c: c["text"] != "")
        wide = F.greatest(F.array_max(F.transform(b["cells"], lambda r: F.size(F.coalesce(r, nothing)))), F.lit(1))
        table = F.transform(b["cells"], lambda r, k: F.struct(i.cast("int").alias("block"), k.cast("int").alias("row"), height.alias("height"), (F.lit(room) / wide).alias("width"), cells(r).alias("cells")))
        alone = cells(F.array(b["text"]))
        paragraph = F.filter(
            F.array(F.struct(i.cast("int").alias("block"), F.lit(None).cast("int").alias("row"), height.alias("height"), F.least(F.length(full(b["text"])) * F.lit(CHAR_IN * DPI), F.lit(room)).alias("width"), alone.alias("cells"))),
            lambda r: F.size(r["cells"]) > 0,
        )
        return F.when(b["cells"].isNotNull(), table).otherwise(paragraph)

    rows = docs.select(*keys, F.flatten(F.transform("blocks", rows_of)).alias("rows")).where("size(rows) > 0")
    place = F.pandas_udf(places, "struct<page:array<int>,y:array<double>,first:array<int>>")
    placed = rows.withColumn("at", place(F.col("rows.height"), F.transform("rows", lambda r: F.size(r["cells"]))))
    each = placed.select(*keys, F.explode(F.arrays_zip("rows", F.col("at.page").alias("page"), F.col("at.y").alias("y"), F.col("at.first").alias("first"))).alias("z"))
    cells = each.select(*keys, "z.rows.block", "z.rows.row", "z.rows.height", "z.rows.width", "z.page", "z.y", "z.first", F.posexplode("z.rows.cells").alias("k", "c"))
    x1 = F.lit(left) + F.col("c.col") * F.col("width")
    return cells.select(
        *keys, "page", (F.col("first") + F.col("k")).alias("order"), "c.text", "block", "row", F.when(F.col("row").isNotNull(), F.col("c.col")).alias("col"),
        x1.alias("x1"), F.col("y").alias("y1"), (x1 + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"),
    )


def page_trust(pages: DataFrame) -> DataFrame:
    """Whether a page's text layer is used: too little text, or images over half of it, send it to OCR."""
    cover = F.least(F.coalesce(F.col("image_area") / F.col("page_area"), F.lit(0.0)), F.lit(1.0))
    reason = F.when(F.length(F.btrim(F.coalesce("text", F.lit("")))) < 40, "no_text_layer").when(
        cover >= 0.5, F.concat(F.lit("scanned_page(image_coverage="), F.bround(cover * 100, 0).cast("int").cast("string"), F.lit("%)"))
    )
    return pages.withColumn("image_coverage", cover).withColumn("ocr_reason", reason).withColumn("method", F.when(reason.isNull(), "pdf_text").otherwise("ocr"))


def row_separator(above: str, row: str) -> str:
    """Between wrapped rows: a comma where the row above is itself a comma list and neither edge is punctuation."""
    bare = above.rstrip()[-1:] not in ",;:-" and row.lstrip()[:1] not in ",;:-"
    return ", " if above.count(",") >= 2 and bare else " "


def whole_values(lines: list[int], ids: list[int], texts: list[str | None], like: list[bool], start: list[bool], x1: list[float], y1: list[float], x2: list[float], y2: list[float],
                 max_gap: float, max_row_gap: float, indent: float) -> tuple[list[int], list[str]]:
    """The spans of a page that are marked ``start``, and the whole value that begins at each."""
    usual = usual_height(y1, y2)
    rows: dict[int, list[int]] = {}
    for i in sorted(range(len(ids)), key=lambda i: (lines[i], known(x1[i]), ids[i])):
        rows.setdefault(lines[i], []).append(i)
    nothing = float("nan")
    boxes = [(row, min((y1[i] for i in row if y1[i] == y1[i]), default=nothing), max((y2[i] for i in row if y2[i] == y2[i]), default=nothing)) for row in rows.values()]

    def walk(row: list[int], first: int, unit: float) -> str:
        """Texts of a row from one span on."""
        parts, end = [texts[first] or ""], x2[first]
        for i in row:
            if not x1[i] > x1[first]:
                continue
            if (x1[i] - end) / unit > max_gap or like[i]:
                break
            parts.append(texts[i] or "")
            end = x2[i]
        return " ".join(parts)

    found: tuple[list[int], list[str]] = ([], [])
    for s in (i for row in rows.values() for i in row if start[i]):
        unit = y2[s] - y1[s] if y2[s] > y1[s] else usual
        text = walk(rows[lines[s]], s, unit)
        value, bottom, centre = text, y2[s], (y1[s] + y2[s]) / 2
        for row, top, low in boxes:
            if (top + low) / 2 <= centre:
                continue
            begin = row[0]  # the leftmost: another one within the indent would have it to its left
            if (top - bottom) / unit > max_row_gap or not x1[begin] <= x1[s] + indent * unit or abs(x1[begin] - x1[s]) > indent * unit or like[begin]:
                break
            above, text = text, walk(row, begin, unit)
            value += row_separator(above, text) + text
            bottom, centre = low, (top + low) / 2
        found[0].append(ids[s])
        found[1].append(value)
    return found


def continued_values(spans: DataFrame, max_gap: float = 1.2, max_row_gap: float = 1.6, indent: float = 2.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The whole value that begins at each span marked ``start``: (doc_id, page, span_id, value), or with the keys given.

    ``spans`` has span_id, text, line, label_like, start and the box. A value goes on over spans to its right until a wide
    gap or a caption, then over rows below that keep its left edge and follow closely. The walk stops at the first
    row that does not fit, so it is a fold over one page's lines; pages are the parallel units and small, and many are
    folded in one batch."""

    @F.pandas_udf("struct<span_id:array<long>,value:array<string>>")
    def fold(lines: pd.Series, ids: pd.Series, texts: pd.Series, like: pd.Series, start: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        out = [
            whole_values(list(map(int, n)), list(map(int, i)), list(t), list(k), list(b), *map(numbers, box), max_gap, max_row_gap, indent)
            for n, i, t, k, b, *box in zip(lines, ids, texts, like, start, x1, y1, x2, y2, strict=True)
        ]
        return pd.DataFrame(out, columns=["span_id", "value"])

    columns = ("line", "span_id", "text", "label_like", "start", "x1", "y1", "x2", "y2")
    page = pages_of(spans, columns, keys).where(F.exists("s.start", lambda b: b)).select(*keys, fold(*[f"s.{c}" for c in columns]).alias("f"))
    return page.select(*keys, F.explode(F.arrays_zip("f.span_id", "f.value")).alias("z")).select(*keys, "z.span_id", "z.value")
