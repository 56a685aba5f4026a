"""Repair of recognised Markdown, over frames of lines (doc_id, pos, line): escapes, heading levels, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip_accents
from docloom.operators import forms, tables
from docloom.sources.shared import dealt

HEADING, NUMBERED = r"^(#{1,6})\s+(.+)$", r"^(\d+(?:\.\d+)*)\.\s+.+$"
# What opens an article, the caption of a seal, and the phrases of section rows inside tables.
ARTICLE, CAPTION = "Điều", "seal and signature of"
SECTION_PHRASES = ["khung diem", "danh gia ve", "tieu chi de xac dinh"]


def _upto(key: str):
    return Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def fenced(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with ``in_fence``: code fences and what stands between them."""
    mark = F.col("line").rlike(r"^\s*```")
    return rows.withColumn("in_fence", mark | (F.sum(mark.cast("int")).over(_upto(key)) % 2 == 1))


def unescaped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines outside fences without escapes of list marks, bold around headings and seal captions; empty emphasis goes."""
    line = F.regexp_replace("line", r"^\*\*(#{1,6}\s+.+?)\*\*$", "$1")
    line = F.regexp_replace(F.regexp_replace(line, r"^(\s*)\\+([-+*])(?=\s)", "$1$2"), r"^(\s*\d+)\\+\.(?=\s)", "$1.")
    caption = F.regexp_extract(line, rf"(?i)^{CAPTION}\s+(.+)$", 1)
    line = F.when(caption != "", F.concat(F.lit("**"), F.trim(caption), F.lit("**"))).otherwise(line)
    bare = F.regexp_replace("line", r"\s", "")
    rows = fenced(rows, key).withColumn("line", F.when(F.col("in_fence"), F.col("line")).otherwise(line))
    return rows.where(F.col("in_fence") | ~(bare.rlike(r"^[*\\]+$") & bare.contains("\\"))).drop("in_fence")


def _most(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, name, n): the most frequent level of each group, the one met first in ties, and the number of headings."""
    counted = df.groupBy(*by, "level").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy(*by).agg(F.max_by("level", F.struct("n", -F.col("first"))).alias(name), F.sum("n").alias("n"))


def _most_over(r: DataFrame, head: Column, by: list[str], name: str) -> DataFrame:
    """``r`` with the most frequent level of each row's group, the one met first in ties, and ``n_``: its headings; by windows."""
    alike = Window.partitionBy(*by, "level")
    r = r.withColumn("_head", head).withColumns({"_n": F.sum(F.col("_head").cast("int")).over(alike), "_first": F.min(F.when(F.col("_head"), F.col("pos"))).over(alike)})
    order = F.when(F.col("_head"), F.struct("_n", -F.col("_first")))
    whole = Window.partitionBy(*by)
    return r.withColumns({name: F.max_by("level", order).over(whole), f"n_{name}": F.sum(F.col("_head").cast("int")).over(whole)}).drop("_head", "_n", "_first")


def repaired_headings(rows: DataFrame, key: str = "doc_id", deal: bool = True) -> DataFrame:
    """Headings of one family get its most frequent level, and unmarked siblings become headings.

    A family holds the numbers under one parent number, or the articles, between two first-level titles. A title that
    repeats becomes bold text. Unmarked lines join a family of two headings or more; two or more of them under a marked
    number take the most frequent level of that depth. Rows are dealt by document into parts of bounded size, unless they
    come so (``deal``); all windows are of one document.
    """
    rows = dealt(rows, key) if deal else rows
    level = F.length(F.regexp_extract("line", HEADING, 1))
    r = fenced(rows, key).withColumn("level", F.when(~F.col("in_fence") & (level > 0), level))
    r = r.withColumn("body", F.when(F.col("level").isNotNull(), F.regexp_extract("line", HEADING, 2)).otherwise(F.col("line")))
    number = F.regexp_replace(F.regexp_extract("body", NUMBERED, 1), r"(^|\.)0+(?=\d)", "$1")
    r = r.withColumn("number", F.when(~F.col("in_fence"), F.nullif(number, F.lit("")))).withColumn("article", ~F.col("in_fence") & F.col("body").rlike(rf"(?iu)^{ARTICLE}\s+\d+\."))
    title = F.when((F.col("level") == 1) & F.col("number").isNull(), F.lower(F.trim(F.regexp_replace("body", r"[:\s]+", " "))))
    r = r.withColumn("title", title).withColumn("nth", F.row_number().over(Window.partitionBy(key, "title").orderBy("pos")))
    again = F.col("title").isNotNull() & (F.col("nth") > 1)
    r = r.withColumn("again", again).withColumn("part", F.sum(F.when(F.col("title").isNotNull() & (F.col("nth") == 1), 1).otherwise(0)).over(_upto(key)))
    depth = F.size(F.split("number", r"\."))
    r = r.withColumn("parent", F.when(F.col("number").isNotNull(), F.regexp_replace("number", r"\.?\d+$", ""))).withColumn("depth", F.when(F.col("number").isNotNull(), depth))
    family = F.when(~F.col("again"), F.when(F.col("number").isNotNull(), F.concat(F.lit("n"), "parent")).when(F.col("article"), F.lit("a")))
    r = r.withColumn("family", family)
    missing = F.col("family").isNotNull() & F.col("level").isNull() & (F.col("article") | (F.col("depth") > 1))
    r = r.withColumn("missing", F.coalesce(missing, F.lit(False)))
    head = F.col("family").isNotNull() & F.col("level").isNotNull()
    r = _most_over(r, head, [key, "part", "family"], "canon")
    r = r.withColumn("n_lost", F.sum(F.col("missing").cast("int")).over(Window.partitionBy(key, "part", "family")))
    r = _most_over(r, head & F.col("number").isNotNull(), [key, "part", "depth"], "deep")
    # a numbered heading stands once more under its own number, so that its children see it as their parent
    r = r.withColumn("_mark", F.explode(F.when(head & F.col("number").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    r = r.withColumn("_under", F.when(F.col("_mark"), F.col("number")).otherwise(F.col("parent"))).withColumn("node", F.max("_mark").over(Window.partitionBy(key, "part", "_under")))
    r = r.where(~F.col("_mark"))
    marks = lambda n: F.repeat(F.lit("#"), n)
    line = F.col("line")
    out = (
        F.when(F.col("again"), F.concat(F.lit("**"), F.regexp_replace("body", r"^[*_ ]+|[*_ ]+$", ""), F.lit("**")))
        .when(F.col("family").isNotNull() & F.col("level").isNotNull(), F.concat(marks(F.col("canon")), F.expr("substring(line, level + 1)")))
        .when(F.col("missing") & (F.col("n_canon") >= 2), F.concat(marks(F.col("canon")), F.lit(" "), line))
        .when(F.col("missing") & ~F.col("article") & (F.col("n_lost") >= 2) & F.col("node") & F.col("deep").isNotNull(), F.concat(marks(F.col("deep")), F.lit(" "), line))
        .otherwise(line)
    )
    return r.withColumn("line", out).select(*rows.columns)


# ---- pipe tables

_DASHES = r"^\s*:?-+:?\s*$"


def row_cells(line: Column) -> Column:
    """The trimmed cells of a table row, also of one that lacks outer pipes; a leading pipe alone opens an empty cell."""
    s = F.trim(line)
    inner = F.when(s.startswith("|") & s.endswith("|") & (F.length(s) > 1), F.expr("substring(trim(line), 2, length(trim(line)) - 2)")).otherwise(F.regexp_replace(s, r"\|$", ""))
    return F.transform(F.split(inner, r"\|", -1), lambda x: F.trim(x))


def cell_key(c: Column) -> Column:
    """What of a cell counts in comparisons: no heading marks, emphasis, tags or accents, lower case, and only letters, digits and / . - between single spaces."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^#+\s*", ""), r"^[*_` \t]+|[*_` \t]+$", "")
    c = F.lower(strip_accents(F.regexp_replace(c, "<[^>]+>", "")))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9/.\-\s]+", " "), r"\s+", " "))


def _is_section(cell: Column, key: Column) -> Column:
    out = cell.startswith("**") | key.rlike(r"^(?:[a-z]|\d+)\.\s+") | key.startswith("dieu ")
    for phrase in SECTION_PHRASES:
        out = out | key.contains(phrase)
    return out


def compacted(cells: Column) -> Column:
    """Runs of equal cells as one cell where they look like a spread title: section cells, or three of 25 characters and more."""
    keyed = F.transform(cells, lambda x: F.struct(cell_key(x).alias("key"), x.alias("cell")))
    none = F.array().cast("array<struct<key:string,cells:array<string>>>")
    last = lambda acc: F.element_at(acc, -1)
    joins = lambda acc, x: (F.size(acc) > 0) & (x["key"] != "") & (F.try_element_at(acc, F.lit(-1))["key"] == x["key"])
    more = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(x["key"].alias("key"), F.array_append(last(acc)["cells"], x["cell"]).alias("cells"))))
    runs = F.aggregate(keyed, none, lambda acc, x: F.when(joins(acc, x), more(acc, x)).otherwise(F.array_append(acc, F.struct(x["key"].alias("key"), F.array(x["cell"]).alias("cells")))))

    def one(r: Column) -> Column:
        cell, n = r["cells"][0], F.size(r["cells"])
        spread = (n > 1) & (r["key"] != "") & ~cell.rlike(_DASHES) & ~r["key"].rlike(r"^\d+(?:[.,]\d+)?$")
        return F.when(spread & (_is_section(cell, r["key"]) | ((n >= 3) & (F.length(r["key"]) >= 25))), F.array(cell)).otherwise(r["cells"])

    return F.flatten(F.transform(runs, one))


def _without_prefix(cells: Column) -> Column:
    """Header cells without a text of 20 characters or more that stands before the last line break of all of them."""
    parts = F.transform(cells, lambda x: F.split(x, r"(?i)<br\s*/?>", -1))
    heads = F.array_distinct(F.transform(parts, lambda p: F.trim(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "<br/>"))))
    same = (F.size(cells) > 1) & F.forall(parts, lambda p: F.size(p) > 1) & (F.size(heads) == 1) & (F.length(heads[0]) >= 20)
    return F.when(same, F.transform(parts, lambda p: F.trim(F.element_at(p, -1)))).otherwise(cells)


def repaired_tables(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line, ...): pipe tables with equal widths, outer pipes and one separator; other lines as they are.

    A table starts at a row with both outer pipes, or at a loose row above a separator, and reaches as far as rows have
    pipes. Spread titles are compacted, empty columns at the end go (numbered stand-in headers count as empty), separators
    between rows go, and a repeated header prefix goes.
    """
    s = F.trim("line")
    strict = s.startswith("|") & s.endswith("|") & (F.length(s) > 1)
    pipe = strict | (s.contains("|") & ~s.startswith("<!--"))
    cells = row_cells(F.col("line"))
    ruler = (F.size(cells) > 1) & F.forall(cells, lambda x: x.rlike(r"^:?-{2,}:?$"))
    w = Window.partitionBy(key).orderBy("pos")
    r = rows.withColumns({"pipe": pipe, "ruler": ruler}).withColumn("opens", F.col("pipe") & (strict | F.coalesce(F.lead("ruler").over(w), F.lit(False))))
    r = r.withColumn("run", F.sum(F.when(F.col("pipe") & ~F.coalesce(F.lag("pipe").over(w), F.lit(False)), 1).otherwise(0)).over(_upto(key)))
    in_run = Window.partitionBy(key, "run", "pipe").orderBy("pos")
    r = r.withColumn("inside", F.col("pipe") & F.max("opens").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    table = Window.partitionBy(key, "run", "inside")
    tidy = F.transform(row_cells(F.col("line")), lambda x: F.regexp_replace(x, r"^\\+\*(?=\s)", "•"))
    r = r.withColumn("idx", F.row_number().over(table.orderBy("pos")) - 1).withColumn("cells", F.when(F.col("inside"), compacted(tidy)))
    counts = lambda x: (x != "") & ~x.rlike(_DASHES) & ~((F.col("idx") == 0) & x.rlike(r"(?i)^Cột\s+\d+$"))
    used = F.array_max(F.transform("cells", lambda x, i: F.when(counts(x), i + 1).otherwise(0)))
    r = r.withColumn("used", used).withColumn("width", F.greatest(F.lit(1), F.max("used").over(table))).withColumn("n_rows", F.count("*").over(table)).withColumn("ruled", F.max(F.when((F.col("idx") == 1) & F.col("ruler"), True).otherwise(False)).over(table))
    full = F.when(F.col("inside"), F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.get("cells", i - 1), F.lit(""))))
    r = r.withColumn("cells", full)
    blank = F.forall("cells", lambda x: (x == "") | x.rlike(_DASHES))
    r = r.where(~F.col("inside") | (F.col("n_rows") <= 2) | (F.col("idx") == 1) | ~blank)
    r = r.withColumn("n", F.row_number().over(table.orderBy("pos")) - 1)
    r = r.withColumn("cells", F.when(F.col("inside") & (F.col("n") == 0), _without_prefix(F.col("cells"))).otherwise(F.col("cells")))
    shown = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    rule = shown(F.array_repeat(F.lit("---"), F.col("width").cast("int")))
    own = F.array(shown(F.col("cells")))
    empty = F.forall("cells", lambda x: x == "")
    lines = F.when(~F.col("inside"), F.array("line")).when((F.col("n") == 1) & F.col("ruled"), F.array(rule)).when((F.col("n") == 1) & empty, F.concat(F.array(rule), own)).otherwise(own)
    more = [c for c in rows.columns if c not in (key, "pos", "line")]
    return r.select(key, "pos", *more, F.posexplode(lines).alias("sub", "line")).select(key, (F.col("pos") * 2 + F.col("sub")).alias("pos"), "line", *more)


def postprocessed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every document after seven steps: escapes, lines of forms, headings, tables cut by pages, HTML tables as pipe
    tables, pipe tables, blank lines. Front matter stays as it is before them; a null text is empty, and an emptied one a line end.

    One shuffle by document; every step after it is windows and groups whose keys begin with the document's. Rows that
    repeat a key are one document, so keys must tell documents apart.
    """
    # the gate of forms is taken from the text with escapes off, before it is parted into lines
    tidy = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    front = F.regexp_extract(tidy, r"\A(\s*---[ \t]*\n(?s:.*?\n)??[ \t]*---[ \t]*(?:\n|\z))", 1)
    front = F.when(tidy.rlike(r"\A[ \t]*---[ \t]*\n"), front).otherwise("")
    d = docs.select(key, front.alias("front"), tidy.alias("t")).withColumn("t", F.expr("substring(t, length(front) + 1)"))
    loose = F.regexp_replace(F.regexp_replace("t", r"(?m)^\*\*(#{1,6}\s+.+?)\*\*$", "$1"), r"(?m)^(\s*\d*)\\+([-+*.])(?=\s)", "$1$2")
    # an empty last line keeps a document whose other lines all go
    d = d.select(key, "front", forms.is_form(loose).alias("is_form"), F.array_append(F.split("t", "\n"), F.lit("")).alias("lines"))
    d = dealt(d, key, rows=docs.agg(F.sum(F.size(F.split(text, "\n")) + 1)).first()[0] or 0)
    rows = d.select(key, "front", "is_form", F.posexplode("lines").alias("pos", "line"))
    rows = repaired_headings(forms.form_lines(unescaped(rows, key), key), key, deal=False)

    def whole(r: DataFrame) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
        return r.groupBy(key).agg(F.first("front").alias("front"), F.array_join(lines, "\n").alias("t"))

    body = tables.with_pipe_tables(whole(rows).withColumn("t", tables.continued(F.col("t"))), "t")
    out = whole(repaired_tables(body.select(key, "front", F.posexplode(F.split("t", "\n")).alias("pos", "line")), key))
    end = F.concat(F.regexp_replace(F.regexp_replace("t", r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
    return out.select(key, F.when(F.col("front") != "", F.concat(F.regexp_replace("front", r"\s+$", ""), F.lit("\n\n"), end)).otherwise(end).alias(text))


def heading_modes(rows: DataFrame, key: str = "doc_id", family: str = "family") -> DataFrame:
    """(key, family, canon, n): the most frequent level of every family of headings (key, family, level, pos)."""
    return _most(rows, [key, family], "canon")


def bullet_inside(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that are not blank, with ``inside``: whether the nearest such lines on both sides are bullets."""
    w = Window.partitionBy(key).orderBy("pos")
    r = rows.where(F.trim("line") != "").withColumn("bullet", F.col("line").rlike(r"^\s*[-+*•]\s"))
    return r.withColumn("inside", F.coalesce(F.lag("bullet").over(w), F.lit(False)) & F.coalesce(F.lead("bullet").over(w), F.lit(False)))
