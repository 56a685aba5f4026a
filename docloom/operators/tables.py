"""Tables inside pages: HTML tables with spans become pipe tables; a table without a head takes the one before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalize_key, strip_tags

#: Marks around inline runs, and the widest span that a cell may ask for (as in the HTML standard).
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
MOST_COLUMNS = 1000
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")
#: What heads a column without a header; %d is its place.
NUMBERED = "Cột %d"


class Cell:
    """A cell under construction: lines of inline pieces, and how many rows and columns it covers."""

    def __init__(self, attributes: dict[str, str | None]):
        self.lines: list[list[str]] = [[]]
        self.down, self.across = (int(d) if (d := "".join(c for c in (attributes.get(n) or "") if c in "0123456789")) and int(d) > 0 else 1 for n in ("rowspan", "colspan"))
        if self.across > MOST_COLUMNS:
            self.across = 1

    def text(self) -> str:
        """Lines joined by breaks, white space collapsed, pipes escaped."""
        return "<br>".join(_BLANKS.sub(" ", "".join(line)).strip(" ") for line in self.lines).replace("|", "\\|")


class Reader(HTMLParser):
    """Collects each table's rows of cells as (is in the head, cells). Tables inside cells become tables after it."""

    def __init__(self, source: str):
        super().__init__()
        self.tables: list[list[tuple[bool, list[Cell]]]] = []
        self.open: list[dict] = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "head": False, "cell": None})
        if not self.open:
            return
        at = self.open[-1]
        if tag == "thead":
            at["head"] = True
        elif tag == "tr":
            at["cell"] = None
            at["rows"].append((at["head"], []))
        elif tag in ("td", "th") and at["rows"]:
            at["cell"] = Cell(dict(attrs))
            at["rows"][-1][1].append(at["cell"])
        elif at["cell"] and tag == "br":
            at["cell"].lines.append([])
        elif at["cell"]:
            self._piece(MARKS.get(tag, "" if tag == "u" else " "))

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        at = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag == "thead":
            at["head"] = False
        elif tag in ("td", "th", "tr"):
            at["cell"] = None
        else:
            self._piece(MARKS.get(tag, "" if tag in ("u", "br") else " "))

    def handle_data(self, data: str) -> None:
        self._piece(data)

    def _piece(self, text: str) -> None:
        if self.open and (cell := self.open[-1]["cell"]):
            cell.lines[-1].append(text)


def _is_number(text: str) -> bool:
    """A row's own number or letter: up to four digits and perhaps a letter, marks and full stops aside."""
    t = text.lower().strip(" .*")
    digits = t[:-1] if t[-1:].isalpha() and t[-1:].isascii() else t
    return 1 <= len(digits) <= 4 and digits.isascii() and digits.isdigit()


def grid(rows: list[list[Cell]]) -> list[list[str]]:
    """Texts by place. A cell fills the columns it spans, and those rows below that the table has; a number in the first column only its own row."""
    below: dict[int, tuple[int, str]] = {}  # column: (rows left, text)
    out: list[list[str]] = []
    for cells in rows:
        if not cells:
            continue
        row: list[str] = []
        waiting = list(cells)
        then = {k: (n - 1, t) for k, (n, t) in below.items() if n > 1}
        while waiting or len(row) in below:
            if len(row) in below:
                row.append(below[len(row)][1])
                continue
            cell = waiting.pop(0)
            text = cell.text()
            for _ in range(cell.across):
                if cell.down > 1:
                    then[len(row)] = (cell.down - 1, "" if not row and _is_number(text) else text)
                row.append(text)
        below = then
        out.append(row)
    return out


def pipe_table(header: list[list[str]], rows: list[list[str]]) -> str:
    """A pipe table under one header line: what differs in a column's header rows is joined, and a column without is numbered."""
    width = max((len(r) for r in (*header, *rows)), default=0)
    if not width:
        return ""
    column = lambda k: dict.fromkeys(r[k] for r in header if k < len(r) and r[k])
    head = [" / ".join(column(k)) or NUMBERED % (k + 1) for k in range(width)]
    return "\n".join(f"| {' | '.join(cells)} |" for cells in (head, ["---"] * width, *(r + [""] * (width - len(r)) for r in rows)))


def page_tables(source: str) -> list[tuple[str, bool]]:
    """(pipe table, whether its header was taken over) of a document's tables in order."""
    out, before = [], []
    for table in Reader(source).tables:
        own, rows = grid([c for head, c in table if head]), grid([c for head, c in table if not head])
        out.append((pipe_table(own or before, rows), not own and bool(before)))
        before = own or before
    return out


def html_tables(docs: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, place, table, inherited) of every table. Null texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, t, taken) for k, source in zip(f[key], f[text], strict=True) for n, (t, taken) in enumerate(page_tables(source or ""))]
            yield pd.DataFrame(rows, columns=[key, "place", "table", "inherited"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, place int, table string, inherited boolean")


# ---- tables cut by a page end

TABLE, HEAD, GAP_LINE = r"(?is)<table\b.*?</table>", r"(?is)<thead\b.*?</thead>", r"^(?:|---|<!--.*-->|\d+)$"
# Words (without accents) of a true header, and what a cell cut by a page ends with and the rest of it begins with.
HEADER_WORDS = ["tt", "noi dung", "lan", "ghi chu", "buoc", "luu do", "nguoi thuc hien", "thoi gian", "hinh thuc xu ly"]
CUT_CELLS = [("cảnh", "cao ")]


def page_gap(gap: Column) -> Column:
    """Whether only blank lines, rules, comments and page numbers stand between two tables."""
    return F.forall(F.split(gap, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).rlike(GAP_LINE))


def false_head(table: Column) -> Column:
    """The text of a head that has none of a header's words: the rest of a cell that the page end cut. Null without one."""
    head = F.regexp_extract(table, HEAD, 0)
    key = normalize_key(head)
    true_head = key.rlike("|".join(HEADER_WORDS))
    return F.when((head != "") & ~((key != "") & true_head), F.nullif(strip_tags(head), F.lit("")))


def _joined_on(table: Column, rest: Column, cut_cells: list[tuple[str, str]]) -> Column:
    """The table with ``rest`` at the end of its last cell that was cut before it."""
    out = table
    for ending, beginning in cut_cells:
        last = rf"(?isu)^(.*<td\b[^>]*>.*{ending})(\s*</td>)"
        fits = F.concat(normalize_key(rest), F.lit(" ")).startswith(beginning) & table.rlike(last)
        whole = F.concat(F.regexp_extract(table, last, 1), F.lit(" "), rest, F.regexp_replace(F.regexp_extract(table, last, 2), r"^\s+", ""))
        out = F.when(fits, F.concat(whole, F.substring(table, F.length(F.regexp_extract(table, last, 0)) + 1, F.length(table)))).otherwise(out)
    return out


def continued(text: Column, cut_cells: list[tuple[str, str]] = CUT_CELLS) -> Column:
    """A text whose tables, parted by page ends alone, lose the false head that holds the rest of the cell before.

    Each pair of neighbours is tested by itself: a table's own false head goes if the gap before it is a page end, and the
    next one's rest is joined on if the gap after it is. So chains over any number of pages are one transformation.
    """
    tables, gaps = F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)), F.split(text, TABLE, -1)
    rest = F.transform(tables, lambda t, i: F.when((i > 0) & page_gap(F.get(gaps, i)), false_head(t)))

    def one(t: Column, i: Column) -> Column:
        own = F.when(F.get(rest, i).isNotNull(), F.regexp_replace(t, HEAD.replace("(?is)", r"(?is)^(.*?)"), "$1")).otherwise(t)
        after = F.get(rest, i + 1)
        return F.when(after.isNotNull(), _joined_on(own, after, cut_cells)).otherwise(own)

    whole = F.zip_with(gaps, F.concat(F.transform(tables, one), F.array(F.lit(""))), lambda g, t: F.concat(g, t))
    return F.when(F.size(tables) > 1, F.array_join(whole, "")).otherwise(text)


def with_pipe_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every HTML table of ``text`` as a pipe table in its place; only texts that have one go through Python."""

    @F.pandas_udf("array<string>")
    def pipes(found: pd.Series) -> pd.Series:
        return found.map(lambda tables: [t for t, _ in page_tables("".join(tables))] if tables is not None and len(tables) else [])

    tables, gaps = F.regexp_extract_all(F.col(text), F.lit(TABLE), F.lit(0)), F.split(F.col(text), TABLE, -1)
    made = docs.withColumn("_pipes", pipes(F.coalesce(tables, F.array().cast("array<string>"))))
    whole = F.zip_with(gaps, F.concat("_pipes", F.array(F.lit(""))), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return made.withColumn(text, F.when(F.size("_pipes") > 0, F.array_join(whole, "")).otherwise(F.col(text))).drop("_pipes")
