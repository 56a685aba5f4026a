"""Lines of recognised forms (applications, certificates, questionnaires), over frames of lines (key, pos, line).

Only documents that look like a form are touched (``is_form``). Their national header, motto and salutation become bold, their
title a first-level heading, bold field labels plain, and a bullet that is no list item but a field, a blank to fill in or a
note loses its mark. Code fences, HTML tables, pipe rows and comments stay as they are.

Everything is columns and windows by document: fences, table depth, and the neighbours of a bullet are running values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip_accents

# Phrases (without accents) that make a document a form, in its first 8,000 characters.
SAMPLE = 8000
CUES = ["don xin", "don de nghi", "don dang ky", "mau don", "bieu mau", "giay xac nhan", "giay de nghi", "giay gioi thieu", "giay uy quyen", "giay cam ket", "phieu dang ky", "phieu yeu cau", "phieu de nghi", "phieu khao sat", "phieu thu thap", "kinh gui", "kinh goi"]
# What a form's title begins with.
TITLES = ["ĐƠN XIN", "ĐƠN ĐỀ NGHỊ", "ĐƠN ĐĂNG KÝ", "ĐƠN CAM KẾT", "ĐƠN KHIẾU NẠI", "ĐƠN TỐ CÁO", "GIẤY XÁC NHẬN", "GIẤY ĐỀ NGHỊ", "GIẤY GIỚI THIỆU", "GIẤY ỦY QUYỀN", "GIẤY CAM KẾT", "PHIẾU ĐĂNG KÝ", "PHIẾU YÊU CẦU", "PHIẾU ĐỀ NGHỊ", "PHIẾU KHẢO SÁT", "PHIẾU THU THẬP", "MẪU ĐƠN", "MẪU PHIẾU", "MẪU GIẤY"]
# Words (without accents) of which a field's label has one.
LABELS = [
    "toi ten", "ho va ten", "ho ten", "ten", "ngay sinh", "noi sinh", "gioi tinh", "dan toc", "ton giao", "ma so", "mssv", "sinh vien", "hoc vien", "nganh", "lop", "khoa", "nien khoa", "nam hoc",
    "cha", "me", "ho khau", "thuong tru", "tam tru", "dia chi", "dien thoai", "email", "cccd", "cmnd", "thuoc dien", "doi tuong", "hoan canh", "ly do", "noi dung", "khoa hoc", "don vi", "ngan hang",
    "tai khoan", "nguoi lien he", "quan he", "so the", "ngay", "thang", "nam",
]
# What opens a note, what a label never begins with, and the lines at the top.
NOTES, NO_LABELS, LONGEST = ["kem theo", "ghi chu", "ho so kem theo"], ["dieu ", "chuong ", "muc ", "phan "], 120
NATIONAL, MOTTO, SALUTATION = r"CỘNG H[ÒO]A X[ÃA] HỘI CHỦ NGHĨA VIỆT NAM", r"Độc lập *[-–—] *Tự do *[-–—] *Hạnh phúc", r"Kính g(?:ửi|ởi|ui|oi) *:"
_EDGE = " \\-–—:\\t"
_END = r"(?![\p{L}\p{N}_])"


def _any(phrases: list[str]) -> str:
    return "(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + ")"


def plain(c: Column) -> Column:
    """Text without underlining, emphasis and code marks, trimmed."""
    c = F.regexp_replace(c, "(?i)</?u>", "")
    for mark in (r"\*\*(.*?)\*\*", r"__(.*?)__", r"(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "_(.*?)_", "`(.*?)`"):
        c = F.regexp_replace(c, mark, "$1")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def spaced(c: Column) -> Column:
    """One space at most, none before a mark, one on both sides of a colon."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+([,.;])", "$1"), r"\s*:\s*", " : "), r"\s{2,}", " "))


def _folded(c: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), f"[^a-z0-9\\s{keep}]+", " "), r"\s+", " "))


def is_form(text: Column) -> Column:
    """Whether the first characters of a text hold one of the phrases."""
    return F.coalesce(_folded(plain(F.substring(text, 1, SAMPLE)), "").rlike(rf"\b{_any(CUES)}\b"), F.lit(False))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), f"^[{_EDGE}]+|[{_EDGE}]+$", "")


def is_label(c: Column) -> Column:
    """Whether a text before a colon looks like a field's label: not empty, at most ``LONGEST`` characters, no sentence end, one of the words."""
    clean = _bare(plain(c))
    other = "|".join(NO_LABELS)
    return clean.rlike(rf"(?s)^.{{0,{LONGEST - 1}}}[^.;!?]$") & _folded(clean, "/().\\-").rlike(rf"^(?!{other}).*\b{_any(LABELS)}\b")


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """Each match replaced by ``by`` of its first group, or kept where that is null."""
    between = F.split(text, pattern, -1)
    found, group = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, 1))
    new = F.concat(F.zip_with(found, group, lambda m, g: F.coalesce(by(g), m)), F.array(F.lit("")))
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")).otherwise(text)


# Field labels in bold: whole, with the colon inside, and two broken forms.
BOLD_LABELS = [r"\*\*([^*\n:]{1,120}?)\*\*\s*:", r"\*\*([^*\n]{1,120}?:)\*\*", r"(?<!\*)\*([^*\n:]{1,120}?)\*\*\s*:", r"(?<!\*)\b([^*\n:]{1,120}?)\*\*\s*:"]


def plain_labels(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with field labels of the column ``name`` without the bold around them; bold text that is no label stays. A column for each step, so that no expression is repeated."""
    label = lambda g: F.when(is_label(F.regexp_replace(g, r"\s*:$", "")), F.concat(plain(F.regexp_replace(g, r"\s*:$", "")), F.lit(":")))
    for pattern in BOLD_LABELS:
        rows = rows.withColumn(name, F.when(F.col(name).contains("**"), replaced(F.col(name), pattern, label)).otherwise(F.col(name)))
    return rows


def is_field(clean: Column) -> Column:
    """A plain line with a label before its first colon, or after a comma or semicolon and before another."""
    more = F.regexp_extract_all(clean, F.lit(r"[,;]\s*([^,;:\n]{1,120}?)\s*:"), F.lit(1))
    return clean.contains(":") & (is_label(F.substring_index(clean, ":", 1)) | F.exists(more, is_label))


def top_line(clean: Column, title: Column) -> Column:
    """A tidy line, and the same without tags and edges, as header, motto, title or salutation; null if it is none."""
    bold = lambda p: clean.rlike(f"(?iu)^{p}")
    loose = lambda p: p.replace(" *", "\0").replace(" ", r"\s+").replace("\0", r"\s*")
    starred = F.concat(F.lit("**"), clean, F.lit("**"))
    return F.when(bold(loose(NATIONAL) + r"\s*$") | bold(loose(MOTTO) + r"\s*$"), starred).when(title.rlike(f"(?iu)^{_any(TITLES)}{_END}"), F.concat(F.lit("# "), title)).when(bold(loose(SALUTATION)), starred)


def form_lines(rows: DataFrame, key: str = "doc_id", form: str = "is_form") -> DataFrame:
    """``rows`` (key, pos, line, and ``form``: whether the document is one) with the lines of forms repaired."""
    before = Window.partitionBy(key).orderBy("pos")
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    line, names = F.col("line"), rows.columns
    fence = F.trim("line").startswith("```")
    r = rows.withColumn("_fence", fence).withColumn("_fenced", fence | (F.sum(fence.cast("int")).over(upto) % 2 == 1))
    opens, closes = (F.size(F.regexp_extract_all(line, F.lit(p), F.lit(0))) for p in ("(?i)<table\\b", "(?i)</table>"))
    r = r.withColumn("_opens", F.when(F.col("_fenced"), 0).otherwise(opens)).withColumn("_sum", F.sum(F.when(F.col("_fenced"), 0).otherwise(F.col("_opens") - closes)).over(upto))
    # depth never falls below zero: what the running sum stands above its least value so far
    r = r.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    filled = F.when(F.trim("line") != "", F.ltrim(line).rlike(r"^[-*•][ \t]+.*$"))
    r = r.withColumn("_filled", filled).withColumns({"_above": F.last("_filled", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)), "_below": F.first("_filled", ignorenulls=True).over(before.rowsBetween(1, Window.unboundedFollowing))})
    r = r.withColumn("_inside", F.coalesce(F.lag("_depth").over(before), F.lit(0)) > 0)
    kept = F.col("_fenced") | F.col("_inside") | (F.col("_opens") > 0) | F.ltrim(line).startswith("|") | F.ltrim(line).startswith("<!--")
    bullet = F.coalesce(F.col("_filled"), F.lit(False))
    works = F.coalesce(F.col(form), F.lit(False)) & ~kept
    # from here on the text that is worked on, null for lines that stay
    r = r.withColumn("_bullet", bullet).withColumn("_text", F.when(works, F.when(bullet, F.regexp_extract(F.ltrim(line), r"^[-*•][ \t]+(.*)$", 1)).otherwise(line)))
    heading = F.regexp_extract(line, r"^#{1,6}\s+(.*?)\s*$", 1)
    r = r.withColumn("_clean", F.when(works, F.when(line.rlike(r"^#{1,6}\s+.*$"), heading).otherwise(F.trim(line)))).withColumn("_clean", spaced(plain(F.col("_clean"))))
    r = r.withColumn("_title", _bare(F.col("_clean"))).withColumn("_top", top_line(F.col("_clean"), F.col("_title")))
    r = plain_labels(r, "_text").withColumn("_text", F.when(F.col("_bullet"), F.trim("_text")).otherwise(F.col("_text"))).withColumn("_plain", plain(F.col("_text")))
    listed = F.coalesce(F.col("_above"), F.lit(False)) | F.coalesce(F.col("_below"), F.lit(False))
    note = F.lower(strip_accents(F.col("_plain"))).rlike(rf"^\(?\s*{_any(NOTES)}\b")
    blank = F.col("_plain").rlike(r"^[. …_\-,，:;()\[\]{}]*$")
    loosened = F.when(~F.col("_bullet"), F.col("_text")).when(listed, F.concat(F.lit("- "), "_text")).when(is_field(F.col("_plain")) | blank | note, F.col("_text"))
    r = r.withColumn("_loose", loosened).withColumn("_whole", F.when(F.col("_text").isNotNull() & F.col("_loose").isNull() & F.col("_top").isNull(), line))
    r = plain_labels(r, "_whole")  # a bullet that stays one
    return r.withColumn("line", F.coalesce("_top", "_loose", "_whole", "line")).select(*names)
