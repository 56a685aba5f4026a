"""Text, key and path functions as Column expressions; Python runs only in ``comparison_text``, by Arrow batch."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations and their full names.
ABBREVIATIONS = {
    "bhyt": "bảo hiểm y tế",
    "ctsv": "công tác sinh viên",
    "ktx": "ký túc xá",
    "pctsv": "phòng công tác sinh viên",
    "pdt": "phòng đào tạo",
    "nvqs": "nghĩa vụ quân sự",
}
# Words that never become search terms.
STOP_WORDS = (
    "ai bao các cho có của đã để đến điều được gì hay khi là lại mà mỗi một nào như những ở đâu phải sau sẽ sinh số từ theo thì trong và về với vào"
).split()
# File types by extension.
FILE_TYPES = {
    "pdf": "pdf", "doc": "doc", "docx": "docx", "pptx": "pptx", "md": "md", "html": "html", "txt": "txt", "png": "image", "jpg": "image",
    "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image", "xlsx": "xlsx", "csv": "csv",
}

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
_PLAIN = "".join("d" if c == "đ" else unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def accent_table() -> tuple[str, str]:
    """Accented letters and their plain ones, small then capital, each once: a letter that came twice would shift all after it."""
    pairs = [*zip(_ACCENTED, _PLAIN, strict=True)]
    pairs += [(a.upper(), b.upper()) for a, b in pairs]
    once = dict(reversed(pairs))
    return "".join(once), "".join(once.values())


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks, đ as d; precomposed Latin letters only."""
    return F.translate(col(c), *accent_table())


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[ \t\n\r\f\x0B]+", " "))


def normalize_query(c: Column | str) -> Column:
    """Lower case, single spaces, no punctuation at the end."""
    return F.regexp_replace(collapse(F.lower(col(c))), r"[?!.,;:]+$", "")


def expand_abbreviations(c: Column | str) -> Column:
    """Each known abbreviation that stands alone as its full name; longer ones first."""
    out = col(c)
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}_]){short}(?![\p{{L}}\p{{N}}_])", ABBREVIATIONS[short])
    return out


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def search_terms(c: Column | str) -> Column:
    """Distinct words of two characters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS)))


def comparison_text(c: Column | str) -> Column:
    """Text for comparisons: compatibility forms as plain ones (NFKC), case folded, white space as single spaces. Null stays null.

    Compatibility forms and full case folding are no SQL functions, so this is one Arrow batch of Python at a time.
    """

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(t.split()).casefold() if t.isascii() else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return folded(col(c))


def token_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def slugify(c: Column | str) -> Column:
    """Accents off, lower case, other runs as one hyphen; 'untitled' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def strip_tags(c: Column | str) -> Column:
    """Line breaks and tags as spaces, non-breaking spaces plain, runs of space as one."""
    s = F.regexp_replace(col(c), "(?i)<br[ /]*>", " ")
    s = F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), "&nbsp;| ", " ")
    return collapse(s)


def normalize_key(c: Column | str) -> Column:
    """A comparison key: no heading marks, tags, emphasis, accents or punctuation."""
    s = F.regexp_replace(strip_tags(F.regexp_replace(col(c), "^#+", "")), "[*_`#|]", "")
    return collapse(F.regexp_replace(F.lower(strip_accents(s)), "[^a-z0-9 ]+", " "))


def inline_markdown(c: Column | str) -> Column:
    """Text without emphasis, code marks and link targets."""
    s = F.regexp_replace(col(c), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\*\*([^*]+)\*\*", "$1"), r"__([^_]+)__", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\*([^*]+)\*", "$1"), "`([^`]+)`", "$1")
    return collapse(s)


def tidy_blank_lines(c: Column | str) -> Column:
    """At most two blank lines in a row, trimmed, one newline at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(col(c), "\n{4,}", "\n\n\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", ""), F.lit("\n"))


def attribute_int(tag: Column | str, name: str) -> Column:
    """A span attribute of a tag, at least 1."""
    found = F.regexp_extract(col(tag), rf"(?i)\b{name}\s*=\s*[\"']?([0-9]{{1,9}})", 1)
    return F.greatest(F.coalesce(F.when(found != "", found).cast("int"), F.lit(1)), F.lit(1))


def truncate(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, an ellipsis as the last where something was cut."""
    c = col(c)
    if most <= 0:
        return F.lit("")
    if most == 1:
        return F.when(F.length(c) <= 1, c).otherwise("…")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def checksum(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def document_key(stem: Column | str, group: Column | str, prefix: str = "doc") -> Column:
    g = col(group)
    return F.concat_ws("-", F.lit(prefix), F.when((g.isNotNull()) & (g != ""), slugify(g)), slugify(stem))


def version_key(document: Column | str, digest: Column | str) -> Column:
    return F.concat_ws("-", col(document), F.substring(col(digest), 1, 12))


def first_non_empty(*cs: Column | str) -> Column:
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in cs])


def one_of(c: Column | str, values: list[str], default: str) -> Column:
    return F.when(col(c).isin(values), col(c)).otherwise(default)


def is_safe_key(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,250}\z"), F.lit(False))


def file_name(c: Column | str) -> Column:
    """The last part of a URL's path or of a key; null if there is none."""
    c = col(c)
    path = F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", ""), "[?#].*$", "")).otherwise(c)
    name = F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "/"), -1)
    return F.when(name != "", name)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"\.([A-Za-z0-9]+)$", 1))


def file_type(c: Column | str) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(kinds, extension(c)), extension(c))


def citation(source: Column | str, start: Column | str, end: Column | str, headings: Column | str) -> Column:
    """'file, trang a[-b]', else 'file, mục heading', else the file."""
    s, a, b, h = col(source), col(start), col(end), col(headings)
    pages = F.when(a == b, F.concat(s, F.lit(", trang "), a)).otherwise(F.concat(s, F.lit(", trang "), a, F.lit("-"), b))
    return F.when(a.isNotNull() & b.isNotNull(), pages).when(F.size(h) > 0, F.concat(s, F.lit(", mục "), F.element_at(h, -1))).otherwise(s)


def canonical_path(department: Column | str, version: Column | str) -> Column:
    return F.concat(F.lit("canonical/md/"), F.lower(col(department)), F.lit("/"), col(version), F.lit(".md"))


def source_path(version: Column | str, department: Column | str, suffix: Column | str) -> Column:
    kind = F.lower(F.regexp_replace(col(suffix), "^[.]+", ""))
    kind = F.when(kind == "markdown", "md").otherwise(kind)
    return F.concat(F.lit("sources/"), kind, F.lit("/"), F.lower(col(department)), F.lit("/"), col(version), F.lit("."), kind)


def revision_path(path: Column | str, token: Column | str) -> Column:
    """The immutable revision beside a file: its token goes before the suffix and replaces an earlier one."""
    c = col(path)
    suffix = F.regexp_extract(c, r"(\.[^./]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(c, r"\.[^./]+$", ""), r"\.[0-9a-f]{32}$", "")
    return F.concat(stem, F.lit("."), col(token), F.when(suffix == "", ".md").otherwise(suffix))


def infer_parser(c: Column | str) -> Column:
    s = F.lower(col(c))
    llama, mu = s.contains("llama"), s.contains("pymupdf")
    return F.when(llama & mu, "pymupdf_text_only+llamaparse").when(llama, "llamaparse").when(mu, "pymupdf_text_only")


def embedding_text(title: Column, units: Column, kind: Column, headings: Column, start: Column, end: Column, content: Column) -> Column:
    """What is embedded for a chunk: title, units, type, heading path, pages, an empty line, the content."""
    pages = F.when((start > 0) & (end > 0), F.concat(F.lit("Page "), start, F.lit("-"), end)).otherwise("")
    return F.concat_ws("\n", F.concat(F.lit("Tài liệu: "), title), F.concat(F.lit("Đơn vị: "), F.array_join(units, ", ")), F.concat(F.lit("Loại: "), kind), F.concat(F.lit("Mục: "), F.array_join(headings, " > ")), pages, F.lit(""), F.trim(content))


def point_id(version: Column | str, chunk: Column | str, namespace: str = "6ba7b8119dad11d180b400c04fd430c8", prefix: str = "chunk/") -> Column:
    """UUID version 5 of the chunk's name under the URL namespace."""
    name = F.concat(F.lit(prefix), col(version), F.lit("/"), col(chunk))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def report_fields(c: Column | str) -> Column:
    """map<string, string> of a report's ``key: value`` lines, keys in lower case; the first of a key counts, other lines are noise."""
    pattern = r"(?m)^[ \t]*(?:[-*][ \t]+)?([A-Za-z][A-Za-z0-9 _-]*?)[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$"
    keys, found = (F.regexp_extract_all(col(c), F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(F.transform(keys, F.lower).alias("k"), found.alias("v"))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, 1, i), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(first)


def tidy_markdown(c: Column | str) -> Column:
    """Outside code fences: escaped list marks plain, headings without bold, empty emphasis gone; then blank lines tidied."""
    rows = F.split(col(c), "\n")
    fence = lambda x: x.rlike(r"^\s*(?:```|~~~)")

    def line(x: Column, i: Column) -> Column:
        out = F.regexp_replace(x, r"^(\s*)\\([-+*])(?=\s)", "$1$2")
        out = F.regexp_replace(out, r"^(\s*\d+)\\([.)])(?=\s)", "$1$2")
        out = F.regexp_replace(F.regexp_replace(out, r"^(#{1,6}\s+)\*\*(.+?)\*\*\s*$", "$1$2"), r"^\s*(?:\*\*\s*\*\*|__\s*__)\s*$", "")
        inside = F.size(F.filter(F.slice(rows, 1, i), fence)) % 2 == 1
        return F.when(inside | fence(x), x).otherwise(out)

    return tidy_blank_lines(F.array_join(F.transform(rows, line), "\n"))
