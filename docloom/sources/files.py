"""Sources and sinks: whole text files, binary files with their sniffed type, front matter, evaluation cases.

Everything is a Column expression or a Spark reader; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import col

# What a source file's extension stands for, and the first bytes of each type.
SOURCE_TYPES = {
    "pdf": "pdf", "doc": "doc", "docx": "docx", "ppt": "ppt", "pptx": "pptx", "png": "image", "jpg": "image", "jpeg": "image",
    "tif": "image", "tiff": "image", "bmp": "image", "webp": "image", "md": "md", "markdown": "md",
}
SIGNATURES = {"pdf": ["255044462D"], "doc": ["D0CF11E0A1B11AE1"], "image": ["89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "424D"]}
_ENTRY = r"(?m)^([A-Za-z_][A-Za-z0-9_]*):[ \t]*([^\n]*(?:\n(?=[ \t]*(?:-|#|\n|\z))[^\n]*)*)"


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, text): every file under ``path`` that matches, as one row."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, source_type): every file under ``path`` with its sniffed type, null where name and content disagree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", source_type("path", "content").alias("source_type"))


def source_type(name: Column | str, content: Column | str) -> Column:
    """The type that a file's extension names, if its content begins as it should; else null."""
    c = col(content)
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    kind = F.element_at(kinds, F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1)))

    def begins(marks: list[str]) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | (F.substring(c, 1, len(m) // 2) == F.unhex(F.lit(m)))
        return out

    plain = F.decode(c, "ISO-8859-1")
    office = begins(["504B0304"]) & plain.contains("PK\x05\x06") & plain.contains("[Content_Types].xml")
    webp = begins(["52494646"]) & (F.substring(c, 9, 4) == F.unhex(F.lit("57454250")))
    ok = (
        F.when(kind == "pdf", begins(SIGNATURES["pdf"])).when(kind == "doc", begins(SIGNATURES["doc"]))
        .when(kind == "docx", office & plain.contains("word/")).when(kind == "pptx", office & plain.contains("ppt/"))
        .when(kind == "image", begins(SIGNATURES["image"]) | webp).when(kind == "md", F.is_valid_utf8(c.cast("string"))).otherwise(kind.isNotNull())
    )
    return F.when(ok, kind)


# ---- front matter


def _scalar(c: Column) -> Column:
    c = F.trim(c)
    c = F.when(c.rlike("(?s)^\".*\"$|^'.*'$") & (F.length(c) >= 2), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.when(F.lower(c).isin("true", "false"), F.lower(c)).otherwise(c)


def _fields(docs: DataFrame, block: str) -> DataFrame:
    """``docs`` with ``fields``, a map<string, array<string>> of the column ``block`` of ``key: value`` lines and ``- item`` lists; an empty value is an empty array, a later key wins.

    Each step is a column of its own that lambdas take as a whole, so none is done again for every key.
    """

    def items(rows: Column) -> Column:
        head = _scalar(F.element_at(rows, 1))
        rest = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x.rlike(r"^\s*-"))
        listed = F.transform(rest, lambda x: _scalar(F.regexp_replace(x, r"^\s*-\s*", "")))
        return F.when(F.size(rest) > 0, listed).when(head.isin("", "[]"), F.array().cast("array<string>")).otherwise(F.array(head))

    keys, raw = (F.coalesce(F.regexp_extract_all(F.col(block), F.lit(_ENTRY), F.lit(k)), F.array().cast("array<string>")) for k in (1, 2))
    docs = docs.withColumns({"_k": keys, "_v": raw}).withColumn("_v", F.transform(F.transform("_v", lambda v: F.split(v, "\n")), items))
    none = F.array().cast("array<struct<_k:string,_v:array<string>>>")
    last = F.aggregate(F.arrays_zip("_k", "_v"), none, lambda acc, x: F.array_append(F.filter(acc, lambda y: y["_k"] != x["_k"]), x))
    docs = docs.withColumn("_e", F.when(F.size(F.array_distinct("_k")) < F.size("_k"), last).otherwise(F.arrays_zip("_k", "_v")))
    return docs.withColumn("fields", F.map_from_entries("_e")).drop("_k", "_v", "_e")


def split_front_matter(docs: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """``docs`` with fields, body and error.

    Strict: Unix line ends are made first; the text must begin with a closed block and have a body, or error says what
    is missing. Otherwise a text without a closed block is all body. Null texts count as empty.
    """
    t = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    d = docs.withColumn("_t", t)
    if not strict:
        blanks = F.col("_t").contains("--- ") | F.col("_t").contains("---\t")
        d = d.withColumn("_t", F.when(blanks, F.regexp_replace("_t", r"(?m)^---[ \t]+$", "---")).otherwise(F.col("_t")))
    # the block ends at the first line of three dashes after its first line, at _at of what follows the opening one
    d = d.withColumns({"_open": F.col("_t").startswith("---\n"), "_rest": F.expr("substring(_t, 5)")})
    d = d.withColumn("_at", F.when(F.col("_open"), F.locate("\n---\n", F.col("_rest"))).otherwise(0))
    whole = F.col("_at") > 0
    d = _fields(d.withColumn("_block", F.when(whole, F.expr("substring(_rest, 1, _at - 1)"))), "_block")
    after = F.when(whole, F.expr("substring(_rest, _at + 5)")).otherwise("")
    if strict:
        d = d.withColumn("_body", after)
        d = d.withColumn("error", F.when(~F.col("_open"), "no_front_matter").when(~whole, "front_matter_not_closed").when(~F.col("_body").rlike(r"\S"), "empty_body"))
        body = F.when(F.col("error").isNull(), F.regexp_replace("_body", r"\A\s+|(?<!\s)\s+\z", ""))
        return d.select(*docs.columns, "fields", body.alias("body"), "error")
    return d.select(*docs.columns, "fields", F.when(whole, F.ltrim(after, F.lit("\n"))).otherwise(F.col(text)).alias("body"), F.lit(None).cast("string").alias("error"))


def render_front_matter(fields: Column, body: Column, order: list[str]) -> Column:
    """The text of a document: the named fields in order, lists as items, then an empty line and the body."""

    def one(name: str) -> Column:
        v = F.element_at(fields, name)
        lines = F.concat(F.lit(f"{name}:"), F.concat_ws("", F.transform(v, lambda x: F.concat(F.lit("\n  - "), x))))
        return F.when(F.size(v) == 0, f"{name}: []").when(F.size(v) == 1, F.concat(F.lit(f"{name}: "), F.element_at(v, 1))).when(v.isNotNull(), lines)

    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[one(n) for n in order]), F.lit("\n---\n\n"), F.regexp_replace(body, r"\A\s+|\s+\z", ""), F.lit("\n"))


# ---- evaluation cases

LISTS = ("gold_answer_spans", "expected_document_keys", "reference_facts")


def cases(rows: DataFrame) -> DataFrame:
    """Evaluation cases from text cells: JSON lists as arrays, spans also parted by ||, truth values, page bounds as one array."""
    out = rows
    for name in LISTS:
        if name in rows.columns:
            parted = F.filter(F.transform(F.split(F.col(name), r"\|\|"), lambda x: F.trim(x)), lambda x: x != "")
            out = out.withColumn(name, F.coalesce(F.from_json(F.when(F.trim(name).startswith("["), F.col(name)), "array<string>"), parted))
    if "answerable" in rows.columns:
        out = out.withColumn("answerable", F.coalesce(F.lower(F.trim("answerable")).isin("true", "1", "yes"), F.lit(False)))
    if {"page_hint_start", "page_hint_end"} <= set(rows.columns):
        bounds = F.array(F.expr("try_cast(page_hint_start as int)"), F.expr("try_cast(page_hint_end as int)"))
        out = out.withColumn("page_hint", F.when(bounds[0].isNotNull() & bounds[1].isNotNull(), bounds)).drop("page_hint_start", "page_hint_end")
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a CSV file with a header, or of a JSON file of one object with ``cases``."""
    if path.lower().endswith(".json"):
        return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return cases(rows.toDF(*[c.removeprefix("﻿") for c in rows.columns]))


def write_cases(df: DataFrame, path: str) -> None:
    """A CSV sink: arrays, maps and structs go as JSON cells."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)
