import hashlib

from pyspark.sql import functions as F

from docloom.operators import metadata as M

FILES = [("/d/PDFs/dept/Quy chế 1.PDF", "a" * 64), ("/d/PDFs/other/quy-che-1.pdf", "b" * 64), ("/d/x/Plan.exe", "c" * 64), ("/d/x/Plan.docx", "d" * 64)]
REPORT = "# PDF / Image Text Document\n\n## Metadata\n\n- Source name: Plan.docx\n- Parser: PyMuPDF and LlamaParse\n- OCR engine for scan/images: E1\n\n## Extracted Text\n\nbody\n"


def attached(spark, texts, **kw):
    files = spark.createDataFrame(FILES, "path string, checksum string")
    df = spark.createDataFrame(texts, "path string, text string")
    return {r.path: r for r in M.attach(df, files, F.lit("NOW"), **kw).collect()}


def test_sources_by_path_then_by_stem(spark):
    got = attached(spark, [("/m/Quy_che_1_clean.md", "x"), ("/m/none.md", "x"), ("/m/z.md", REPORT), ("/m/plan.md", "---\nsource_path: /d/x/Plan.exe\n---\nx")])
    assert {p: r.source for p, r in got.items()} == {"/m/Quy_che_1_clean.md": "/d/PDFs/dept/Quy chế 1.PDF", "/m/none.md": None, "/m/z.md": "/d/x/Plan.docx", "/m/plan.md": "/d/x/Plan.exe"}
    assert attached(spark, [("/m/none.md", "x")], asked={"source_path": "/d/x/Plan.docx"})["/m/none.md"].source == "/d/x/Plan.docx"


def test_precedence_and_origins(spark):
    front = "---\ndocument_key: k\ntitle: T\nlanguage: en\naudience:\n  - a\n  - b\nocr_status: wrong\nreview_status: rejected\nparser: own\nis_latest: false\nnotes:\n---\nbody\n"
    r = attached(spark, [("/m/z.md", front)], asked={"language": "fr", "document_type": "rule"})["/m/z.md"]
    text = hashlib.sha256(front.encode()).hexdigest()
    want = {"document_key": (["k"], "front_matter"), "version_key": ([f"k-{text[:12]}"], "made"), "title": (["T"], "front_matter"), "language": (["fr"], "asked"), "document_type": (["rule"], "asked"), "audience": (["a", "b"], "front_matter"), "domain": (["unknown"], "default"),
            "ocr_status": (["not_started"], "report"), "review_status": (["rejected"], "front_matter"), "rag_status": (["not_indexed"], "default"), "checksum": ([text], "made"), "parser": (["own"], "front_matter"), "is_latest": (["false"], "front_matter"), "notes": ([], "none"), "canonical_markdown_path": (["/m/z.md"], "made"), "file_type": (["md"], "default")}
    assert {f: (r.fields[f], r.origins[f]) for f in want} == want
    assert "title" not in r.changed and "language" in r.changed and "updated_at" not in r.changed
    assert r.text.startswith("---\ndocument_key: k\n") and "audience:\n  - a\n  - b\n" in r.text and r.text.endswith("---\n\nbody\n")


def test_reports_fill_fields_and_leave_the_text(spark):
    r = attached(spark, [("/m/z.md", REPORT)], prefix="p")["/m/z.md"]
    assert (r.fields["parser"], r.fields["ocr_engine"], r.fields["ocr_status"], r.fields["checksum"], r.fields["file_type"], r.fields["document_key"]) == (["pymupdf_text_only+llamaparse"], ["E1"], ["done"], ["d" * 64], ["docx"], ["p-plan"])
    assert r.text.endswith("---\n\nbody\n") and "PDF / Image" not in r.text


def test_version_keys_made_from_an_old_checksum_are_made_anew(spark):
    old = "e" * 64
    text = lambda v: f"---\ndocument_key: k\nversion_key: {v}\nchecksum: {old}\n---\nx"
    r = attached(spark, [("/a/plan.md", text(f"k-{old[:12]}")), ("/b/plan.md", text("mine"))])
    assert r["/a/plan.md"].fields["version_key"] == [f"k-{'d' * 12}"] and r["/b/plan.md"].fields["version_key"] == ["mine"]
    assert attached(spark, [("/b/plan.md", text("mine"))], overwrite=True)["/b/plan.md"].fields["version_key"] == [f"k-{'d' * 12}"]


def test_odd_rows(spark):
    got = attached(spark, [("/m/a.md", None), ("/m/b.md", ""), ("/m/c.md", "---\nnever closed")])
    assert len(got) == 3 and all(r.fields["document_key"] == [f"doc-{p[3]}"] for p, r in got.items())
    assert attached(spark, []) == {}
