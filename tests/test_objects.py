import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import objects


def saved(df, root, existing="fail", mode="append"):
    df.write.format("objects").option("root", root).option("existing", existing).mode(mode).save()


def read(spark, root, **options):
    return {r.path: (r.length, bytes(r.content)) for r in spark.read.format("objects").option("root", root).options(**options).load().collect()}


@pytest.fixture
def root(spark, tmp_path):
    objects.register(spark)
    return f"file://{tmp_path}/store"


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").repartition(3)


def test_create_if_absent_then_replace(spark, root):
    first = {f"a/{k}.md": f"text {k}" for k in range(50)}
    saved(frame(spark, list(first.items())), root)
    assert read(spark, root) == {p: (len(t), t.encode()) for p, t in first.items()}
    with pytest.raises(Exception, match="exists"):
        saved(frame(spark, [("a/new.md", "x"), ("a/7.md", "y")]), root)
    assert read(spark, root) == {p: (len(t), t.encode()) for p, t in first.items()}
    saved(frame(spark, [("a/7.md", "Größe"), ("b.txt", None)]), root, "replace")
    got = read(spark, root)
    assert got["a/7.md"] == (7, "Größe".encode()) and got["b.txt"] == (0, b"") and len(got) == 51
    assert set(read(spark, root, suffixes=".TXT")) == {"b.txt"}


def test_a_failing_task_leaves_nothing(spark, root, tmp_path):
    saved(frame(spark, [("kept.md", "x")]), root)
    bad = spark.range(100).repartition(4).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise("t").cast("string").alias("content"))
    with pytest.raises(Exception, match="boom"):
        saved(bad, root)
    assert set(read(spark, root)) == {"kept.md"} and [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith("_staging")] == ["kept.md"]
    saved(spark.range(100).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(b"t").alias("content")), root)
    assert len(read(spark, root)) == 101


@pytest.mark.parametrize("paths", [["../out"], [""], [None], ["/abs"], ["twice", "./twice"], ["_staging-x/y"]])
def test_paths_that_are_refused(spark, root, tmp_path, paths):
    saved(frame(spark, [("kept.md", "x")]), root)
    with pytest.raises(Exception):
        saved(frame(spark, [(p, "x") for p in paths]), root)
    assert [p.name for p in (tmp_path / "store").iterdir()] == ["kept.md"]


def test_empty_stores_and_writes(spark, root, tmp_path):
    (tmp_path / "store").mkdir()
    saved(frame(spark, []), root)
    assert read(spark, root) == {}


def test_comparison_text(spark):
    rows = [("Straße  ﬁn\tＦＵＬＬ Ⅷ",), ("plain  ASCII\n",), ("",), (None,), ("İ ſ ½ ",)]
    got = [r.t for r in spark.createDataFrame(rows, "x string").coalesce(1).select(T.comparison_text("x").alias("t")).collect()]
    assert got == ["strasse fin full viii", "plain ascii", "", None, "i̇ s 1⁄2"]
