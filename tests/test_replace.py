from docloom.operators import store as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_emptied_list_clears(spark):
    named = spark.createDataFrame([("a",), ("b",)], "version_key string")
    assets = spark.createDataFrame([("url-x", "x")], "asset_key string, url string")
    links = spark.createDataFrame([("a", "url-x", 0), ("b", "url-x", 0), ("c", "url-x", 0)], "version_key string, asset_key string, display_order int")
    wanted = spark.createDataFrame([("a", 0, "y")], "version_key string, position int, url string")
    _, left, twice = K.replace_assets(assets, links, wanted, versions=named)
    assert sorted({r[0] for r in rows(left)}) == ["a", "c"] and rows(twice) == []
    _, left, twice = K.replace_assets(assets, links, spark.createDataFrame([("a", 0, "y"), ("a", 1, "y")], wanted.schema), versions=named)
    assert [r[0] for r in rows(left)] == ["a", "c"] and len(rows(twice)) == 1  # the refused version keeps its link, the emptied one loses it

    old = spark.createDataFrame([("a", "k", None, "c1", 1, 9, None), ("b", "k", None, "c1", 1, 9, None)], "version_key string, chunk_key string, parent_chunk_key string, content string, chunk_index int, id long, parent_id long")
    new = old.limit(0).drop("id", "parent_id")
    kept, errors = K.replace_chunks(old, new, 100, versions=named.where("version_key = 'b'"))
    assert [r[0] for r in rows(kept)] == ["a"] and rows(errors) == []


def test_a_bad_code_refuses_the_request(spark):
    old = spark.createDataFrame([("a", "D1", 1, "x"), ("b", "D1", 1, "x"), ("c", "D1", 1, "x")], "version_key string, code string, position int, effective_date string")
    asked = spark.createDataFrame([("a", "D2", 0, None), ("a", "D3", 1, "e"), ("a", "D2", 2, "late"), ("b", "D2", 0, None), ("b", "bad", 1, None)], "version_key string, code string, position int, effective_date string")
    versions = spark.createDataFrame([("a", "i"), ("b", "i"), ("c", "i")], "version_key string, issued_date string")
    departments = spark.createDataFrame([("D2", True), ("D3", True), ("bad", False)], "code string, is_active boolean")
    got, refused = K.replace_recipients(old, asked, versions, departments)
    assert rows(got) == [("a", "D2", 1, "i"), ("a", "D3", 2, "e"), ("b", "D1", 1, "x")] and rows(refused) == [("b", "bad")]


def test_starts_over_many_ranges(spark):
    sizes = spark.createDataFrame([(k, k % 4 + 1) for k in range(200)], "version_key int, _n long").repartition(5)
    want, at = {}, 0
    for k in range(200):
        want[k] = at
        at += k % 4 + 1
    assert {r.version_key: r._start for r in K._starts(sizes, "version_key").collect()} == want


def test_requests_are_dealt_into_bounded_parts(spark, monkeypatch):
    from docloom.sources import shared

    monkeypatch.setattr(shared, "PART_ROWS", 10)
    asked = spark.range(1000).selectExpr("id as version_key", "1L as code", "1 as position", "'d' as effective_date")
    versions, departments = asked.selectExpr("version_key", "'i' as issued_date"), spark.createDataFrame([(1, True)], "code long, is_active boolean")
    out = K.replace_recipients(asked, asked, versions, departments)[0]
    assert out.count() == 1000 and "hashpartitioning(version_key" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 100), REPARTITION_BY_NUM" in plan
