"""Batch hybrid retrieval: many queries against one corpus, every operator keyed by query_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import words
from docloom.operators import ranking
from docloom.sources.shared import dealt, numbered

RANK_CONSTANT = 60
#: Rows of a query side up to which it is broadcast; the check is a count.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def eligible(audience: str | None = None, document: str | None = None, version: str | None = None) -> Column:
    """Approved, published, latest; with the audience, document and version where they are given."""
    out = (F.col("review_status") == "approved") & (F.col("rag_status") == "published") & F.col("is_latest")
    if audience:
        out = out & F.array_contains("audience", audience)
    if document:
        out = out & (F.col("document_key") == document)
    return out & (F.col("version_key") == version) if version else out


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content", terms: DataFrame | None = None) -> DataFrame:
    """(term, key, tf): the inverted index, of the given terms (term) alone if there are any. Other words go before the shuffle, and partial counts are made there."""
    out = chunks.select(key, F.explode(words(text)).alias("term"))
    if terms is not None:
        out = out.join(small(terms.select("term").distinct()), "term", "left_semi")
    return out.groupBy("term", key).agg(F.count("*").alias("tf"))


def sparse_topk(index: DataFrame, terms: DataFrame, k: int, key: str = "chunk_id", chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): 0.1 for every place where one of a query's terms (query_id, term) stands; ties by key.

    With the ``chunks`` that were indexed, the index is dealt by key so that a part has a bounded number of pairs of queries
    and chunks; counts are then multiplied inside the tasks (see ``ranking.matched``), and the best k of each part alone are shuffled.
    """
    if chunks is not None:
        terms = terms.distinct()
        index = dealt(index, key, rows=chunks.count() * terms.select("query_id").distinct().count())
        hits = ranking.matched(index, terms, k, key).select("query_id", key, F.round(F.lit(0.1) * F.col("n"), 12).alias("score"))
    else:
        score = F.round(F.lit(0.1) * F.sum("tf"), 12).alias("score")
        hits = index.join(small(terms.distinct()), "term").groupBy("query_id", key).agg(score)
    return top(hits, ["query_id"], [F.desc("score"), F.col(key)], k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank): exact cosine neighbours of each query vector (query_id, query); ties by key.

    A stated query set against all rows: the queries are sent to the vectors' tasks in slices, each task multiplies blocks and
    keeps its best k of a query (see ``ranking.nearest``), so only those are shuffled.
    """
    numbers = lambda c: F.col(c).cast("array<double>")
    norm = lambda c: F.sqrt(F.aggregate(F.transform(numbers(c), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)).alias("norm")
    v = vectors.select(key, numbers("embedding").alias("embedding"), norm("embedding")).where("norm > 0")
    q = queries.select("query_id", numbers("query").alias("query"), norm("query")).where("norm > 0")
    scored = ranking.nearest(v, q, k, key, digits).select("query_id", key, F.round("cosine", digits).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.col(key)], k)


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fuse(lists: DataFrame, k: int, key: str = "chunk_id", constant: int = RANK_CONSTANT) -> DataFrame:
    """(query_id, key, score, rank): reciprocal-rank fusion of (query_id, branch, key, rank).

    Every appearance counts. Ties go to the lower branch, then the better rank there, as in order of first sight.
    """
    each = lists.where(F.col(key).isNotNull()).groupBy("query_id", key)
    fused = each.agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("branch", "rank")).alias("first"))
    out = top(fused, ["query_id"], [F.desc("score"), F.col("first"), F.col(key)], k)
    return out.select("query_id", key, "score", "rank")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, types: DataFrame) -> DataFrame:
    """Hits with their chunk, document and (if known) type; ranks stay, hits whose document is gone or not eligible drop."""
    out = hits.join(chunks, "chunk_id").join(documents.where(eligible()), "document_id")
    return out.join(F.broadcast(types) if types.limit(1001).count() <= 1000 else types, "type_id", "left")


def with_parent(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their parent chunk's content, null without one."""
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"))
    return hits.join(parent, "parent_chunk_id", "left")


def without_used(hits: DataFrame, used: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits whose (query_id, key) was not used before, ranked anew."""
    rest = hits.join(used.select("query_id", key).distinct(), ["query_id", key], "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Hits in order of a new score, the old rank in ties."""
    out = hits.withColumn("new_score", score).withColumnRenamed("rank", "old_rank")
    return top(out, ["query_id"], [F.desc("new_score"), F.col("old_rank")], k)


# ---- structural expansion: chunks with version_key, chunk_key, chunk_index, item, parent_item, parent_chunk, split_index, split_count


def _found(hits: DataFrame, chunks: DataFrame, on: Column, reason: str, most: int) -> DataFrame:
    c = chunks.select(*[F.col(x).alias(f"c_{x}") for x in chunks.columns])
    got = hits.join(c, (F.col("version_key") == F.col("c_version_key")) & on & (F.col("chunk_key") != F.col("c_chunk_key")))
    got = got.select("query_id", F.col("rank").alias("hit_rank"), F.col("c_version_key").alias("version_key"), F.col("c_chunk_key").alias("chunk_key"), F.col("c_chunk_index").alias("chunk_index"), F.lit(reason).alias("reason"))
    return top(got, ["query_id", "hit_rank"], [F.col("chunk_index"), F.col("chunk_key")], most, "place")


def expand_parent(hits: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    return _found(hits, chunks, F.col("c_item") == F.col("parent_item"), "parent", most)


def expand_children(hits: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    return _found(hits, chunks, F.col("c_parent_item") == F.col("item"), "children", most)


def expand_siblings(hits: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    on = (F.col("c_parent_item") == F.col("parent_item")) & (F.col("parent_chunk").isNull() | (F.col("c_parent_chunk") == F.col("parent_chunk")))
    return _found(hits, chunks, on, "siblings", most)


def expand_neighbors(hits: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    on = (F.col("c_item") == F.col("item")) & (F.abs(F.col("c_split_index") - F.col("split_index")) <= 1)
    return _found(hits.where("split_count > 1"), chunks, on, "neighbors", most)


#: How a chunk is found from a hit, in the order in which finds count; "direct" is the hit itself.
REASONS = ("direct", "parent", "children", "siblings", "neighbors")


def expand(hits: DataFrame, chunks: DataFrame, most: int = 20, rows: int | None = None) -> DataFrame:
    """Hits with their parents, for list questions (wants_list) children and siblings, and split neighbours; the first of each chunk, at most ``most`` of a query.

    One join by version finds all kinds. A chunk past the first ``most`` of its kind and hit has that many others before it,
    so only the last cut is made. With ``rows``, about how many are found, both sides are dealt by version_key already.
    """
    if rows is None:
        n_hits, n_chunks = hits.count(), chunks.count()
        hits, chunks, rows = dealt(hits, "version_key", rows=n_hits + n_chunks), dealt(chunks, "version_key", rows=n_hits + n_chunks), 4 * n_hits
    c = chunks.select(*[F.col(x).alias(f"c_{x}") for x in ("version_key", "chunk_key", "chunk_index", "item", "parent_item", "parent_chunk", "split_index")])
    beside = (F.col("parent_chunk").isNull() | (F.col("c_parent_chunk") == F.col("parent_chunk"))) & (F.col("c_parent_item") == F.col("parent_item"))
    near = (F.col("split_count") > 1) & (F.col("c_item") == F.col("item")) & (F.abs(F.col("c_split_index") - F.col("split_index")) <= 1)
    # a chunk counts as what it is first: the kinds of one hit stand in the order of REASONS
    kind = F.when(F.col("c_item") == F.col("parent_item"), 1).when(F.col("wants_list") & (F.col("c_parent_item") == F.col("item")), 2).when(F.col("wants_list") & beside, 3).when(near, 4)
    met = hits.join(c, (F.col("version_key") == F.col("c_version_key")) & (F.col("chunk_key") != F.col("c_chunk_key")) & kind.isNotNull(), "left")
    # places in order: hits first, then by hit and kind; packed into one number, whose least is found without a sort
    place = lambda later, kind: (F.lit(later << 50) + F.col("rank").cast("long") * 8 + kind).alias("place")
    # the hit itself comes with every row that it meets; the least place of a chunk makes it one
    itself = F.struct("chunk_key", "chunk_index", place(0, F.lit(0)))
    other = F.when(F.col("c_chunk_key").isNotNull(), F.struct(F.col("c_chunk_key").alias("chunk_key"), F.col("c_chunk_index").alias("chunk_index"), place(1, kind)))
    every = met.select("query_id", "version_key", F.explode(F.array(itself, other)).alias("f")).where("f is not null").select("query_id", "version_key", "f.*")
    once = dealt(every, "query_id", rows=rows).groupBy("query_id", "version_key", "chunk_key").agg(F.min("place").alias("place"), F.min("chunk_index").alias("chunk_index"))
    first = top(once, ["query_id"], [F.col("place"), F.col("chunk_index"), F.col("chunk_key")], most)
    return first.select("query_id", "rank", "version_key", "chunk_key", F.element_at(F.array(*map(F.lit, REASONS)), (F.col("place") % 8 + 1).cast("int")).alias("reason"))


# ---- evaluation


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank) over the first k hits of every query in gold (query_id, key)."""
    g = gold.select("query_id", key).distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    met = hits.where(F.col("rank") <= k).join(g, ["query_id", key]).groupBy("query_id").agg(F.count_distinct(key).alias("n_met"), F.min("rank").alias("best"))
    out = size.join(met, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce("n_met", F.lit(0)) / k, 9).alias("precision"), F.round(F.coalesce("n_met", F.lit(0)) / F.col("n_gold"), 9).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)), 9).alias("reciprocal_rank"))


# ---- one search, from ranked lists to the rows of an answer


def candidate_k(top_k: int, configured: int = 30) -> int:
    """How many hits each branch gives: never fewer than are asked for."""
    return max(top_k, configured)


def search_queries(questions: DataFrame, variants: DataFrame) -> DataFrame:
    """(query_id, variant, query): the question as variant 0, then rewritten ones, each text once without regard to case; blank questions have none."""
    clean = F.trim(F.regexp_replace("query", r"\s+", " "))
    every = questions.select("query_id", F.lit(0).alias("place"), "query").unionByName(variants.select("query_id", (F.col("position") + 1).alias("place"), "query"))
    every = every.withColumn("query", clean).where("query <> ''").join(questions.where(F.trim("query") != "").select("query_id"), "query_id", "left_semi")
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.lower("query")).orderBy("place"))).where("n = 1")
    return once.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("place")) - 1).alias("variant"), "query")


def fuse_variants(lists: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank) from (query_id, variant, branch, key, rank): branches are fused for each variant, then the variants."""
    each = lists.select(F.struct("query_id", "variant").alias("query_id"), "branch", key, "rank")
    each = fuse(each, k, key).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variant").alias("branch"), key, "rank")
    return fuse(each, k, key)


def prefer(*values: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def hydrate_fields(hits: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame, types: DataFrame) -> DataFrame:
    """Hits (query_id, rank, chunk_id, score, payload) with every field of a result; the payload's value first, else the catalog's.

    Hits without a chunk_id and hits whose chunk is no indexed child of an approved, published, latest version drop; ranks
    stay. Keys, paths and urls fall back where they are empty, page numbers only where they are null.
    """
    from docloom.functions.text import citation, file_name

    c = chunks.where("chunk_type = 'child' and index_status = 'indexed'").select("chunk_id", "version_id", "parent_chunk_id", *[F.col(f).alias(f"c_{f}") for f in ("chunk_key", "content", "page_start", "page_end", "heading_path")])
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_key").alias("parent_key"), F.col("content").alias("parent_content"))
    v = versions.where("review_status = 'approved' and rag_status = 'published' and is_latest").select("version_id", "document_id", "version_key", *[F.col(f).alias(f"v_{f}") for f in ("title", "source_path", "canonical_markdown_path", "source_url")])
    d = documents.select("document_id", "document_key", "type_id", F.col("title").alias("d_title"))
    out = hits.where("chunk_id is not null").join(c, "chunk_id").join(v, "version_id").join(d, "document_id").join(parent, "parent_chunk_id", "left").join(small(types), "type_id", "left")
    p = lambda f: F.col(f"payload.{f}")
    title = prefer(F.col("v_title"), F.col("d_title"))
    source = prefer(file_name("v_source_path"), file_name(p("source_file")), file_name("v_canonical_markdown_path"), title)
    start, end = F.coalesce(p("page_start"), "c_page_start"), F.coalesce(p("page_end"), "c_page_end")
    headings = F.when(F.size(p("heading_path")) > 0, p("heading_path")).otherwise(F.coalesce("c_heading_path", F.array().cast("array<string>")))
    return out.select(
        "query_id", "rank", "chunk_id", "parent_chunk_id", "document_key", "version_key", prefer(p("chunk_key"), F.col("c_chunk_key")).alias("chunk_key"), prefer(p("parent_chunk_key"), F.col("parent_key")).alias("parent_chunk_key"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.col("c_content").alias("content"), title.alias("title"), start.alias("page_start"), end.alias("page_end"), source.alias("source_file"), F.coalesce(prefer(F.col("v_source_url"), p("source_url")), F.lit("")).alias("source_url"),
        citation(source, start, end, headings).alias("citation"), headings.alias("heading_path"), F.coalesce(p("legal_unit_type"), F.lit("none")).alias("legal_unit_type"), F.coalesce(p("split_index"), F.lit(0)).alias("split_index"), F.coalesce(p("split_count"), F.lit(1)).alias("split_count"),
        "parent_content", "type_name",
    )


def apply_scores(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits in order of a reranker's answer (query_id, place, score), place counting the query's hits from 0.

    An answer counts if it names every hit once, with finite scores; else, and with under two hits, the order stays.
    """
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    fine = F.coalesce((F.col("score") == F.col("score")) & (F.abs("score") < float("inf")) & ~F.isnan("score"), F.lit(False))
    answer = scores.groupBy("query_id").agg(F.count("*").alias("k"), F.count_distinct("place").alias("d"), F.min("place").alias("low"), F.max("place").alias("high"), F.bool_and(fine).alias("fine"))
    good = answer.join(n, "query_id").where("k = n and d = n and low = 0 and high = n - 1 and fine and n > 1").select("query_id", F.lit(True).alias("good"))
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    out = placed.join(scores.select("query_id", "place", F.col("score").alias("new")).dropDuplicates(["query_id", "place"]), ["query_id", "place"], "left").join(good, "query_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("good"), F.col("new"))), "place")
    return out.withColumn("rank", F.row_number().over(order)).drop("place", "new", "good")


def search(lists: DataFrame, scores, used: DataFrame, top_k: int, configured: int = 30, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rank): the direct hits of a whole search over ranked lists (query_id, variant, branch, key, rank).

    Two-stage fusion to ``candidate_k`` hits, reranking by ``scores`` (a function of the fused hits that gives (query_id,
    place, score)), without what an earlier answer used, and only then the first ``top_k``.
    """
    k = candidate_k(top_k, configured)
    fused = fuse_variants(lists.where(F.col("rank") <= k), k, key)
    ranked = apply_scores(fused, scores(fused))
    return without_used(ranked, used, key).where(F.col("rank") <= top_k).select("query_id", key, "rank")


def stage_trace(stages: dict[str, DataFrame], n: int = 5, key: str = "chunk_id") -> DataFrame:
    """(stage, query_id, rank, key, score): the first n hits of every stage."""
    out = None
    for name, hits in stages.items():
        part = hits.where(F.col("rank") <= n).select(F.lit(name).alias("stage"), "query_id", "rank", key, "score")
        out = part if out is None else out.unionByName(part)
    return out


def context_of_keys(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, place, chunk_key, content) for returned keys (query_id, place, chunk_key): each once, in order of its first place; unknown keys drop."""
    once = keys.groupBy("query_id", "chunk_key").agg(F.min("place").alias("place"))
    return once.join(chunks.select("chunk_key", "content"), "chunk_key").select("query_id", "place", "chunk_key", "content")


# ---- answers


def distinct_citations(hits: DataFrame) -> DataFrame:
    """The first hit of every (query_id, document, version, page range), ranked anew; nulls are equal."""
    by = ["query_id", "document_key", "version_key", "page_start", "page_end"]
    once = hits.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where("n = 1").drop("n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def carried_over(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each turn with the topic, document and version that hold before it: the last ones set, by the turn itself or else by its first citation."""
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda f, *given: F.last(F.coalesce(*given), ignorenulls=True).over(before).alias(f"before_{f}")
    cited = lambda f: F.get("citations", 0)[f]
    return turns.select(key, "turn", last("topic", F.col("topic")), last("document_key", F.col("document_key"), cited("document_key")), last("version_key", F.col("version_key"), cited("version_key")))


def answer_status(wants_search: Column, n_hits: Column, continues: Column) -> Column:
    return F.when(~wants_search, "no_search").when((n_hits == 0) & continues, "nothing_further").when(n_hits == 0, "insufficient_evidence").otherwise("answered")


def citation_scores(cases: DataFrame, cited: DataFrame, expected: DataFrame, key: str = "document_key") -> DataFrame:
    """(query_id, citation_precision): the share of a case's different citations that are expected; without citations 0 if the case can be answered, else 1."""
    c = cited.select("query_id", key).distinct()
    met = c.join(expected.select("query_id", key).distinct().withColumn("met", F.lit(1)), ["query_id", key], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("met").alias("k"))
    return cases.join(met, "query_id", "left").select("query_id", F.round(F.when(F.coalesce("n", F.lit(0)) > 0, F.col("k") / F.col("n")).otherwise(F.when(F.col("answerable"), 0.0).otherwise(1.0)), 9).alias("citation_precision"))


def latency(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean and 95th percentile (linear between neighbours) of each group; null values do not count.

    Values are numbered in ranges of (group, value) and two of each group are picked, so no task holds a group.
    """
    v = numbered(df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v")), [*by, "_v"], "sorted-values")
    groups = v.groupBy(*by).agg(F.min("at").alias("_first"), F.count("*").alias("_n")).withColumn("_p", (F.col("_n") - 1) * 0.95)
    g = small(groups.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], "_first", "_p"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    picked = v.join(g, same & (F.col("at") - F.col("_first")).isin(F.floor("_p"), F.ceil("_p"))).groupBy(*by, "_p").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    p95 = picked.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.round(F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_p") - F.floor("_p")), 6).alias("p95"))
    mean = df.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"))
    return mean.join(p95, same, "left").select(*by, "mean", "p95")


# ---- pages


def overlaps(start: Column, end: Column, first: int, last: int) -> Column:
    """Whether [start, end] meets [first, last]; a null bound is open."""
    return (start.isNull() | (start <= last)) & (end.isNull() | (end >= first))


def page_slice(pages: DataFrame, start: int, end: int, page: str = "page_number") -> DataFrame:
    if not 1 <= start <= end:
        raise ValueError(f"pages {start} to {end}: 1 <= start <= end is asked")
    return pages.where(F.col(page).between(start, end))


def page_range(rows: DataFrame, by: str, page: str = "page_number") -> DataFrame:
    """(by, first, last) pages of each group."""
    return rows.groupBy(by).agg(F.min(page).alias("first"), F.max(page).alias("last"))


def joined_pages(pages: DataFrame, mode: str = "blank", by: str = "doc_id", page: str = "page_number", text: str = "content") -> DataFrame:
    """(by, text): pages in order with a blank line between them, with a page comment before each (html-comment), or with nothing between them (none)."""
    if mode not in ("blank", "html-comment", "none"):
        raise ValueError(mode)
    one = F.concat(F.lit("<!-- page: "), F.col(page), F.lit(" -->\n\n"), F.col(text)) if mode == "html-comment" else F.col(text)
    rows = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), one.alias("t")))).alias("s"))
    return rows.select(by, F.array_join(F.transform("s", lambda x: x["t"]), "" if mode == "none" else "\n\n").alias("text"))


def numbered_pages(rows: DataFrame, by: str, order: str, page: str) -> DataFrame:
    """``page`` where it is given, else the row's place."""
    return rows.withColumn(page, F.coalesce(F.col(page), F.row_number().over(Window.partitionBy(by).orderBy(order))))


# ---- a whole retrieval in one plan


def branch_lists(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, terms: Column, k: int) -> DataFrame:
    """(query_id, variant, branch, chunk_id, rank): the dense (0) and sparse (1) hits of every variant (query_id, variant, query) among chunks (chunk_id, content)."""
    one = F.struct("query_id", "variant").alias("query_id")
    wanted = queries.select(one, F.explode(terms).alias("term"))
    sparse = sparse_topk(postings(chunks, terms=wanted), wanted, k, chunks=chunks).withColumn("branch", F.lit(1))
    dense = dense_topk(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), query_vectors.select(one, F.col("vector").alias("query")), k, "chunk_id").withColumn("branch", F.lit(0))
    return dense.unionByName(sparse).select("query_id.query_id", "query_id.variant", "branch", "chunk_id", "rank")


def retrieve(
    questions: DataFrame, variants: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame, types: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], terms: Column,
    scores: Callable[[DataFrame], DataFrame], used: DataFrame, top_k: int = 5, configured: int = 30, written: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """The rows of an answer, from questions (query_id, query, wants_list) to hits with their neighbours, in rank order.

    Variants (query_id, position, query) join each question; ``embed`` gives their vectors (query_id, variant, vector), ``terms`` is
    the search terms of the column ``query``. Dense and sparse hits among indexed children of eligible versions are fused by
    variant, then over the variants; ``scores`` reranks them (see ``search``); what an answer before used (query_id, chunk_id) goes
    before the first ``top_k`` are taken, and from their neighbours too. Chunks have chunk_id, chunk_type, index_status,
    version_id, version_key, chunk_key, chunk_index, content, page_start, page_end, heading_path, parent_chunk_id and the
    structure that ``expand`` reads. ``written`` may store the fused lists, which two later steps read.
    """
    k = candidate_k(top_k, configured)
    good = versions.where("review_status = 'approved' and rag_status = 'published' and is_latest").select("version_id")
    live = chunks.where("chunk_type = 'child' and index_status = 'indexed'").join(good, "version_id", "left_semi")
    queries = search_queries(questions, variants)
    lists = written(branch_lists(queries, live.select("chunk_id", "content"), vectors, embed(queries), terms, k), "branches")
    direct = written(search(lists, scores, used, top_k, configured), "direct-hits")
    structure = ["version_key", "chunk_key", "chunk_index", "item", "parent_item", "parent_chunk", "split_index", "split_count"]
    hits = direct.join(live.select("chunk_id", *structure), "chunk_id").join(questions.select("query_id", "wants_list"), "query_id")
    every = expand(hits, live.select(*structure))
    out = every.join(live.select("version_key", "chunk_key", "chunk_id"), ["version_key", "chunk_key"])
    out = without_used(out, used).select("query_id", "rank", "chunk_id", "reason")
    none = F.lit(None).cast("struct<source_file:string,page_start:int,page_end:int,heading_path:array<string>,chunk_key:string,parent_chunk_key:string,source_url:string,legal_unit_type:string,split_index:int,split_count:int>")
    full = hydrate_fields(out.select("query_id", "rank", "chunk_id", F.lit(0.0).alias("score"), none.alias("payload")), chunks, versions, documents, types)
    return full.join(out.select("query_id", "chunk_id", "reason"), ["query_id", "chunk_id"])


def answer_contexts(rows: DataFrame, budget: int = 12_000) -> DataFrame:
    """(query_id, context) of ``retrieve``'s rows, each parent before its first child, within ``budget`` characters."""
    from docloom.operators.structure import contexts

    return contexts(rows.withColumnRenamed("parent_chunk_key", "parent_key"), budget)
