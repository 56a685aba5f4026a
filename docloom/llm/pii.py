"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of the four base patterns (email, ip, card, phone) and of one wider pattern (secret: runs
of 16 or more letters and digits that hold both). Matches and the pieces between them come from one pattern each, so
their running lengths give code point positions.

Six labelers vote on each candidate (1 for, -1 against, 0 no vote): a strict shape, the kind's own check (Luhn, part
range, digit count, variety of characters), a gazetteer (top-level domains, private networks, issuer numbers, country
codes, key prefixes), cue words before the span, its edges, and placeholder patterns. Votes are counted by pattern, a
table of at most 5 * 3^6 * 3 rows. Expectation-maximisation over that table estimates each labeler's reliability and
each kind's share; a logistic span classifier over votes, kind and length is then trained on the estimated labels.
Both are loops of one aggregation each; the driver holds only their parameters.

Base spans stay, whatever the classifier says. It adds candidates that it accepts (probability 0.5 or more) and that
overlap no base span; of those, in order of probability, then place, each one that overlaps none taken before it.

The patterns are written so that no run of characters is tried from each of its places. Nulls and empty texts have no
spans. Rows that repeat a doc_id each give their result. Without candidates nothing is trained.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_text, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
_LOCAL, _PART = "[A-Za-z0-9._%+-]", "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
}
#: What a text must contain for a pattern to be worth a look: cheap, and never missing a span that passes.
GATES = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]", "secret": "[A-Za-z_][0-9]|[0-9][A-Za-z_]"}

# The gazetteers and cue words of the labelers.
TOP_DOMAINS = "com org net edu gov mil int io dev app info biz de fr es it nl uk us eu ch at be pl se no dk fi pt br ca au jp cn in ru".split()
PRIVATE_NETWORKS = r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_PREFIXES = "^(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|glpat)"
CUES = {
    "email": "mail|e-mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|addr|host|server|from|client|serveur|servidor|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|appel|llam|anruf",
    "secret": "password|passwd|pwd|token|secret|api.?key|key|auth|bearer",
}
PLACEHOLDER = r"0{8}|1{8}|9{8}|12345678|(?i)x{6}|^(?:0\.0\.0\.0|255\.255\.255\.255|127\.0\.0\.1)$|^(?i)(?:user|name|test|foo)@"
LABELERS = ("shape", "check", "gazetteer", "cue", "edges", "placeholder")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    figure = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(F.when(i % 2 == 0, twice(figure(i))).otherwise(figure(i)), F.lit(0)))
    return total % 10 == 0


def checks(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's own check."""
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False),
        "phone": n.between(8, 15),
        "secret": F.size(F.array_distinct(F.split(match, ""))) >= 9,
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _votes(kind: str) -> list[Column]:
    match, before, after = F.col("match"), F.lower("before"), F.col("after")
    shape = {"email": "^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$", "ip": "^[1-9][0-9]{0,2}(?:[.][0-9]{1,3}){3}$", "card": "^[0-9]{4}(?:[ -]?[0-9]{4}){3}[0-9]{0,3}$", "phone": "^[+][0-9]{1,3}[ -]?[(]?[0-9]{2,4}[)]?(?:[ .-]?[0-9]{2,4}){2,4}$", "secret": "^(?:[0-9a-f]{16,64}|[A-Z0-9]{16,40}|[A-Za-z0-9_]{20,80})$"}[kind]
    gazetteer = {"email": F.lower(F.element_at(F.split(match, "[.]"), -1)).isin(TOP_DOMAINS), "ip": ~match.rlike(PRIVATE_NETWORKS), "card": match.rlike(ISSUERS), "phone": match.rlike(COUNTRY_CODES), "secret": match.rlike(KEY_PREFIXES)}[kind]
    glued = "[A-Za-z0-9_]"
    ok = checks(kind, match)
    return [
        _vote(match.rlike(shape), ~match.rlike(shape)),
        _vote(ok, ~ok),
        _vote(gazetteer, ~gazetteer) if kind in ("email", "card") else _vote(gazetteer),
        _vote(before.rlike(CUES[kind])),
        _vote(~before.rlike(f"{glued}$") & ~after.rlike(f"^{glued}"), before.rlike(f"{glued}$") | after.rlike(f"^{glued}")),
        F.when(match.rlike(PLACEHOLDER), -1).otherwise(0),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end, base, length, votes...) of every candidate; row tells texts of one doc_id apart."""
    texts = id_text(docs).withColumn("row", F.xxhash64("text"))
    found = []
    for k, kind in enumerate(KINDS):
        text = F.when(F.col("text").rlike(GATES[kind]), F.col("text"))
        got = texts.select("doc_id", "row", F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("matches"), F.split(text, PATTERNS[kind], -1).alias("pieces")).where("size(matches) > 0")
        found.append(got.select("doc_id", "row", F.lit(k).alias("k"), F.explode(F.expr("transform(matches, (m, i) -> struct(i as place, m as match, length(pieces[i]) as gap, right(pieces[i], 32) as before, left(pieces[i + 1], 1) as after))")).alias("m")).select("doc_id", "row", "k", "m.*"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.dropDuplicates(["doc_id", "row", "k", "place"])  # rows that are alike in full
    w = "partition by doc_id, row, k order by place rows unbounded preceding"
    every = every.selectExpr("*", f"sum(gap) over ({w}) + sum(length(match)) over ({w}) as end").withColumn("start", F.col("end") - F.length("match"))
    pick = lambda f: F.expr("case " + " ".join(f"when k = {i} then v{i}" for i in range(len(KINDS))) + " end")[f]
    for i, kind in enumerate(KINDS):
        every = every.withColumn(f"v{i}", F.when(F.col("k") == i, F.array(*_votes(kind))))
    every = every.select("doc_id", "row", "k", "start", "end", "match", *[pick(i).alias(n) for i, n in enumerate(LABELERS)])
    n = F.length("match")
    return every.select("doc_id", "row", "k", "start", "end", ((F.col("k") < len(BASE)) & (F.col("check") == 1)).alias("base"), F.when(n <= 16, 0).when(n <= 24, 1).otherwise(2).alias("size"), *LABELERS)


# ---- labels and classifier


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def _posterior(share: list[float], yes: dict, no: dict) -> Column:
    z = F.element_at(F.array(*[F.lit(math.log(p / (1 - p))) for p in share]), F.col("k") + 1)
    for n in LABELERS:
        z = z + F.element_at(F.array(*[F.lit(math.log(yes[n][v] / no[n][v])) for v in (-1, 0, 1)]), F.col(n) + 2)
    return _sigmoid(z)


def reliabilities(counted: DataFrame, rounds: int = 12) -> tuple[list[float], dict, dict]:
    """(share of each kind, each labeler's vote chances on true spans, and on false ones) by expectation-maximisation over counted votes."""
    share = [0.5] * len(KINDS)
    yes = {n: {-1: 0.1, 0: 0.3, 1: 0.6} for n in LABELERS}
    no = {n: {-1: 0.4, 0: 0.4, 1: 0.2} for n in LABELERS}
    for _ in range(rounds):
        q, c = F.col("q"), F.col("n")
        sums = [F.sum(F.when(F.col("k") == k, c * x)) for k in range(len(KINDS)) for x in (q, 1 - q)]
        sums += [F.sum(F.when(F.col(n) == v, c * x)) for n in LABELERS for v in (-1, 0, 1) for x in (q, 1 - q)]
        got = [float(x or 0) for x in counted.withColumn("q", _posterior(share, yes, no)).agg(*sums).first()]
        share = [(got[2 * k] + 1) / (got[2 * k] + got[2 * k + 1] + 2) for k in range(len(KINDS))]
        at = 2 * len(KINDS)
        for n in LABELERS:
            a, b = got[at : at + 6 : 2], got[at + 1 : at + 6 : 2]
            yes[n] = {v: (x + 0.5) / (sum(a) + 1.5) for v, x in zip((-1, 0, 1), a, strict=True)}
            no[n] = {v: (x + 0.5) / (sum(b) + 1.5) for v, x in zip((-1, 0, 1), b, strict=True)}
            at += 6
    return share, yes, no


def _features() -> list[Column]:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [F.lit(1.0), *[flag(F.col("k") == k) for k in range(len(KINDS))], *[flag(F.col(n) == v) for n in LABELERS for v in (-1, 1)], flag(F.col("size") == 0), flag(F.col("size") == 2)]


def _score(weights: list[float]) -> Column:
    return _sigmoid(sum((f * F.lit(w) for f, w in zip(_features(), weights, strict=True)), F.lit(0.0)))


def trained(counted: DataFrame, steps: int = 25) -> list[float]:
    """Weights of the span classifier, fitted to the expected labels of counted votes."""
    labelled = counted.withColumn("q", _posterior(*reliabilities(counted)))
    total = labelled.agg(F.sum("n")).first()[0]
    w = [0.0] * len(_features())
    m1, m2 = [0.0] * len(w), [0.0] * len(w)
    if not total:
        return w
    for t in range(1, steps + 1):
        off = (_score(w) - F.col("q")) * F.col("n") / float(total)
        g = [float(x) + 1e-4 * v for x, v in zip(labelled.agg(*[F.sum(off * f) for f in _features()]).first(), w, strict=True)]
        for i, x in enumerate(g):
            m1[i], m2[i] = 0.8 * m1[i] + 0.2 * x, 0.99 * m2[i] + 0.01 * x * x
            w[i] -= 0.5 * (m1[i] / (1 - 0.8**t)) / (math.sqrt(m2[i] / (1 - 0.99**t)) + 1e-9)
    return w


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, k, start, end, base, score): base spans and those that the classifier adds."""
    found = stored(candidates(docs), "pii-candidates")
    counted = stored(found.groupBy("k", "size", *LABELERS).agg(F.count("*").alias("n")), "pii-votes")
    found = found.select("doc_id", "row", "k", "start", "end", "base", _score(trained(counted)).alias("score")).where("base or score >= 0.5")
    # overlap: against base spans, then among added ones, by the reach of earlier spans
    w = "partition by doc_id, row order by start, end"
    found = found.selectExpr("*", f"max(if(base, end, 0)) over ({w} rows between unbounded preceding and 1 preceding) as base_before", f"min(if(base, start, null)) over ({w} range between current row and unbounded following) as base_after")
    found = found.where("base or (coalesce(base_before, 0) <= start and (base_after is null or base_after >= end))")
    added = found.where("not base").selectExpr("*", f"max(end) over ({w} rows between unbounded preceding and 1 preceding) as reach")
    added = added.selectExpr("*", f"sum(if(reach is null or start >= reach, 1, 0)) over ({w} rows unbounded preceding) as pile")
    # in each pile of touching spans the most probable first; a span stays if it overlaps none that stays
    added = added.groupBy("doc_id", "row", "pile").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "start", "k", "end", "base", "score"))).alias("s"))
    apart = "(kept, x) -> if(exists(kept, y -> y.start < x.end and x.start < y.end), kept, array_append(kept, x))"
    added = added.selectExpr("doc_id", "row", f"explode(aggregate(s, slice(s, 1, 0), {apart})) as x").select("doc_id", "row", "x.*")
    names = ["doc_id", "row", "k", "start", "end", "base", "score"]
    return found.where("base").select(*names).unionByName(added.select(*names))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each document row; n_spans counts base and added spans."""
    one = "concat(array('" + "','".join(KINDS) + "')[x.k], ':', x.start, ':', x.end)"
    listed = lambda c: F.array_join(F.expr(f"transform(array_sort({c}), x -> {one})"), ",")
    found = spans(docs).withColumn("s", F.struct("k", "start", "end"))
    found = found.groupBy("doc_id", "row").agg(*[F.count_if((F.col("k") == k) & F.col("base")).alias(f"n_{kind}") for k, kind in enumerate(BASE)], F.count("*").alias("n_spans"), F.collect_list(F.when(F.col("base"), F.col("s"))).alias("b"), F.collect_list("s").alias("a"))
    found = found.select("doc_id", "row", *[f"n_{kind}" for kind in BASE], "n_spans", listed("b").alias("base_spans"), listed("a").alias("spans"))
    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("row")).join(found, ["doc_id", "row"], "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in BASE], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets."""
    found = spans(docs).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "k"))).alias("s"))
    rows = id_text(docs).withColumn("row", F.xxhash64("text")).join(found, ["doc_id", "row"], "left")
    cut = "concat(substring(text, if(i = 0, 0, s[i - 1].end) + 1, greatest(x.start - if(i = 0, 0, s[i - 1].end), 0)), '[', array('" + "','".join(KINDS) + "')[x.k], ']')"
    return rows.select("doc_id", F.expr(f"if(s is null, text, concat(array_join(transform(s, (x, i) -> {cut}), ''), substring(text, array_max(transform(s, x -> x.end)) + 1)))").alias("text"))
