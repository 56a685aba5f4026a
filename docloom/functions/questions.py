"""Understanding of questions: decisions, metadata hints, list intent, rewrite variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import col, expand_abbreviations, normalize_query

# Whole questions with a meaning of their own, and the fixed replies.
GREETINGS = ["hi", "hello", "chào", "xin chào", "alo"]
UNDERSPECIFIED = ["điều kiện là gì", "hồ sơ gồm gì", "nộp ở đâu", "cần gì", "cần giấy gì"]
CONTINUATIONS = ["tiếp", "tiếp đi", "nói tiếp", "trả lời tiếp", "còn gì", "còn gì không", "còn nữa không", "còn không", "có gì thêm không"]
LIST_CUES = ["gồm gì", "bao gồm", "các trường hợp nào", "cần giấy tờ gì", "có những loại nào", "hồ sơ gồm gì"]
ASK_QUESTION = "Vui lòng nhập câu hỏi."
GREETING_REPLY = "Chào bạn, mình là trợ lý hỗ trợ tra cứu thông tin sinh viên. Bạn muốn hỏi về nội dung nào?"
CLARIFY_FOLLOW_UP = "Bạn muốn hỏi tiếp về nội dung nào? Vui lòng nêu lại chủ đề hoặc câu hỏi trước đó."
CLARIFY_AMBIGUOUS = "Bạn muốn hỏi điều kiện hoặc hồ sơ của thủ tục nào?"
# Names by which departments, document types and domains are recognised.
ALIASES = {
    "department": {"PDT": ["pđt", "pdt", "phòng đào tạo"], "PCTSV": ["pctsv", "phòng công tác sinh viên"], "PKHTC": ["pkhtc", "phòng kế hoạch tài chính"], "PTV": ["ptv", "phòng tài vụ"]},
    "document_type": {
        "noi_quy": ["nội quy"], "quy_trinh": ["quy trình"], "bieu_mau": ["biểu mẫu", "mẫu đơn", "đơn mẫu"], "hoi_dap": ["hỏi đáp", "câu hỏi thường gặp", "faq"], "ke_hoach": ["kế hoạch"], "thong_bao": ["thông báo"],
        "bao_cao": ["báo cáo"], "huong_dan": ["hướng dẫn"], "quyet_dinh": ["quyết định"], "cong_van": ["công văn"], "thong_tu": ["thông tư"], "nghi_quyet": ["nghị quyết"],
        "vh_xh": ["văn hóa xã hội", "bạo lực học đường", "tệ nạn xã hội", "an toàn trường học"],
    },
    "domain": {
        "hoc_vu": ["học vụ", "đăng ký học phần", "lịch thi"], "hoc_phi": ["học phí", "miễn giảm học phí"], "dao_tao": ["chương trình đào tạo", "quy chế đào tạo"], "nghien_cuu_khoa_hoc": ["nghiên cứu khoa học", "nckh"],
        "hop_tac_quoc_te": ["hợp tác quốc tế", "trao đổi quốc tế", "du học"], "hoc_bong": ["học bổng"], "sinh_vien": ["ký túc xá", "ktx", "công tác sinh viên", "rèn luyện"],
    },
}


def decision(question: Column | str, topic: Column | str, document: Column | str, version: Column | str) -> Column:
    """Whether and for what to search: struct(should_search, query, message, clarification, is_follow_up)."""
    topic, document, version = col(topic), col(document), col(version)
    normal = F.coalesce(normalize_query(question), F.lit(""))
    full = expand_abbreviations(normal)
    greeting, more, vague = normalize_query(full).isin(GREETINGS), full.isin(CONTINUATIONS), full.isin(UNDERSPECIFIED)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    known = filled(topic) | filled(document) | filled(version)
    none = F.lit(None).cast("string")
    out = lambda search, query, message, clarify, follow: F.struct(F.lit(search).alias("should_search"), query.alias("query"), message.alias("message"), clarify.alias("clarification"), follow.alias("is_follow_up"))
    no = F.lit(False)
    resolved = F.when(more & filled(topic), topic).when(~more & vague & filled(topic), F.concat(full, F.lit(" cho "), topic)).otherwise(full)
    return (
        F.when(normal == "", out(False, F.lit(""), F.lit(ASK_QUESTION), none, no))
        .when(greeting, out(False, full, F.lit(GREETING_REPLY), none, no))
        .when(more & ~known, out(False, full, none, F.lit(CLARIFY_FOLLOW_UP), no))
        .when(vague & ~known, out(False, full, none, F.lit(CLARIFY_AMBIGUOUS), no))
        .otherwise(out(True, resolved, none, none, more))
    )


def metadata_hint(question: Column | str, kind: str) -> Column:
    """The value whose longest alias stands in the question; among equally long the greater value. Null if none does."""
    found = [
        F.when(col(question).rlike(rf"(?iU)(?<![\p{{L}}\p{{N}}_]){alias}(?![\p{{L}}\p{{N}}_])"), F.struct(F.lit(len(alias)).alias("n"), F.lit(value).alias("value")))
        for value, aliases in ALIASES[kind].items()
        for alias in aliases
    ]
    return F.array_max(F.array_compact(F.array(*found)))["value"]


def wants_list(question: Column | str) -> Column:
    q = F.lower(F.trim(col(question)))
    out = F.lit(False)
    for cue in LIST_CUES:
        out = out | q.contains(cue)
    return out


def variants(questions: DataFrame, most: int = 3, longest: int = 2000) -> DataFrame:
    """(query_id, position, query): the question and the rewrites in its JSON answer.

    The answer {"queries": [...]} is read as it is, else from its first brace to its last. Repeats (by lower case),
    empty and overlong ones go; the question stays first.
    """
    shape = "queries array<string>"
    whole = F.from_json("answer", shape)["queries"]
    inner = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), shape)["queries"]
    every = questions.select("query_id", F.posexplode(F.concat(F.array(F.trim("question")), F.coalesce(whole, inner, F.array().cast("array<string>")))).alias("place", "q"))
    every = every.withColumn("q", F.trim("q")).where((F.col("q") != "") & (F.length("q") <= longest))
    first = Window.partitionBy("query_id", F.lower("q")).orderBy("place")
    every = every.withColumn("n", F.row_number().over(first)).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return every.select("query_id", rank.alias("position"), F.col("q").alias("query")).where(F.col("position") <= most)


def offline_variants(questions: DataFrame) -> DataFrame:
    """(query_id, position, query) without a model: the question, then its abbreviations written out where that changes it. Blank questions have none."""
    q = F.col("question")
    both = F.array_distinct(F.filter(F.array(q, expand_abbreviations(q)), lambda x: F.trim(x) != ""))
    out = questions.select("query_id", F.posexplode(both).alias("position", "query"))
    return out.select("query_id", (F.col("position") + 1).alias("position"), "query")
