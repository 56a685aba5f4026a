"""License scan by diagonal voting.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. All rolling 3-word hashes of all
documents are joined by Spark to the places they have in the templates. A match votes for its diagonal: place in the
document minus place in the template.

* A phrase stands wherever one diagonal has the votes of all its 3-grams. These are the base places.
* A notice is longer and may differ: in a stretch of votes that lie within one template length of each other,
  diagonals in order are merged while the next is at most ``drift`` = 3 words on, and the merged span is verified by
  how many different template places voted in it: at least ``coverage`` = 60 %. Verified spans are taken in order of
  share (ties: the longer template, then the label), each one that overlaps none taken before it.

The template table is a constant of a few hundred rows; it is only broadcast while under ``BROADCAST_ROWS`` and
joined by shuffle beyond. 3-grams are compared by 64-bit hashes.

Nulls and empty texts: no words, no labels, score 0. Rows that repeat a doc_id each give their result. The score is
the largest verified share of a template, 1 for a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import id_text, rolled, stored, text_chunks, words

K, DRIFT, COVERAGE, BROADCAST_ROWS = 3, 3, 0.6, 100_000

# The phrases that count as base, and the opening words of public license notices.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]

SEPARATOR = np.ones(256, bool)
SEPARATOR[ord("0") : ord("9") + 1] = SEPARATOR[ord("a") : ord("z") + 1] = SEPARATOR[128:] = False


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, int, int]]:
    """(template, label, is a phrase, number of 3-grams, place, hash) of every 3-gram."""
    out = []
    for t, (label, text, phrase) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        raw = np.frombuffer(text.encode(), np.uint8)
        grams = rolled(words(raw, np.array([0, len(raw)]), SEPARATOR)[0], K).view(np.int64)
        out += [(t, label, phrase, len(grams), k, int(h)) for k, h in enumerate(grams)]
    return out


def _words(with_grams: bool):
    """(doc_id, text, row) to (doc_id, row, n_words or all 3-gram hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, data, offs in text_chunks(iter([batch])):
                w, first, _ = words(data, offs, SEPARATOR)
                out = pa.array(np.diff(first))
                if with_grams:
                    g = rolled(w, K)
                    n = np.maximum(np.diff(first) - K + 1, 0)
                    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(g[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(2).slice(done, len(ids)), out], ["doc_id", "row", "grams" if with_grams else "n_words"])
                done += len(ids)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return id_text(docs).select("doc_id", "text", F.xxhash64("text").alias("row"))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, row, template, ..., diagonal, places): each diagonal's distinct template places; row tells texts of one doc_id apart."""
    grams = _rows(docs).mapInArrow(_words(True), "doc_id long, row long, grams array<long>")
    return grams.select("doc_id", "row", F.posexplode("grams").alias("word", "gram")).join(table, "gram").groupBy("doc_id", "row", "template", "label", "phrase", "n_grams", F.expr("word - place").alias("diagonal")).agg(F.collect_set("place").alias("places"))


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, row, label, phrase, word, n_words, score): every base place and every verified span that stays."""
    spark: SparkSession = docs.sparkSession
    rows = templates(phrases, notices)
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, n_grams int, place int, gram long")
    by = stored(votes(docs, F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table), "license-votes")
    exact = by.where("phrase and size(places) = n_grams").selectExpr("doc_id", "row", "label", "true as phrase", "diagonal as word", f"n_grams + {K - 1} as n_words", "1.0D as score")

    part = by.where("not phrase").selectExpr("*", "diagonal + array_min(places) as low", f"diagonal + array_max(places) + {K} as high")
    # stretches of votes at most one template apart, and in each of them runs of neighbouring diagonals
    w = "partition by doc_id, row, template order by low, diagonal"
    part = part.selectExpr("*", f"max(high) over ({w} rows between unbounded preceding and 1 preceding) as before")
    part = part.selectExpr("*", f"sum(if(before is null or low > before + n_grams, 1, 0)) over ({w} rows unbounded preceding) as stretch")
    w = "partition by doc_id, row, template, stretch order by diagonal"
    part = part.selectExpr("*", f"lag(diagonal) over ({w}) as beside")
    part = part.selectExpr("*", f"concat_ws(':', stretch, sum(if(diagonal - beside <= {DRIFT}, 0, 1)) over ({w} rows unbounded preceding)) as span")
    whole = part.groupBy("doc_id", "row", "template", "label", "n_grams", "span").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    whole = whole.selectExpr("*", "size(places) / n_grams as score").where(f"score >= {COVERAGE}")
    w = "partition by doc_id, row order by low, high"
    whole = whole.selectExpr("*", f"max(high) over ({w} rows between unbounded preceding and 1 preceding) as before")
    whole = whole.selectExpr("*", f"sum(if(before is null or low >= before, 1, 0)) over ({w} rows unbounded preceding) as pile")
    whole = whole.groupBy("doc_id", "row", "pile").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), (-F.col("n_grams")).alias("shorter"), "label", "low", "high", "score"))).alias("s"))
    apart = "(kept, x) -> if(exists(kept, y -> y.low < x.high and x.low < y.high), kept, array_append(kept, x))"
    whole = whole.selectExpr("doc_id", "row", f"explode(aggregate(s, slice(s, 1, 0), {apart})) as x").select("doc_id", "row", "x.*")
    return exact.unionByName(whole.selectExpr("doc_id", "row", "label", "false as phrase", "low as word", "high - low as n_words", "score"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document row."""
    found = spans(docs)
    base = lambda c: F.expr(f"case when phrase then {c} end")
    found = found.groupBy("doc_id", "row").agg(
        F.count(base("word")).alias("n_base"), F.min(base("word")).cast("long").alias("first_word"), F.max(base("word")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )

    counted = _rows(docs).mapInArrow(_words(False), "doc_id long, row long, n_words long")
    out = counted.join(found, ["doc_id", "row"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
