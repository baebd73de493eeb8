"""License scans: k-gram hits on templates, voted by diagonal, neighbouring diagonals merged, spans verified."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import table

#: A word: digits, small letters and whatever isn't ASCII, after A-Z are lower-cased.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram, words that neighbouring diagonals may be apart, least share of a template's words in a verified span.
SIZE, SLACK, LEAST = 3, 4, 0.8
#: Phrases that count wherever their words stand, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Sentences of public licenses, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license"),
)
KEY = ["doc_id", "part", "h"]


def _gram(words: Column, at: Column, size: int) -> list[Column]:
    return [F.get(words, at + i) for i in range(size)]


def grams(spark: SparkSession, texts: Sequence[str], size: int) -> DataFrame:
    """(template, place, gram, t0, t1, ...): the grams of each template; as many rows as the templates have words at most."""
    rows = []
    for k, text in enumerate(texts):
        words = text.split()
        if len(words) < size:
            raise ValueError(f"a template needs {size} words: {text}")
        rows += [(k, at, *words[at : at + size]) for at in range(len(words) - size + 1)]
    names = [f"t{i}" for i in range(size)]
    schema = "template int, place int, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64(*names))


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    size: int = SIZE,
    slack: int = SLACK,
    least: float = LEAST,
) -> DataFrame:
    """(doc_id, n_words, score, matches) of each row of docs (doc_id, text); a match is a struct (start, end, template,
    label, exact, coverage), its words from start to end, both included.

    Every run of `size` words of every whole text is joined by its hash to the places of the templates' runs, words
    compared as well. Hits vote for their diagonal, the word of the text at which the template would begin. A phrase
    matches where all its runs stand on one diagonal. Of a template, a diagonal takes in those up to `slack` words after
    it, so a span may lack or add that many words; it matches if the runs it holds cover `least` of the template's words
    and no other diagonal within `slack` covers more, the first of equals. score is the largest coverage.

    A null text is an empty one: no words, score 0, no matches; so has a text shorter than a run. Rows that share a doc_id,
    or have none, are judged each by its own text; repeated rows come out as often. Other columns aren't read.
    """
    spark = docs.sparkSession
    both = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    wanted = F.broadcast(grams(spark, [text for _, text, _ in both], size))  # bounded by the words of the templates
    lengths, labels, exact = (F.array(*map(F.lit, x)) for x in ([len(t.split()) for _, t, _ in both], [b[0] for b in both], [b[2] for b in both]))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # equal rows of a partition are one; those of different ones stay apart, so none is gathered
    rows = docs.select(F.col("doc_id").cast("bigint"), F.spark_partition_id().alias("part"), F.md5(text).alias("h"), F.regexp_extract_all(lower, F.lit(LICENSE_WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint"))
    places = F.sequence(F.lit(-1), F.greatest(F.size("words") - size, F.lit(-1)))  # -1: a row for each text, besides
    runs = rows.select(*KEY, "n_words", "words", F.explode(places).alias("at"))
    runs = runs.withColumn("run", F.when(F.col("at") >= 0, F.xxhash64(*_gram(F.col("words"), F.col("at"), size))))
    same = F.lit(True)
    for i, word in enumerate(_gram(F.col("words"), F.col("at"), size)):
        same &= word == F.col(f"t{i}")
    hits = runs.join(wanted, F.col("run") == F.col("gram"), "left").where(same | (F.col("at") == -1))
    hits = hits.select(*KEY, "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")

    votes = hits.repartition(*KEY).groupBy(*KEY, "n_words", "template", "diagonal").agg(F.array_sort(F.collect_set("place")).alias("places"), F.count("*").alias("n"))
    by = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    whole = F.get(exact, F.col("template"))
    reach = F.when(whole, F.array("places")).otherwise(F.collect_list("places").over(by.rangeBetween(0, slack)))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(reach), lambda p: F.sequence(p, p + size - 1))))
    first, last = F.col("diagonal") + F.element_at("places", 1), F.col("diagonal") + F.element_at("places", -1) + size - 1
    votes = votes.withColumns(
        {
            "coverage": F.when(F.col("template").isNotNull(), F.size(covered) / F.get(lengths, F.col("template"))),
            "start": F.when(whole, first).otherwise(F.min(first).over(by.rangeBetween(0, slack))).cast("bigint"),
            "end": F.when(whole, last).otherwise(F.max(last).over(by.rangeBetween(0, slack))).cast("bigint"),
        }
    )
    top = F.max(F.struct("coverage", -F.col("diagonal"))).over(by.rangeBetween(-slack, slack))
    fits = F.when(whole, F.col("coverage") == 1).otherwise((F.col("coverage") >= least) & (top == F.struct("coverage", -F.col("diagonal"))))
    match = F.struct("start", "end", "template", F.get(labels, F.col("template")).alias("label"), whole.alias("exact"), "coverage")
    per = votes.withColumn("fits", fits).groupBy(*KEY, "n_words").agg(
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("fits"), match))).alias("matches"),
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("copies"),
    )
    return per.select("doc_id", "n_words", "score", "matches", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["exact"])
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"),
        names("matches").alias("labels"),
        F.floor(F.col("score") * 1e6 + 0.5).cast("double").alias("score"),
    ).withColumn("score", F.col("score") / 1e6)


def _values() -> str:
    both = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in TEMPLATES]
    return ", ".join(f"({k}, '{label}', '{text}', {str(exact).lower()})" for k, (label, text, exact) in enumerate(both))


OP11_SQL = f"""
WITH tp(template, label, phrase, exact) AS (VALUES {_values()}),
tw AS (SELECT *, string_split(phrase, ' ') AS tws FROM tp),
tg AS (SELECT template, label, exact, len(tws) AS length, unnest(range(0, len(tws) - {SIZE - 1})) AS place, tws FROM tw),
tr AS (SELECT template, label, exact, length, place, array_to_string(tws[place + 1:place + {SIZE}], ' ') AS run FROM tg),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
g AS (SELECT r, ws, unnest(range(0, len(ws) - {SIZE - 1})) AS at_ FROM d WHERE len(ws) >= {SIZE}),
h AS (
  SELECT DISTINCT r, template, label, exact, length, at_ - place AS diagonal, place
  FROM g JOIN tr ON array_to_string(ws[at_ + 1:at_ + {SIZE}], ' ') = run),
dg AS (SELECT DISTINCT r, template, label, exact, length, diagonal FROM h),
cv AS (
  SELECT dg.r, dg.template, dg.label, dg.exact, dg.length, dg.diagonal, h.place + unnest(range(0, {SIZE})) AS word
  FROM dg JOIN h ON h.r = dg.r AND h.template = dg.template AND h.diagonal BETWEEN dg.diagonal AND dg.diagonal + CASE WHEN dg.exact THEN 0 ELSE {SLACK} END),
cc AS (SELECT r, template, label, exact, diagonal, count(DISTINCT word)::DOUBLE / any_value(length) AS coverage FROM cv GROUP BY ALL),
m AS (
  SELECT * FROM cc a WHERE CASE WHEN exact THEN coverage = 1 ELSE coverage >= {LEAST} AND NOT EXISTS (
    SELECT 1 FROM cc b WHERE b.r = a.r AND b.template = a.template AND abs(b.diagonal - a.diagonal) <= {SLACK}
      AND (b.coverage > a.coverage OR b.coverage = a.coverage AND b.diagonal < a.diagonal)) END),
per AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM m GROUP BY 1),
sc AS (SELECT r, max(coverage) AS score FROM cc GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       floor(coalesce(score, 0) * 1e6 + 0.5::DOUBLE) / 1e6 AS score
FROM d LEFT JOIN per USING (r) LEFT JOIN sc USING (r)"""
