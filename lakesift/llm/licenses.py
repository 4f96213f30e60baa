"""License scan by diagonal voting.

All rolling word pairs of a text are joined, by hash, to the word pairs of a
fixed table of license phrases and notices. A match at word `w` of the text and
word `t` of a template votes for the diagonal `w - t`: the word at which the
template would start. Votes are summed by diagonal, kept as a bit set of template
positions.

* A base phrase stands where its own diagonal holds all of its pairs.
* A notice may have words put in or left out, which moves its votes to
  neighbouring diagonals: each diagonal is merged with those up to `drift` away. The
  notice is found where the merged votes cover at least `coverage` of it as a span.

Spans are verified: a vote counts only if both words equal the template's, so a
hash collision never counts, and a base phrase's place is exact. Merged votes count as far
as they're in order: what counts is the longest chain of them in which template positions rise
with the text's words, so the words of a notice in another order aren't the notice.

Main path: DataFrame functions only. The template table is fixed (a few hundred
pairs) and broadcast; texts aren't shuffled, only the votes are, counted by document and text first, so
repeated rows add nothing. A sentinel pair after the words carries texts without any vote. Documents are told
apart by id and the MD5 of the text, which a task that runs again finds alike.

Defined cases: a null text is empty (no words, labels empty strings, score 0);
equal rows each give a row; texts of any length are
read whole; an empty table gives an empty result; columns other than the id and the
text aren't looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.llm.common import table, text_or_empty

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of public license notices, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-program",
    "licensed under the apache license version 2 0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-terms",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-work",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-terms",
    "permission to use copy modify and or distribute this software for any purpose": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DRIFT = 3
COVERAGE = 0.8
SENTINEL = " "


def template_rows(base=BASE, notices=NOTICES) -> list[tuple]:
    """(template, label, is_base, pairs, at, word, next_word) for every word pair of every template."""
    out = []
    for n, (phrase, label, is_base) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items()]):
        words = [w for w in re.split(SEPARATORS, phrase) if w]
        if not 2 <= len(words) <= 63:
            raise ValueError(f"a template needs 2 to 63 words: {phrase!r}")
        out += [(n, label, is_base, len(words) - 1, at, words[at], words[at + 1]) for at in range(len(words) - 1)]
    return out


def _templates(spark: SparkSession, base, notices) -> DataFrame:
    def literal(row: tuple):
        names = ("template", "label", "is_base", "pairs", "at", "t_word", "t_next")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)])

    rows = template_rows(base, notices) + [(-1, "", False, 1, 0, SENTINEL, SENTINEL)]
    return spark.range(1).select(F.inline(F.array(*map(literal, rows)))).withColumn("t_hash", F.xxhash64("t_word", "t_next"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """A row per document: words, base places, labels and the best coverage found."""
    # Only the Kelvin sign turns into an ASCII letter under lower(); everything else that lower() changes stays non-ASCII.
    plain = F.lower(F.replace(text_or_empty(text_col), F.lit("\u212a"), F.lit("\u0137")))
    words = F.array_remove(F.split(plain, SEPARATORS), "")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_or_empty(text_col)).alias("digest"), words.alias("words"))
    tail = F.array(F.lit(SENTINEL), F.lit(SENTINEL))
    doc = ["doc_id", "digest", "n_words"]
    sized = docs.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.concat("words", tail).alias("words"))
    rolled = F.arrays_zip(F.col("words").alias("word"), F.slice("words", 2, F.size("words")).alias("next"))
    pairs = sized.select(*doc, F.posexplode(rolled).alias("start", "pair"))
    pairs = pairs.select(*doc, "start", F.col("pair")["word"].alias("word"), F.col("pair")["next"].alias("next"))
    templates = F.broadcast(_templates(docs.sparkSession, base, notices))
    votes = pairs.join(templates, (F.xxhash64("word", "next") == F.col("t_hash")) & (F.col("word") == F.col("t_word")) & (F.col("next") == F.col("t_next")))
    what = [*doc, "template", "label", "is_base", "pairs"]
    votes = votes.groupBy(*what, "start", "at").agg(F.count(F.lit(1)).alias("copies"))
    # No neighbourhood of diagonals covers more than all diagonals together.
    reach = F.bit_count(F.bit_or(F.expr("shiftleft(1L, at)")).over(Window.partitionBy(*doc, "template"))) / F.col("pairs")
    votes = votes.withColumn("reach", reach).where(F.col("is_base") | (F.col("reach") >= coverage))
    near = F.when(F.col("is_base"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-drift), F.lit(drift)))
    diagonal = (F.col("start") - F.col("at") + F.col("off")).cast("long").alias("diagonal")
    # A diagonal's votes are few: at most a template's pairs times its neighbours.
    merged = votes.withColumn("off", F.explode(near)).groupBy(*what, diagonal).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"), F.array_sort(F.collect_list(F.struct(F.col("start"), (-F.col("at")).alias("back")))).alias("hits"), F.max("copies").alias("copies")
    )
    ordered = F.when(F.bit_count("seen") >= coverage * F.col("pairs"), _in_order(F.col("hits"), F.col("pairs"))).otherwise(0)
    found = merged.withColumn("covered", F.when(F.col("template") >= 0, ordered / F.col("pairs")).otherwise(0.0))
    full = F.col("is_base") & (F.col("covered") == 1.0)
    good = full | (~F.col("is_base") & (F.col("covered") >= coverage))

    def joined(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    place = F.when(full, F.col("diagonal"))
    scored = found.groupBy(*doc).agg(
        F.count_if(full).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        joined(full).alias("base_labels"),
        joined(good).alias("labels"),
        F.max(F.when(good, F.col("covered")).otherwise(0.0)).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
    )
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scored.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def _in_order(hits: Column, pairs: Column) -> Column:
    """The length of the longest chain of hits in which words of the text and template positions rise; hits: (start, -at), sorted.

    For each template position, the longest chain so far that ends there. Hits of one start come with the last position first, so they never follow each other.
    """

    def longer(best: Column, hit: Column) -> Column:
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), -hit["back"])), F.lit(0))
        return F.transform(best, lambda x, at: F.when(at == -hit["back"], F.greatest(x, before + 1)).otherwise(x))

    return F.array_max(F.aggregate(hits, F.array_repeat(F.lit(0), pairs), longer))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    rows = ", ".join(f"({n}, '{label}', {is_base}, {pairs}, {at}, '{w}', '{x}')" for n, label, is_base, pairs, at, w, x in template_rows())
    return f"""
WITH templates(template, label, is_base, pairs, pos, t_word, t_next) AS (VALUES {rows}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS words
  FROM documents),
places AS (SELECT rid, words, unnest(range(0, len(words)::BIGINT - 1)) AS p FROM docs),
votes AS (
  SELECT rid, template, label, is_base, pairs, pos, p, p - pos AS diagonal
  FROM places JOIN templates ON words[p + 1] = t_word AND words[p + 2] = t_next),
moved AS (
  SELECT rid, template, label, is_base, pairs, pos, p, diagonal + unnest(CASE WHEN is_base THEN [0] ELSE range(-{DRIFT}, {DRIFT + 1}) END) AS diagonal FROM votes),
grouped AS (
  SELECT rid, label, is_base, diagonal, pairs, count(DISTINCT pos) AS seen, list([p, -pos]::BIGINT[] ORDER BY p, -pos) AS hits
  FROM moved GROUP BY rid, template, label, is_base, pairs, diagonal),
merged AS (
  SELECT rid, label, is_base, diagonal, CASE WHEN seen < {COVERAGE} * pairs THEN 0 ELSE list_max(list_reduce(hits,
    lambda best, hit: list_transform(best, lambda x, k: CASE WHEN k = 1 - hit[2] THEN greatest(x, 1 + coalesce(list_max(best[1:-hit[2]]), 0)) ELSE x END),
    list_transform(range(pairs::BIGINT), lambda x: 0::BIGINT))) END::DOUBLE / pairs AS covered FROM grouped),
found AS (SELECT *, is_base AND covered = 1 AS whole, covered >= CASE WHEN is_base THEN 1 ELSE {COVERAGE} END AS good FROM merged),
summed AS (
  SELECT rid, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels, max(covered) FILTER (good) AS score
  FROM found GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (rid)
"""
