"""License scans: phrases of known licenses, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of these characters; in a text whose A-Z are not yet lower-cased, A-Z belong to them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of public license notices, and the label of each.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Share of a template's distinct pairs of neighbouring words that a block has to hold; a template of fewer pairs than
#: ``SHORT`` has to be held whole, as a few common words would make it up by chance.
CONTAINMENT, SHORT = 0.8, 10
#: Templates are broadcast; their number times their words is a parameter of the caller, never of the documents.
MAX_TEMPLATE_WORDS = 20_000


def template_list(templates=TEMPLATES, threshold: float = CONTAINMENT) -> list[tuple[int, str, list[str], int]]:
    """(number, label, sorted distinct word pairs, pairs needed) of each template."""
    split = []
    for i, (label, text) in enumerate(templates):
        words = text.split()
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        split.append((i, label, pairs, len(pairs) if len(pairs) < SHORT else math.ceil(threshold * len(pairs) - 1e-9)))
    return split


def template_words(templates=TEMPLATES, threshold: float = CONTAINMENT) -> list[tuple[list[str], int]]:
    """(sorted distinct words, words needed at least) of each template: a word that is missing takes a pair with it."""
    listed = template_list(templates, threshold)
    words = [sorted({w for pair in pairs for w in pair.split()}) for _, _, pairs, _ in listed]
    return [(w, max(1, len(w) - (len(pairs) - needed))) for w, (_, _, pairs, needed) in zip(words, listed)]


def word_pairs(words: Column) -> Column:
    """Neighbouring words, joined by a space."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def block_pairs(docs: DataFrame, listed: list[tuple[int, str, list[str], int]], worded: list[tuple[list[str], int]], longest: int) -> DataFrame:
    """One row per block that holds a template's pair of words: doc_id, text_key, block, the template pairs in it.

    Blocks are lines and, for notices wrapped over lines, windows of twice ``longest`` words that start at every
    ``longest``-th word of a paragraph, so that ``longest`` words in a row are always in one. Paragraphs end at blank
    lines; one that does not hold enough words of any template has no block that does, and gives none.
    """
    known = F.array(*[F.lit(w) for w in sorted({w for words, _ in worded for w in words})])
    pairs = F.array(*[F.lit(x) for x in sorted({x for _, _, own, _ in listed for x in own})])
    of = lambda text: F.regexp_extract_all(text, F.lit(WORD), 0)
    # U+212A is the one letter that lower() turns into an ASCII letter by itself.
    lowered = F.lower(F.replace(F.col("text"), F.lit("K"), F.lit("ĸ")))
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split(lowered, r"\n[\x00-\x20]*\n")).alias("paragraph", "part"))
    # explode() of one value keeps filters and lambdas from computing the words anew for each use.
    parts = parts.select("*", F.explode(F.array(F.array_intersect(known, of(F.col("part"))))).alias("held"))
    needs = F.array(*[F.struct(F.array(*map(F.lit, words)).alias("words"), F.lit(needed).alias("needed")) for words, needed in worded])
    able = parts.where(F.size("held") >= min(needed for _, needed in worded)).where(F.exists(needs, lambda t: F.size(F.array_intersect(t["words"], F.col("held"))) >= t["needed"]))
    able = able.select("*", F.explode(F.array(of(F.col("part")))).alias("all"))
    lines = F.transform(F.split("part", "\n"), lambda line: F.array_intersect(pairs, word_pairs(of(line))))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - longest - 1, F.lit(0)), F.lit(longest))
    windows = F.when(F.contains(F.col("part"), F.lit("\n")), F.transform(starts, lambda i: F.array_intersect(pairs, word_pairs(F.slice("all", i + 1, 2 * longest))))).otherwise(F.array().cast("array<array<string>>"))
    blocks = able.select("doc_id", "text_key", "paragraph", F.posexplode(F.concat(lines, windows)).alias("at", "words"))
    return blocks.where(F.size("words") > 0).select("doc_id", "text_key", (F.shiftleft(F.col("paragraph").cast("long"), 32) + F.col("at")).alias("block"), "words")


def contained_templates(docs: DataFrame, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Every pair of a block and a template of which it holds at least ``threshold``: doc_id, text_key, block, template, label, containment.

    ``docs`` has doc_id and text (not null). Sets are of pairs of neighbouring words, the tokens here. Template tokens are
    ordered by the number of blocks that hold them, rarest first. A block can reach a template only if it holds one of the template's first ``size - needed + 1`` tokens (prefix
    filter), at least ``needed`` known tokens (length filter), and if enough words can follow the shared one on both
    sides (positional filter). What is left is verified in full.
    """
    spark = docs.sparkSession
    listed = template_list(templates, threshold)
    vocabulary = sorted({w for _, _, words, _ in listed for w in words})
    if not vocabulary:
        return spark.createDataFrame([], "doc_id long, text_key long, block long, template int, label string, containment double")
    if sum(len(words) for _, _, words, _ in listed) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    blocks = materialise(block_pairs(docs, listed, template_words(templates, threshold), max(len(text.split()) for _, text in templates)), "license-blocks")
    counts = {r["word"]: r["count"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    prefixes, whole = [], []
    for number, label, words, needed in listed:
        ranks = sorted(rank[w] for w in words)
        whole.append((number, label, ranks, needed))
        prefixes += [(number, place, r, len(ranks), needed) for place, r in enumerate(ranks[: len(ranks) - needed + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "template int, t_place int, rank int, t_size int, needed int"))
    full = F.broadcast(spark.createDataFrame(whole, "template int, label string, t_ranks array<int>, t_needed int"))
    position = F.array(*map(F.lit, ordered))
    least = min(needed for _, _, _, needed in listed)
    ranked = blocks.where(F.size("words") >= least).select(
        "doc_id", "text_key", "block", F.array_sort(F.transform("words", lambda w: (F.array_position(position, w) - 1).cast("int"))).alias("ranks")
    )
    shared = ranked.select("*", F.size("ranks").alias("b_size"), F.posexplode("ranks").alias("b_place", "rank")).join(index, "rank")
    able = 1 + F.least(F.col("t_size") - F.col("t_place") - 1, F.col("b_size") - F.col("b_place") - 1)
    pairs = shared.where((F.col("b_size") >= F.col("needed")) & (able >= F.col("needed"))).dropDuplicates(["doc_id", "text_key", "block", "template"])
    common = F.size(F.array_intersect("ranks", "t_ranks"))
    return pairs.join(full, "template").where(common >= F.col("t_needed")).select("doc_id", "text_key", "block", "template", "label", (common / F.size("t_ranks")).alias("containment"))


def _labelled(label: str):
    return lambda at: F.struct(at.alias("at"), F.lit(label).alias("label"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places at which the words of ``phrase`` stand one after the other, counted from 0."""
    parts = phrase.split()
    here = lambda i: F.get(words, i) == parts[0]

    def match(i: Column) -> Column:
        found = here(i)
        for step, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + step) == part)
        return found

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), match)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of all phrases; ``labels`` adds the templates' labels. ``score`` is 1 where a phrase
    stands, else the best containment found, else 0. A null or empty text has no words, places or labels; repeated rows
    come back alike; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = contained_templates(docs, templates, threshold)
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "own", "best")

    maybe = "(?i)" + "|".join(GAP.join(p.split()) for p in PHRASES)
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 0)
    none = F.array().cast("array<struct<at:int,label:string>>")
    hits = [F.transform(phrase_starts(F.col("words"), p), _labelled(label)) for p, label in PHRASES.items()]
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(maybe), words).alias("words"),
    ).withColumn("hits", F.when(F.col("words").isNotNull(), F.flatten(F.array(*hits))).otherwise(none)).drop("words")
    labels = F.array_sort(F.array_distinct("hits.label"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    return joined.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"),
        F.array_min("hits.at").cast("long").alias("first_word"), F.array_max("hits.at").cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"({number}, '{label}', {words!r}, {needed})" for number, label, words, needed in template_list())
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
    longest = max(len(text.split()) for _, text in TEMPLATES)
    return rf"""
with p(label, parts) as (values {phrases}),
t(template, label, words, needed) as (values {rows}),
d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from d),
places as (
  select doc_id, p.label, i - 1 as pos from w, p, unnest(generate_series(1, len(words))) as g(i)
  where words[i:i + len(p.parts) - 1] = p.parts),
base as (
  select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_sort(list_distinct(list(label))) as labels from places group by doc_id),
paragraphs as (select doc_id, unnest(regexp_split_to_array(text, '\n[\x00-\x20]*\n')) as part from d),
wrapped as (select doc_id, regexp_extract_all(part, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from paragraphs where contains(part, chr(10))),
blocks as (
  select doc_id, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from (select doc_id, unnest(string_split(part, chr(10))) as line from paragraphs)
  union all select doc_id, words[i + 1:i + {2 * longest}] from wrapped, unnest(generate_series(0, greatest(len(words) - {longest} - 1, 0), {longest})) as g(i)),
paired as (select doc_id, list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1]) as pairs from blocks where len(words) > 1),
own as (
  select doc_id, t.label, len(list_intersect(t.words, b.pairs)) / len(t.words) as containment from paired b, t
  where len(list_intersect(t.words, b.pairs)) >= t.needed),
best as (select doc_id, list(label) as labels, max(containment) as best from own group by doc_id)
select w.doc_id, len(w.words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(coalesce(base.labels, []), ',') as base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(best.labels, []))), ',') as labels,
  case when base.n_base > 0 then 1.0::double else coalesce(best.best, 0.0::double) end as score
from w left join base using (doc_id) left join best using (doc_id)
"""


SQL = _sql()
