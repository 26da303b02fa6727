"""License scans by an exact set-similarity join, with DataFrame functions only.

A text's blocks are its lines, and its paragraphs of several lines (between blank lines). A
block is the set of its words; it holds a template if it has SHARE of PER or more of the
template's different words.

1. Words of the templates are counted in all texts, which gives them one order from rare to
   common, ties by the word.
2. Prefix filter: a template of n words of which a block needs m posts its n - m + 1 rarest;
   a block that holds it has one of them. Blocks meet templates on those words alone.
3. Length filter: a block needs m words of the templates. Positional filter: from the
   first word in common on, both have to have m words left.
4. What is left is verified on the sets.

Blocks stay in their task until verified; only labels are gathered, by document. Templates are
a reference list: they are taken in parts of at most PART_WORDS words, and each part is known to
the driver and sent to all executors.

Beside this, phrases of consecutive words are found in every text; their labels count
whatever the templates say.

Defined results: null and empty texts have no words and no labels (an empty string), score 0;
rows that repeat are each answered; rows of one id that differ in text are told apart by 64
bits of a hash of the text; a null id is an id like any other; an empty table gives an empty
result, and no templates find nothing; templates without words or label are left out;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARE, PER = 90, 100
#: Different words of the templates of one part, about.
PART_WORDS = 20_000

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licenses word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"\n[ \t\x0B\f\r]*\n"


def _words(text: Column) -> Column:
    """Words in the order of the text; only A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def templates(spark: SparkSession) -> DataFrame:
    """label and text of the notices above."""
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def _parts(notices: DataFrame) -> list[list]:
    """label and words of each template, in parts that the driver can hold."""
    worded = notices.where(F.col("label").isNotNull()).select("label", F.array_distinct(_words("text")).alias("words")).where(F.size("words") > 0).distinct()
    total = worded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = -(-total // PART_WORDS)
    dealt = worded.withColumn("part", F.pmod(F.xxhash64("label", "words"), F.lit(max(1, n))))
    return [dealt.where(F.col("part") == k).select("label", "words").collect() for k in range(n)]


def _order(documents: DataFrame, text: str, vocabulary: set[str]) -> list[str]:
    """The templates' words from rare to common over all documents, ties by the word."""
    known = F.broadcast(documents.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    counted = documents.select(F.explode(_words(F.col(text))).alias("word")).join(known, "word", "left_semi").groupBy("word").count()
    times = {r["word"]: r["count"] for r in counted.collect()}  # words of the part's templates only
    return sorted(vocabulary, key=lambda w: (times.get(w, 0), w))


def _blocks(documents: DataFrame, text: str) -> DataFrame:
    """doc, version (hash of the text) and words of each block."""
    own = documents.where(F.col(text).isNotNull()).select(F.col("__id").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    lines = own.select("doc", "version", F.explode(F.split("text", "\n")).alias("block"))
    several = own.select("doc", "version", F.explode(F.split("text", _BLANK)).alias("block")).where(F.trim("block", F.lit("\n")).contains("\n"))
    return lines.union(several).select("doc", "version", F.array_distinct(_words(F.col("block"))).alias("words"))


def held(documents: DataFrame, text: str, part: list, share: int, per: int) -> DataFrame:
    """doc, version, label and containment (words in common over the template's) of blocks that hold a template."""
    spark = documents.sparkSession
    order = _order(documents, text, {w for t in part for w in t.words})
    place = {w: k for k, w in enumerate(order)}
    posts = []
    for t in part:
        own = sorted(t.words, key=place.__getitem__)
        need = max(1, -(-share * len(own) // per))
        posts += [(w, t.label, own, need, k) for k, w in enumerate(own[: len(own) - need + 1])]
    posted = F.broadcast(spark.createDataFrame(posts, "word string, label string, own array<string>, need int, at int"))  # of PART_WORDS words
    ordered = F.from_json(F.lit(_json(order)), "array<string>")
    blocks = _blocks(documents, text)
    met = blocks.select("*", F.explode("words").alias("word")).join(posted, "word")
    # the block's template words, in the common order
    met = met.select("doc", "version", "label", "own", "need", "at", "word", F.array_intersect(ordered, "words").alias("known"))
    left = F.least(F.size("own") - F.col("at"), F.size("known") - F.array_position("known", F.col("word")).cast("int") + 1)
    shared = F.size(F.array_intersect("own", "known"))
    passed = met.where((F.size("known") >= F.col("need")) & (left >= F.col("need"))).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return passed.select("doc", "version", "label", (F.col("shared") / F.size("own")).alias("containment"))


def _json(words: list[str]) -> str:
    import json

    return json.dumps(words, ensure_ascii=False)


def phrase_places(words: str, phrases: dict[str, str]) -> Column:
    """struct<at, label> of every place where a phrase's words stand one after another."""
    by_last: dict[str, list] = {}
    for phrase, label in phrases.items():
        own = phrase.split()
        by_last.setdefault(own[-1], []).append((own, label))

    def here(x: Column, k: Column) -> Column:
        found = []
        for last, ends in by_last.items():
            for own, label in ends:
                same = x == last
                for back, w in enumerate(reversed(own[:-1]), 1):
                    same = same & (F.get(words, k - back) == w)
                found.append(F.when(same, F.struct((k - len(own) + 1).cast("long").alias("at"), F.lit(label).alias("label"))))
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(words, here)) if phrases else F.array().cast("array<struct<at:bigint,label:string>>")


def scan(documents: DataFrame, notices: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", *, phrases: dict[str, str] = PHRASES, share: int = SHARE, per: int = PER) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    score: the highest containment of a template that a block of the text holds, else 0."""
    spark = documents.sparkSession
    own = documents.select(F.col(id_column).alias("__id"), F.coalesce(text_column, F.lit("")).alias("__text"))
    found = [held(own, "__text", part, share, per) for part in _parts(templates(spark) if notices is None else notices)]
    none = spark.createDataFrame([], own.select(F.col("__id").alias("doc"), F.xxhash64("__text").alias("version"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).schema)
    by_text = reduce(DataFrame.union, found, none).groupBy("doc", "version").agg(F.collect_set("label").alias("held"), F.max("containment").alias("score"))
    last = sorted({p.split()[-1] for p in phrases})
    worded = own.select("__id", F.xxhash64("__text").alias("__version"), _words(F.col("__text")).alias("w"))
    some = reduce(lambda a, b: a | b, (F.array_contains("w", x) for x in last), F.lit(False))
    based = worded.select("__id", "__version", F.size("w").cast("long").alias("n_words"), F.when(some, phrase_places("w", phrases)).alias("base"))
    joined = based.join(by_text, F.col("__id").eqNullSafe(F.col("doc")) & (F.col("__version") == F.col("version")), "left")
    base = F.coalesce(F.transform("base", lambda x: x["label"]), F.array().cast("array<string>"))
    labels = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    at = F.transform("base", lambda x: x["at"])
    return joined.select(
        F.col("__id").alias(id_column), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.concat(base, F.coalesce("held", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
