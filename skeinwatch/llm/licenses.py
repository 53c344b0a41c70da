"""Licences recognised from their sentences.

A text is cut into sentences, each is normalised and looked up among known licence sentences; an
ordered rule recognises a licence from a sequence of identifiers with few other sentences
between. Cuts are made with a line break as white space (wrapped notices) and as an end
(notices on a line of their own), each on the text as it is and with the marks of comments and lists blanked
at the start of its lines, so that a line of marks is an empty line and a list item begins a sentence. Blanks
replace marks one by one: sentences of all ways lie at positions of one text, and a rule may take its from any.

Everything is DataFrame functions. Only texts that contain one of a few stems, at least one of
which every known sentence has, are cut at all. Sequences are compared in windows of one text.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Licence texts, sentence by sentence, by rule; the licence is what stands before "/".
LICENCE_RULES = {
    "MIT/notice": ("Released under the MIT License.",),
    "MIT/licensed": ("Licensed under the MIT License.",),
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0/notice": ("Licensed under the Apache License, Version 2.0.",),
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "GPL-3.0/notice": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ),
    "CC-BY-NC-4.0/notice": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0/notice": ("Licensed under CC BY 4.0.",),
    "MPL-2.0/header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.",),
    "Unlicense/text": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Every known sentence holds one of these, in lower case.
STEMS = ("licens", "copyright", "permission", "permitted", "warrant", "unencumbered", "free to copy")
_GAP = r"[ \t\r\n]"
_ITEM = r"(?:[0-9]{1,3}[.)]|\([a-z0-9]{1,3}\)|[-+\x{2022}])"
_LIST = rf"[ \t]*(?:[*#/;%]+[ \t]+(?:{_ITEM}|\*)|{_ITEM})[ \t]"
#: One code point of what may stand before the words of a line: signs, and the numbers of items.
_MARK = r"(?m)(?:^|\G)(?:[\x20\t!-/:-@\[-`{-~\x{2022}\x{00b7}]|[0-9](?=[0-9]{0,2}[.)][ \t])|(?<=\()[a-z0-9]{1,3}(?=\)[ \t]))"
_WAYS = 5


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def normalised(sentence: Column) -> Column:
    """ASCII letters in lower case and digits, other runs as one space."""
    return F.trim(F.regexp_replace(_lower(sentence), "[^a-z0-9]+", " "))


def has_stem(text: Column) -> Column:
    return F.coalesce(_lower(text).rlike("|".join(STEMS)), F.lit(False))


def rule_steps(spark: SparkSession, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """rule, step (from 1), steps, sentence (normalised), which also is the sentence's identifier's text."""
    rows = []
    for rule, sentences in (LICENCE_RULES if rules is None else rules).items():
        for i, s in enumerate(sentences):
            if not any(stem in s.lower() for stem in STEMS):
                raise ValueError(f"no stem in a sentence of {rule}: {s[:40]}")
            if re.search(rf"[.!?]{_GAP}", s):
                raise ValueError(f"more than one sentence in {rule}: {s[:40]}")
            rows.append((rule, i + 1, len(sentences), _plain(s)))
    items = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("rule", "step", "steps", "sentence"))]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*items).cast("array<struct<rule:string,step:int,steps:int,sentence:string>>")))


def _cut(text: Column, way: int) -> Column:
    """Sentences of a way: line breaks are white space or ends (odd ways), marks stay or are blanked (from 2), a colon at the end of a line is an end (4). Together they are as long as the text."""
    whole = F.translate(text, "\u0001", " ")
    if way >= 2:
        whole = F.regexp_replace(whole, rf"\n(?={_LIST})", "\u0001\n")
        whole = F.regexp_replace(whole, r"(?m)^(?![ \t]*\*)(.*)\n(?=[ \t]*\*[ \t])", "$1\u0001\n")
        whole = F.regexp_replace(whole, r":(?=[ \t\r]*\n)", ":\u0001") if way == 4 else whole
        whole = F.regexp_replace(whole, _MARK, " ")
    ends = F.regexp_replace(whole, rf"([.!?])({_GAP}+)", "$1$2\u0001")
    ends = F.regexp_replace(ends, r"(\n)" if way % 2 else rf"(\n{_GAP}*\n)", "$1\u0001")
    return F.split(ends, "\u0001", -1)


def recognise(docs: DataFrame, steps: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), gap: int = 2) -> DataFrame:
    """One row per text and licence found: `keep`, licence, rule, n_sentences (of the rule), first_sentence, n_times.

    A rule is found where all its sentences follow in order with at most `gap` others (empty ones do not count) between
    neighbours in some way of cutting; of a licence's rules the longest counts, then the first by name. n_times: how often that rule is found.
    Texts without a licence (null and empty ones among them) have no row; repeated rows each have theirs. Columns not in `keep` are not read.
    """
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")).filter(has_stem(F.col("_text")))
    cuts = F.array(*[F.struct(F.lit(i).alias("way"), _cut(F.col("_text"), i).alias("cut")) for i in range(_WAYS)])
    ways = rows.select(*keep, "_row", F.explode(cuts).alias("c"))
    said = ways.select(*keep, "_row", F.col("c.way").alias("way"), F.posexplode("c.cut").alias("nth", "said"))
    known = steps.groupBy("sentence").agg(F.collect_list(F.struct("rule", "step", "steps")).alias("uses"))
    first_word = F.length(F.regexp_extract("said", "^[^A-Za-z0-9]*", 0))
    looked_up = (
        said.select(*keep, "_row", "way", "nth", F.length("said").cast("long").alias("size"), first_word.alias("lead"), normalised(F.col("said")).alias("sentence"))
        .join(F.broadcast(known), "sentence", "left").withColumn("empty", F.col("sentence") == "").drop("sentence")
    )
    through = Window.partitionBy("_row", "way").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = looked_up.withColumn("start", F.sum("size").over(through) - F.col("size") + F.col("lead")).withColumns(
        {f"begun_{i}": F.count(F.when((F.col("way") == i) & ~F.col("empty"), 1)).over(begun) for i in range(_WAYS)}
    )
    begun_in = [f"begun_{i}" for i in range(_WAYS)]
    hits = (
        placed.filter("uses IS NOT NULL").select(*keep, "_row", "way", "nth", "start", *begun_in, F.inline("uses"))
        .groupBy("_row", *keep, "rule", "step", "steps", "start", *begun_in).agg(F.min(F.struct("way", "nth")).alias("at"))
    )
    order = Window.partitionBy("_row", "rule").orderBy("start", "step")
    others = F.least(*[F.col(c) - F.lag(c).over(order) for c in begun_in]) - 1
    follows = (F.col("step") == F.lag("step").over(order) + 1) & (others <= gap)
    runs = hits.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order))
    found = (
        runs.groupBy("_row", *keep, "rule", "steps", "run").agg(F.count("*").alias("n"), F.min("step").alias("from"), F.min("at").alias("first"))
        .filter((F.col("from") == 1) & (F.col("n") == F.col("steps")))
        .groupBy("_row", *keep, "rule", "steps").agg(F.min("first").alias("first"), F.count("*").alias("n_times"))
        .select("_row", *keep, "rule", "steps", F.col("first.way").alias("way"), F.col("first.nth").alias("first_sentence"), "n_times")
    )
    licence = F.substring_index("rule", "/", 1).alias("licence")
    best = found.withColumn("licence", licence).groupBy("_row", *keep, "licence").agg(
        F.min(F.struct((-F.col("steps")).alias("o"), "rule", "way", "steps", "first_sentence", "n_times")).alias("b")
    )
    return best.select(
        *keep, "licence", F.col("b.rule").alias("rule"), F.col("b.steps").alias("n_sentences"),
        F.col("b.first_sentence").alias("first_sentence"), F.col("b.n_times").alias("n_times"),
    )
