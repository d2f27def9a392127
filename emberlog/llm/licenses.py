"""License scans by diagonal voting.

All rolling k-word hashes of each text meet the hashes of the templates in a join; a hit at word p of the text and word q of
a template votes for the diagonal p - q. Votes are counted by text and diagonal, neighbouring diagonals merge (a word more or
less shifts the rest of a match), and a merged run counts when the words between its first and last hit cover enough of the
template. Where verified places of several templates lie over each other, those of a lower score than another go. Beside that,
fixed phrases are looked up where they stand.

The templates are a fixed list in code, so their side of the join is bounded; texts are never joined to each other.

Null text counts as empty. Rows are told apart by numbers of their own, so repeated rows, rows that share a key and rows
without one are scanned each for itself. An empty table gives an empty table. Input columns
other than the key and the text don't pass through scan(), so no names clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.native import let
from emberlog.llm.scratch import ROW, numbered

K = 4
#: Diagonals at most so far apart merge.
DRIFT = 3
#: A template is found when verified hits cover so much of its k-grams.
COVER = 0.6
#: Words of a block in which places of templates are compared.
BLOCK_WORDS = 256
#: The join side of the templates may have so many rows at most to be broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: So many hashes of templates may stand in the plan, to tell which k-grams need to be joined.
PROBED_HASHES = 20_000

#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public notices and the labels they give. Of long licenses, the passage that names them or grants their rights.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ],
    "0bsd": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "wtfpl": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ],
    "postgresql": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is "
        "hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "cc0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}


def normal(text: Column) -> Column:
    """The words of text in lower case, each followed by one space. Case of letters beyond A to Z bounds no words and is in no
    phrase."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    held = F.ltrim(spaced)
    return F.when((held == "") | held.endswith(" "), held).otherwise(F.concat(held, F.lit(" ")))


def _count(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def _grams(words: Column, k: int) -> Column:
    """array<struct<g: hash of k words, at>>."""
    parts = lambda w, i: [F.get(w, i + j) for j in range(k)]
    return let(
        words,
        lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*parts(w, i)).alias("g"), i.alias("at")))).otherwise(
            F.array().cast("array<struct<g: bigint, at: int>>")
        ),
    )


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None, k: int = K) -> DataFrame:
    """label, template (int), g, at, size (k-grams in the template), length (words): one row for each place of a k-gram."""
    rows = [(label, text) for label, texts in (templates or TEMPLATES).items() for text in texts]
    table = spark.createDataFrame([(label, n, text) for n, (label, text) in enumerate(rows)], "label string, template int, text string")
    words = F.array_remove(F.split(normal(F.col("text")), " "), "")
    return (
        table.withColumn("words", words)
        .select("label", "template", F.size("words").alias("length"), F.explode(_grams(F.col("words"), k)).alias("x"))
        .select("label", "template", "length", F.col("x.g").alias("g"), F.col("x.at").alias("at"), (F.col("length") - k + 1).alias("size"))
    )


def _votes(hits: DataFrame, side: DataFrame, k: int, cover: float) -> DataFrame:
    """hits: ROW, g, p. Verified places of templates by row: ROW, label, template, first, last, score."""
    met = hits.join(side, "g").select(ROW, "label", "template", "size", "length", "p", F.col("at").alias("q"), (F.col("p") - F.col("at")).alias("diagonal"))
    votes = met.groupBy(ROW, "label", "template", "size", "length", "diagonal").agg(F.countDistinct("q").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    order = Window.partitionBy(ROW, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT
    merged = (
        votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
        .groupBy(ROW, "label", "template", "size", "length", "run")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    verified = merged.withColumn("score", F.least(F.col("votes") / F.col("size"), F.lit(1.0))).filter(
        (F.col("score") >= cover) & (F.col("last") - F.col("first") + k <= 2 * F.col("length") + DRIFT)
    )
    found = verified.select(ROW, "label", "template", "first", (F.col("last") + k - 1).alias("last"), "score")
    # Notices that share words: of those that lie over each other, one with a lower score goes. They meet by blocks of words.
    block = F.explode(F.sequence(F.floor(F.col("first") / BLOCK_WORDS), F.floor(F.col("last") / BLOCK_WORDS)))
    other = found.select(F.col(ROW).alias("__r"), F.col("first").alias("__f"), F.col("last").alias("__l"), F.col("score").alias("__s"), block.alias("__b"))
    over = (F.col(ROW) == F.col("__r")) & (F.col("block") == F.col("__b")) & (F.col("__f") <= F.col("last")) & (F.col("first") <= F.col("__l")) & (F.col("__s") > F.col("score"))
    beaten = found.withColumn("block", block).join(other, over, "left_semi").select(ROW, "template", "first", "last").distinct()
    return found.join(beaten, [ROW, "template", "first", "last"], "left_anti")


def _probed(words: Column, table: DataFrame, k: int) -> Column:
    """The k-grams of words that some template holds: all are probed against the set of the templates' hashes, if it is small
    enough to stand in the plan; a longer list leaves the probing to the join."""
    known = [r[0] for r in table.select("g").distinct().limit(PROBED_HASHES + 1).collect()]
    grams = _grams(words, k)
    return grams if len(known) > PROBED_HASHES else F.filter(grams, lambda x: x["g"].isin(known))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, k: int = K, cover: float = COVER) -> DataFrame:
    """Verified places of templates: key, ROW (a number of the row's own), label, template, first (word), last, score (share of the template's k-grams)."""
    rows, found = _scanned(docs, key, text, templates, {}, k, cover)
    return found.join(rows.select(ROW, key), ROW).select(key, ROW, "label", "template", "first", "last", "score")


def _scanned(docs: DataFrame, key: str, text: str, templates: dict[str, list[str]] | None, phrases: dict[str, str] | None, k: int = K, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """phrase_places() with ROW, and the verified places of templates. Texts are read, normalised and split once; what is found
    is written without the texts, with a number for each row, so that rows which share a key stay apart."""
    table = template_table(docs.sparkSession, templates, k)
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    words = lambda x: F.array_remove(F.split(x, " "), "")
    of = _places(phrases)
    both = let(normal(F.col(text)), lambda x: F.struct(of(x).alias("p"), _probed(words(x), table, k).alias("hits")))
    read = numbered(docs.select(F.col(key), both.alias("__b")).select(key, "__b.p.n_words", "__b.p.f.*", F.col("__b.hits").alias("__hits")))
    hits = read.filter(F.size("__hits") > 0).select(ROW, F.explode("__hits").alias("x")).select(ROW, F.col("x.g").alias("g"), F.col("x.at").alias("p"))
    return read.drop("__hits"), _votes(hits, side, k, cover)


def _places(phrases: dict[str, str] | None) -> Callable[[Column], Column]:
    """Of normal text: struct<n_words, f: struct<n_base, first_word, last_word, base>>."""
    phrases = PHRASES if phrases is None else phrases
    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base"))

    def found(x: Column) -> Column:
        padded = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")))  # a space of its own on each side of each word

        def one(phrase: str) -> list[Column]:
            mark = f" {phrase.replace(' ', '  ')} "
            n = _count(padded, mark)
            before = F.floor(_count(F.substring_index(padded, mark, 1), " ") / 2)
            after = F.floor(_count(F.substring_index(padded, mark, -1), " ") / 2)
            return [n, F.when(n > 0, before), F.when(n > 0, _count(x, " ") - after - len(phrase.split()))]

        places = [one(p) for p in phrases]
        if not places:
            return none
        return F.struct(
            sum((p[0] for p in places[1:]), places[0][0]).alias("n_base"),
            F.array_min(F.array(*[p[1] for p in places])).alias("first_word"),
            F.array_max(F.array(*[p[2] for p in places])).alias("last_word"),
            F.array_compact(F.array(*[F.when(p[0] > 0, F.lit(label)) for p, label in zip(places, phrases.values(), strict=True)])).alias("base"),
        )

    def of(x: Column) -> Column:
        some = F.lit(False)
        for p in phrases:
            some = some | x.contains(p)
        return F.struct(_count(x, " ").alias("n_words"), F.when(some, found(x)).otherwise(none).alias("f"))

    return of


def phrase_places(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base (array of labels): where phrases stand as whole words."""
    return docs.select(F.col(key), let(normal(F.col(text)), _places(phrases)).alias("__p")).select(key, "__p.n_words", "__p.f.*")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """phrase_places() with found (labels of verified templates) and score: the best template's, 1 where a phrase stands."""
    rows, places = _scanned(docs, key, text, templates, phrases)
    best = places.groupBy(ROW).agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    return (
        rows.join(best, ROW, "left")
        .withColumns(
            {
                "found": F.coalesce("found", F.array().cast("array<string>")),
                "score": F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))),
            }
        )
        .drop("best", ROW)
    )
