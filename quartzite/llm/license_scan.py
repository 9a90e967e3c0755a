"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Dice = 2 |A n B| / (|A| + |B|) over distinct word bigrams can only reach ``threshold`` t if |A| is between |B| t / (2 - t) and
|B| (2 - t) / t, and A shares |B| t / (2 - t) bigrams at least. So every bigram of a text is hashed once and met with an inverted index of the
template bigrams, which is of fixed size because the templates are a constant of this module; a text that shares too few bigrams
with a template is done with it. What remains, few texts, is compared exactly by units: its lines, its blocks between blank lines, the whole,
and, for notices inside longer lines or wrapped over lines of other text, windows as long as the template that start at its bigrams.

Defined results: null and empty texts, and units of fewer than two words, match nothing; equal units of a text count once; rows
equal in key and text count once; null keys are carried; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import guarded, materialize

THRESHOLD = 0.8

#: Standard licence notices as their licences word them, and short statements of use.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    "BSD-3-Clause": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "All-rights-reserved": ("All rights reserved.",),
}


def template_rows() -> list[tuple[str, int, int, int, str]]:
    """(license, template number, size, length, bigram) of every template; the size counts distinct bigrams, the length all."""
    out, number = [], 0
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
            grams = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            out += [(name, number, len(grams), len(words) - 1, g) for g in grams]
            number += 1
    return out


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _grams(words: str) -> Column:
    """The hashed bigrams of a column of words, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def _with_grams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep, grams`` of texts of two words at least. A generator, unlike a projection, is not folded into the lambda, so a text is split once."""
    return df.select(*keep, F.explode(F.array(words_of(F.col(text)))).alias("w")).where(F.size("w") > 1).select(*keep, F.explode(F.array(_grams("w"))).alias("grams"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, license, unit, dice``: the units that reach the threshold with some template of a licence, and their best Dice."""
    spark = docs.sparkSession
    index = spark.createDataFrame(template_rows(), "license string, template int, size int, length int, gram string").select(
        "license", "template", "size", "length", F.xxhash64(*(F.get(F.split("gram", " "), k) for k in (0, 1))).alias("gram")
    )
    index = F.broadcast(index)  # the constant above
    least, most = F.col("size") * threshold / (2 - threshold), F.col("size") * (2 - threshold) / threshold
    source = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    source = source.select("text", F.xxhash64(F.lit(7), "text").alias("t1"), F.xxhash64(F.lit(8), "text").alias("t2"))
    met = _with_grams(source, "text", "t1", "t2").select("t1", "t2", F.explode("grams").alias("gram")).join(index, "gram")
    shared = met.groupBy("t1", "t2", "template", "size", "gram").agg(F.lit(1).alias("one")).groupBy("t1", "t2", "template", "size").agg(F.count("*").alias("n"))
    likely = materialize(shared.where(F.col("n") >= least - 1e-9).select("t1", "t2").distinct(), "likely")

    again = materialize(source.join(guarded(likely), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]), "again")
    blocks = F.split("text", "\n[ \t\r]*\n")
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.when(F.size(blocks) > 1, blocks).otherwise(F.array()), F.array("text")))
    made = _with_grams(again.select("t1", "t2", F.explode(units).alias("raw")), "raw", "t1", "t2", "raw").select("t1", "t2", F.concat(F.lit("unit "), "raw").alias("unit"), F.array_distinct("grams").alias("grams"))
    by_unit = made.select("t1", "t2", "unit", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(index, "gram").where(F.col("n").between(least, most))
    by_unit = by_unit.groupBy("t1", "t2", "unit", "n", "license", "template", "size").agg(F.count("*").alias("shared"))

    whole = materialize(_with_grams(again, "text", "t1", "t2"), "grams")
    starts = whole.select("t1", "t2", F.posexplode("grams").alias("pos", "gram")).join(index, "gram").select("t1", "t2", "license", "template", "size", "length", "pos")
    windows = starts.join(whole, ["t1", "t2"]).select("t1", "t2", "license", "template", "size", "pos", F.array_distinct(F.slice("grams", F.col("pos") + 1, F.col("length"))).alias("part"))
    windows = windows.where(F.size("part") >= least - 1e-9)
    own = index.groupBy("template").agg(F.collect_list("gram").alias("own"))
    by_window = windows.join(F.broadcast(own), "template").select(
        "t1", "t2", F.concat(F.lit("window "), F.col("pos").cast("string")).alias("unit"), F.size("part").alias("n"), "license", "template", "size", F.size(F.array_intersect("part", "own")).alias("shared")
    )
    every = by_unit.unionByName(by_window.withColumn("shared", F.col("shared").cast("long")))
    found = every.withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    found = materialize(found.groupBy("t1", "t2", "license", "unit").agg(F.max("dice").alias("dice")), "found")
    texts = materialize(found.select("t1", "t2").distinct(), "texts")
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.lit(7), F.col(text).cast("string")).alias("t1"), F.xxhash64(F.lit(8), F.col(text).cast("string")).alias("t2"))
    return keyed.join(guarded(texts), ["t1", "t2"], "left_semi").distinct().join(found, ["t1", "t2"]).select("key", "license", "unit", "dice")


def report(docs: DataFrame) -> DataFrame:
    """The result of query op7: the licences of each document, with the best Dice, and how many units and windows reach the threshold."""
    window = F.col("unit").startswith("window ")
    return scan(docs).groupBy(F.col("key").alias("doc_id"), F.col("license").alias("license")).agg(
        F.round(F.max("dice"), 6).alias("best_dice"), F.count_if(~window).alias("n_units"), F.count_if(window).alias("n_windows")
    )


def _oracle() -> str:
    values = ", ".join(f"('{name}', {number}, {size}, {length}, '{gram}')" for name, number, size, length, gram in template_rows())
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
WITH template(license, template, size, length, gram) AS (VALUES {values}),
unit AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), list_concat(
    CASE WHEN len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) > 1 THEN regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') ELSE [] END, [text])))) AS raw
  FROM documents WHERE text IS NOT NULL
), worded AS (SELECT doc_id, raw, {words.format("raw")} AS w FROM unit),
grams AS (SELECT doc_id, raw, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
by_unit AS (
  SELECT g.doc_id, g.raw AS unit, 0 AS is_window, t.license, 2.0 * count(*) / (len(any_value(g.g)) + any_value(t.size)) AS dice
  FROM (SELECT doc_id, raw, g, unnest(g) AS gram FROM grams) g JOIN template t USING (gram) GROUP BY g.doc_id, g.raw, t.license, t.template
), listed AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 1),
placed AS (SELECT doc_id, generate_subscripts(g, 1) - 1 AS pos, unnest(g) AS gram FROM listed),
likely AS (SELECT doc_id, template FROM placed JOIN template USING (gram) GROUP BY doc_id, template HAVING count(DISTINCT gram) >= any_value(size) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9),
start AS (SELECT doc_id, pos, license, template, size, length FROM placed JOIN template USING (gram) SEMI JOIN likely USING (doc_id, template)),
win AS (SELECT DISTINCT s.doc_id, s.pos, s.license, s.template, s.size, p.gram FROM start s JOIN placed p ON p.doc_id = s.doc_id AND p.pos >= s.pos AND p.pos < s.pos + s.length),
by_window AS (
  SELECT w.doc_id, CAST(w.pos AS VARCHAR) AS unit, 1 AS is_window, w.license, 2.0 * count(t.gram) / (count(*) + any_value(w.size)) AS dice
  FROM win w LEFT JOIN template t ON t.template = w.template AND t.gram = w.gram GROUP BY w.doc_id, w.pos, w.license, w.template
), best AS (SELECT doc_id, unit, is_window, license, max(dice) AS dice FROM (SELECT * FROM by_unit UNION ALL SELECT * FROM by_window) WHERE dice >= {THRESHOLD} GROUP BY ALL)
SELECT doc_id, license, round(max(dice), 6) AS best_dice, count(*) FILTER (is_window = 0) AS n_units, count(*) FILTER (is_window = 1) AS n_windows FROM best GROUP BY doc_id, license
"""


ORACLE_SQL = _oracle()
