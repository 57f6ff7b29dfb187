"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies; DataFrame only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftfold.llm.common import table, written

#: Words of a shingle, and bands of one row. With one row a band and a similarity j of the window's and the
#: template's shingles, a template is retrieved with probability 1 - (1 - j) ** BANDS.
SHINGLE, BANDS = 5, 32
CONTAINMENT = 0.8
#: Templates with more shingles in all than this are refused: they are broadcast.
MOST_SHINGLES = 100_000

#: Notices by which texts state their licence.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    # The versions of the GNU notices: so short that neither the name nor the version of another one leaves CONTAINMENT.
    "gpl-2.0-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "lgpl-2.1-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or",
    "lgpl-3.0-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    "agpl-3.0-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-1.0": (
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator "
        'and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").'
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "boost-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
        'by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions"
    ),
    "bsd-disclaimer": (
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL"
    ),
    "bsd-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    **{
        f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}"
        for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0")
    },
}
#: Notices of fewer words than a shingle: each is one shingle of all its words.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved.", **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in ("MIT", "ISC", "Unlicense", "Zlib")}}


def words_of(text: str) -> list[str]:
    """As the DataFrame side cuts words: runs of letters and digits in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(text: str, n: int) -> list[str]:
    """Of a text of fewer words than ``n``, one of all its words."""
    w = words_of(text)
    n = min(n, len(w)) or 1
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def anchors(templates: dict[str, str], n: int = SHINGLE) -> set[str]:
    """Words such that each shingle of each template holds one: a text without any of them contains no shingle."""
    return {max(s.split(" "), key=lambda w: (len(w), w)) for t in templates.values() for s in _shingles(t, n)}


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | DataFrame | None = None,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
    n: int = SHINGLE,
) -> DataFrame:
    """A row per text and template found in it: id, license_id, containment, shingles, first_word, row_no.

    A template is found where a window holds ``containment`` or more of its distinct shingles of ``n`` words (runs of
    letters and digits, in lower case). Windows are 2s shingles long, one every s shingles, s the least power of two not
    below the template's number of shingles, so each place that can hold the template lies within one window. Shingles of
    no template can't count for containment and are left out first: this only raises the similarity of a window with the
    templates it holds. ``containment`` of the result is that of the best window, ``first_word`` the place of its first
    shingle of the template; ``row_no`` tells apart rows with equal ids. Templates of fewer
    than ``n`` words are one shingle of all their words. Null and empty texts and those shorter than all templates' shingles have no rows; repeated rows are scanned each; texts are
    scanned whole, however long; other columns are not read; an empty table gives an empty result. Of windows of equal
    containment the first counts. ``templates`` are texts by name, or a table with license_id and text; rows with null in
    either are left out, and of several texts of a name the least counts.
    """
    if isinstance(templates, DataFrame):
        listed = templates.where("license_id is not null and text is not null").groupBy("license_id").agg(F.min("text").alias("text")).limit(MOST_SHINGLES + 1)
        templates = {r.license_id: r.text for r in listed.collect()}  # a template has a shingle at least, so more are refused below
    templates = {**TEMPLATES, **SHORT_TEMPLATES} if templates is None else templates
    if not templates:
        return docs.select(docs[id_col].alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("license_id", "string"), ("containment", "double"), ("shingles", "long"), ("first_word", "long"), ("row_no", "long")))).where("false")
    spark = docs.sparkSession
    listed = [(name, s, 1 << max(0, len(sh) - 1).bit_length(), len(sh)) for name, t in templates.items() for sh in [_shingles(t, n)] for s in sh]
    if short := [name for name, t in templates.items() if not _shingles(t, n)]:
        raise ValueError(f"templates without words: {short}")
    if len(listed) > MOST_SHINGLES:
        raise ValueError(f"over {MOST_SHINGLES} shingles in all templates")
    ours = spark.createDataFrame(listed, "license_id string, shingle string, span int, shingles int")
    spans = sorted({x[2] for x in listed})
    sizes = sorted({x[1].count(" ") + 1 for x in listed})
    minima = [F.min(F.xxhash64(F.lit(i), "shingle")).alias(f"m{i}") for i in range(bands)]
    banded = F.posexplode(F.array(*[f"m{i}" for i in range(bands)])).alias("band", "value")
    template_bands = ours.groupBy("license_id", "span", "shingles").agg(*minima).select("license_id", "span", "shingles", banded)

    words = F.split(F.lower(F.coalesce(docs[text_col], F.lit(""))), r"[^\p{L}\p{N}]+")
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row_no"), F.array_remove(words, "").alias("words"))
    rows = rows.where(F.arrays_overlap("words", F.array(*[F.lit(x) for x in sorted(anchors(templates, n))]))).where(F.size("words") >= sizes[0])
    placed = rows.select("id", "row_no", "words", F.explode(F.sequence(F.lit(0), F.size("words") - sizes[0])).alias("at"))
    # a place near the end has no shingle of the larger sizes
    at_place = F.array(*[F.when(F.col("at") + k <= F.size("words"), F.concat_ws(" ", F.slice("words", F.col("at") + 1, k))) for k in sizes])
    placed = placed.select("id", "row_no", F.col("at").cast("long").alias("at"), F.explode(at_place).alias("shingle"))
    held = written(placed.join(F.broadcast(ours.select("shingle").distinct()), "shingle"), "license-shingles")

    first = F.floor(F.col("at") / F.col("span"))
    windows = held.select("*", F.explode(F.array(*map(F.lit, spans))).alias("span"))
    windows = windows.select("*", F.explode(F.array(first - 1, first)).alias("window")).where("window >= 0")
    signed = windows.groupBy("id", "row_no", "span", "window").agg(*minima).select("id", "row_no", "span", "window", banded)
    found = signed.join(F.broadcast(template_bands), ["span", "band", "value"]).select("row_no", "span", "window", "license_id", "shingles").distinct()
    # The checks: which of a retrieved template's shingles the window holds.
    checked = windows.join(F.broadcast(ours.select("license_id", "shingle", "span")), ["shingle", "span"]).join(found, ["row_no", "span", "window", "license_id"])
    counts = checked.groupBy("id", "row_no", "license_id", "window", "shingles").agg(F.count_distinct("shingle").alias("held"), F.min("at").alias("at"))
    counts = counts.withColumn("containment", F.col("held") / F.col("shingles")).where(F.col("containment") >= containment)
    best = counts.groupBy("id", "row_no", "license_id", "shingles").agg(F.max(F.struct("containment", (-F.col("at")).alias("place"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "license_id", F.col("best.containment").alias("containment"), F.col("shingles").cast("long").alias("shingles"), (-F.col("best.place")).alias("first_word"), "row_no")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("row_no")


def _values(templates: dict[str, str]) -> str:
    return ", ".join("('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in templates.items())


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

#: Containment in each window, without bands: what they must not lose.
OP8_SQL = rf"""
WITH t(license_id, text) AS (VALUES {_values({**TEMPLATES, **SHORT_TEMPLATES})}),
tw AS (SELECT license_id, {_WORDS} AS w FROM t),
ti AS (SELECT license_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(len(w) - least({SHINGLE}, len(w)) + 1)) AS i FROM tw),
ts AS (SELECT DISTINCT license_id, k, array_to_string(w[i + 1 : i + k], ' ') AS shingle FROM ti),
tn AS (SELECT license_id, count(*) AS shingles, pow(2, ceil(log2(count(*))))::BIGINT AS span FROM ts GROUP BY license_id),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dk AS (SELECT doc_id, w, k FROM dw, (SELECT DISTINCT k FROM ts) WHERE len(w) >= k),
di AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS place FROM dk),
ds AS (SELECT doc_id, place, k, array_to_string(w[place + 1 : place + k], ' ') AS shingle FROM di),
h AS (SELECT doc_id, place, license_id, shingle, shingles, unnest([place // span - 1, place // span]) AS win FROM ds JOIN ts USING (k, shingle) JOIN tn USING (license_id)),
c AS (SELECT doc_id, license_id, win, shingles, count(DISTINCT shingle) / shingles::DOUBLE AS containment, min(place) AS place FROM h WHERE win >= 0 GROUP BY doc_id, license_id, win, shingles),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, place) AS r FROM c WHERE containment >= {CONTAINMENT})
SELECT doc_id, license_id, containment, shingles::BIGINT AS shingles, place::BIGINT AS first_word FROM b WHERE r = 1
"""
