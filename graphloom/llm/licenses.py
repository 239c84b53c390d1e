"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Everything is DataFrame expressions.  A text's words (runs of a-z and 0-9 after
lower-casing) make five-word shingles; windows of 1, 4 and 12 shingles slide over
them (the longer two by ``STRIDE``), each with minwise values under XOR masks, one
to a band.  A template is cut into windows at every offset, of the widest kind that
fits into it twice, so one of its windows is aligned with a window of any text that
holds it word for word and meets it in every band, and a similar one (Jaccard s)
meets it in some band of ``BANDS`` with chance 1 - (1 - s) ** BANDS.

The bands retrieve: only templates that were met in a document are verified there,
by the exact number of their shingles that the whole text holds.  A bitmap of the
templates' keys, a constant in the plan, lets all other keys of a text go where
they arise.  The only tables that are broadcast hold the keys of the templates,
whose number is fixed by their list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written

K = 5
MASKS = (0x0F1E2D3C4B5A6978, 0x5A17C3E98D2B4F61, 0x369CF258BE147AD0)
BANDS = len(MASKS)
NARROW, WIDE, STRIDE = 4, 12, 4
MARKS = 1 << 16  # bits of a bitmap of keys

#: Wordings of license notices, and the permission texts of short licenses in full.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def _each(first: int, last: Column, step: int, value) -> Column:
    """An array of value(i) for i from first to last; empty if last is below first."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last, F.lit(step)), value)).otherwise(F.array().cast("array<bigint>"))


def _shingles(texts: DataFrame, *keep: str) -> DataFrame:
    """keep.., sh: hashes of the five-word shingles of ``text`` in order."""
    words = texts.select(*keep, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    return words.select(*keep, _each(0, F.size("words") - K, 1, lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(K)))).alias("sh"))


def _minima(mask: int, of: Column, size: int, step: int) -> Column:
    """Minwise values under a mask of windows of ``size`` elements, ``step`` apart."""
    masked = lambda i: [F.get(of, i + j).bitwiseXOR(F.lit(mask)) for j in range(size)]
    return _each(0, F.size(of) - size, step, lambda i: F.least(*masked(i)) if size > 1 else masked(i)[0])


def _wider(narrow: Column, apart: int, step: int) -> Column:
    """Minwise values of windows of WIDE shingles, from those of NARROW ones that begin ``apart`` elements from each other."""
    spans = WIDE // NARROW
    return _each(0, F.size(narrow) - (spans - 1) * apart - 1, step, lambda i: F.least(*(F.get(narrow, i + j * apart) for j in range(spans))))


def _keys(kind: int, b: int, values: Column) -> Column:
    """Keys of a band: its number takes turns with the bits of the minwise values."""
    mark = ((kind * BANDS + b + 1) * 0x61C8864680B583EB & (1 << 63) - 1)
    return F.transform(values, lambda v: v.bitwiseXOR(F.lit(mark)))


def notice_keys(spark: SparkSession, notices: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(key, license_id) of the bands, and (shingle, license_id, n) of the n distinct shingles of each template.

    A template of fewer than five words is refused.
    """
    base = spark.createDataFrame([(k, v) for k, v in sorted(notices.items())], "license_id string, text string")
    full = _shingles(base, "license_id").withColumn("n", F.size(F.array_distinct("sh")))
    if bad := [r[0] for r in full.filter("n = 0").select("license_id").collect()]:
        raise ValueError(f"notices of fewer than {K} words: {bad}")
    full = full.select("*", *(_minima(m, F.col("sh"), NARROW, 1).alias(f"m{b}") for b, m in enumerate(MASKS)))
    bands = F.when(F.size("sh") < 2 * NARROW, F.concat(*(_keys(0, b, _minima(m, F.col("sh"), 1, 1)) for b, m in enumerate(MASKS[:1]))))
    bands = bands.when(F.size("sh") < 2 * WIDE, F.concat(*(_keys(1, b, F.col(f"m{b}")) for b in range(BANDS))))
    bands = bands.otherwise(F.concat(*(_keys(2, b, _wider(F.col(f"m{b}"), NARROW, 1)) for b in range(BANDS))))
    keys = full.select(F.explode(F.array_distinct(bands)).alias("key"), "license_id")
    shingles = full.select(F.explode(F.array_distinct("sh")).alias("shingle"), "license_id", "n")
    return tuple(spark.createDataFrame(t.collect(), t.schema) for t in (keys, shingles))


def _marked(values: Column, known: list[int]) -> Column:
    """Those of an array of longs that may be among the known ones (a bitmap says no to nearly all others)."""
    words = [0] * (MARKS // 64)
    for k in known:
        slot = k & MARKS - 1
        words[slot >> 6] |= 1 << (slot & 63)
    bitmap = F.expr("array(" + ", ".join(f"cast({w - (1 << 64) if w >> 63 else w} as bigint)" for w in words) + ")")
    hit = lambda v: F.getbit(F.get(bitmap, F.shiftright(v.bitwiseAND(F.lit(MARKS - 1)), 6).cast("int")), v.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.filter(values, hit)


def license_matches(docs: DataFrame, notices: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """doc_id, license_id, n_shared, n_notice, containment: one row for each template that a document holds.

    A template is held if some band of its windows was met and at least ``percent``
    of its distinct shingles occur in the whole text.  Texts that are null or have
    fewer than five words hold none; rows without doc_id are passed over; rows
    that share a doc_id are read as one document; other columns are ignored.
    """
    spark = docs.sparkSession
    keys, shingles = notice_keys(spark, NOTICES if notices is None else notices)
    full = _shingles(docs.filter("doc_id is not null"), "doc_id")
    full = full.select("doc_id", "sh", *(_minima(m, F.col("sh"), NARROW, STRIDE).alias(f"m{b}") for b, m in enumerate(MASKS)))
    one = [_keys(0, 0, F.transform("sh", lambda v: v.bitwiseXOR(F.lit(MASKS[0]))))]
    narrow = [_keys(1, b, F.col(f"m{b}")) for b in range(BANDS)]
    wide = [_keys(2, b, _wider(F.col(f"m{b}"), NARROW // STRIDE, 1)) for b in range(BANDS)]
    met = _marked(F.concat(*one, *narrow, *wide), [r["key"] for r in keys.collect()])
    # Written, so that each text is read once for both steps.
    held = Written(spark, "licenses").table(full.select("doc_id", met.alias("met"), _marked(F.col("sh"), [r["shingle"] for r in shingles.collect()]).alias("sh")))
    candidates = held.select("doc_id", F.explode("met").alias("key")).join(F.broadcast(keys), "key").select("doc_id", "license_id").distinct()
    shared = held.select("doc_id", F.explode("sh").alias("shingle")).join(F.broadcast(shingles), "shingle").distinct()
    counts = shared.join(candidates, ["doc_id", "license_id"], "left_semi").groupBy("doc_id", "license_id", "n").agg(F.count("*").alias("shared"))
    found = counts.filter(100 * F.col("shared") >= percent * F.col("n"))
    return found.select("doc_id", "license_id", F.col("shared").cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_notice"), (F.col("shared") / F.col("n")).alias("containment"))


def oracle_sql(percent: int = 80) -> str:
    """DuckDB SQL for the rows of :func:`license_matches`: exact containment of every notice, without any index."""
    values = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(NOTICES.items()))
    shingles = lambda key, table: f"SELECT DISTINCT {key}, array_to_string(w[i:i + {K - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - {K - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}))"
    return f"""WITH notices(license_id, text) AS (VALUES {values}),
n AS ({shingles("license_id", "notices")}), d AS ({shingles("doc_id", "documents")}),
size AS (SELECT license_id, COUNT(*) AS n_notice FROM n GROUP BY license_id)
SELECT doc_id, license_id, COUNT(*) AS n_shared, n_notice, CAST(COUNT(*) AS DOUBLE) / n_notice AS containment
FROM n JOIN d USING (s) JOIN size USING (license_id) GROUP BY doc_id, license_id, n_notice HAVING 100 * COUNT(*) >= {percent} * n_notice"""
