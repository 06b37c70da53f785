"""License scans by diagonal voting.

The hash of every rolling window of K words is joined to the places where templates have the same window. A match at
document word p and template word q votes for the diagonal p - q; votes on neighbouring diagonals (words added or left
out) are merged where they follow one another, and a merged span is verified: its windows' words are equal one by one,
and it holds enough of the template. Base phrases are templates that have to be there word for word.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, Words, buffers, pick, rolling, steps, table, written

K = 3
#: Share of a template's words that a span has to hold.
COVER = 0.8
#: Diagonals that differ by so many words are neighbours.
DRIFT = 3
#: (label, phrase): found only as a whole.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# License texts and notices, word for word as their authors publish them; only words count.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR
OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
APACHE_2_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details."""
#: (label, text): notices by which works state their license, and whole texts.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mit", MIT), ("bsd-3", BSD_3), ("isc", ISC), ("zlib", ZLIB), ("unlicense", UNLICENSE), ("bsl-1", BOOST), ("apache-2", APACHE_2_NOTICE), ("gpl-3", GPL_NOTICE.format(3)), ("gpl-2", GPL_NOTICE.format(2)),
]


def template_windows(phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, size, place, window, hash) for each window of each template; of one shorter than K, none."""
    out = []
    for t, (label, text, base) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in templates)]):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        raw, at = buffers(pa.array([" ".join(words)]))
        hashes = rolling(Words(raw, at, ALNUM).hash, K).astype(np.int64).tolist()
        out += [(t, label, base, len(words), i, " ".join(words[i : i + K]), h) for i, h in enumerate(hashes)]
    return out


def _windows(df: DataFrame, known: np.ndarray, row_cols: str) -> DataFrame:
    """For each row: its number of words, and place, hash and words of each window that some template has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.int64()), ("window", pa.string())]))
        for b in batches:
            raw, at = buffers(b.column(b.num_columns - 1))
            counts, found = [], []
            for lo, hi in steps(at):
                w = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
                h = rolling(w.hash, K).astype(np.int64)
                hit = np.flatnonzero(np.isin(h, known) & (w.doc[: len(h)] == w.doc[len(w.doc) - len(h) :])) if len(h) else np.zeros(0, np.int64)
                by = [[] for _ in range(lo, hi)]
                for i in hit.tolist():
                    by[w.doc[i]].append({"place": i - int(w.first[w.doc[i]]), "hash": int(h[i]), "window": b" ".join(w.text(j) for j in range(i, i + K)).decode("utf-8", "replace")})
                counts += w.count.tolist()
                found += by
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, kinds)], [*b.schema.names[:-1], "n_words", "windows"])

    return df.mapInArrow(run, f"{row_cols}, n_words long, windows array<struct<place:long,hash:long,window:string>>")


def _outdone(first: np.ndarray, last: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Which of one text's spans overlap one with a higher cover. One sweep over their starts: n log n for n spans.

    A span overlaps those that begin in it, whose best is a maximum over a range of starts, and those begun before that
    haven't ended, of which the best that is still open is on top of a heap.
    """
    by = np.argsort(first, kind="stable")
    f, l, c = first[by], last[by], cover[by]
    maxima = [c]  # maxima[k][i]: of the 2^k covers from i
    while 2 << (len(maxima) - 1) <= len(c):
        half = 1 << (len(maxima) - 1)
        maxima.append(np.maximum(maxima[-1][:-half], maxima[-1][half:]))
    start, end = np.searchsorted(f, f, "left"), np.searchsorted(f, l, "right")
    k = np.frexp((end - start).astype(np.float64))[1] - 1
    best = np.empty(len(c))
    for level, m in enumerate(maxima):
        at = np.flatnonzero(k == level)
        best[at] = np.maximum(m[start[at]], m[end[at] - (1 << level)])
    still: list[tuple[float, int]] = []
    for i in range(len(c)):
        while still and still[0][1] < f[i]:
            heapq.heappop(still)
        if still:
            best[i] = max(best[i], -still[0][0])
        heapq.heappush(still, (-c[i], l[i]))
    out = np.empty(len(c), bool)
    out[by] = best > c
    return out


def best_covered(by_row: DataFrame) -> DataFrame:
    """Notices share wording: where spans of templates overlap, the best covered ones stay. Spans of base phrases all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans")
            at, spans = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            base, first, last, cover = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("base", "first", "last", "cover"))
            stays = np.ones(len(spans), bool)
            for i in np.flatnonzero(np.diff(at) > 1).tolist():
                mine = at[i] + np.flatnonzero(~base[at[i] : at[i + 1]])
                stays[mine] = ~_outdone(first[mine], last[mine], cover[mine])
            ends = np.concatenate([[0], np.cumsum(stays)])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(pa.array(ends), spans.filter(pa.array(stays)))], ["row", "spans"])

    return by_row.mapInArrow(run, by_row.schema)


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list | None = None, templates: list | None = None) -> DataFrame:
    """id, n_words and spans (label, base, first, last, cover of each verified span) for each row of df.

    Null or empty text: no words, no spans. Null and repeated ids are scanned row by row. An empty table gives an empty
    one. Other columns are ignored. Templates are a list that the driver holds, so their windows are sent to all tasks.
    """
    spark = df.sparkSession
    rows = template_windows(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    places = spark.createDataFrame(rows, "template int, label string, base boolean, size int, at int, twin string, hash long")
    texts = pick(df, id_col, text_col)
    kind = texts.schema[0].dataType.simpleString()
    marked = texts.withColumn("row", F.monotonically_increasing_id()).select("row", id_col, text_col)
    found = written(_windows(marked, np.array(sorted({r[6] for r in rows}), np.int64), f"row long, {id_col} {kind}"), "windows")
    hits = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.place", "w.hash", "w.window")
    votes = hits.join(F.broadcast(places), "hash").where("window = twin").withColumn("diagonal", F.col("place") - F.col("at"))
    # A diagonal says where in the document the whole template would stand, so its votes are those of one place.
    diagonals = votes.groupBy("row", "template", "label", "base", "size", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("place").alias("first"), F.max("place").alias("last"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    begins = (step.isNull() | F.col("base") | (step > DRIFT)).cast("int")
    merged = diagonals.withColumn("begins", begins).withColumn("span", F.sum("begins").over(by)).groupBy("row", "template", "label", "base", "size", "span").agg(
        F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.count(F.lit(1)).alias("n")
    )
    held = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.array(*[a + j for j in range(K)]))))
    fits = F.col("last") - F.col("first") < F.col("size") + DRIFT * F.col("n")
    verified = merged.withColumn("cover", F.size(held) / F.col("size")).where(F.when(F.col("base"), F.size("ats") == F.col("size") - (K - 1)).otherwise((F.col("cover") >= COVER) & fits))
    by_row = best_covered(verified.groupBy("row").agg(F.collect_list(F.struct("label", "base", "first", "last", "cover")).alias("spans")))
    return found.select("row", id_col, "n_words").join(by_row, "row", "left").select(id_col, "n_words", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    first = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scanned(table(spark, sf_dir, "documents")))

