"""Licence scans by a positional index of rare words.

A licence template is found by its anchor: of the words of its mandatory key
phrases the one that is in the fewest documents, at its first place.  As a
found template has all of these words, looking up the anchor alone misses none.
Each place of an anchor in a document fixes where the template would start
there; its postings are then intersected with the document's words at their
relative positions, the key phrases must stand whole, and at least SHARE of its
words, weighted by IDF over all documents, must stand at their places.

The base phrases are templates too: their only key phrase is all of them.

Licences are also found with words changed, left out or put in between.  A full
text is cut into segments of SEGMENT words, and its key phrases are segments
too; each has an anchor of its own, its rarest word, and must stand whole.  A
segment's shift is where the text would begin by it.  Segments whose shifts lie
in two neighbouring stretches, each as long as an eighth of the text, belong
together: if they have at least EDITED of the text's weight, and a key phrase
that no other text has is among them, the text is there.

Two narrow passes: one counts in how many documents each word of the templates
is, the other finds and verifies within each row.  Nothing but these counts is
shuffled, and the index is one constant, as long as TEMPLATES.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import LOWER, NOT_WORD, UPPER

SHARE = 0.5
#: Words of a segment, and the share of a text's weight that its segments must have.
SEGMENT, EDITED = 5, 0.4

#: Label, base, text, mandatory key phrases.
TEMPLATES = (
    ("mit", True, "mit license", ("mit license",)),
    ("apache", True, "apache license", ("apache license",)),
    ("gpl", True, "general public license", ("general public license",)),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted", "associated documentation files")),
    ("mit", False, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("without warranty", "warranties")),
    ("apache", False, "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("file except", "compliance")),
    ("gpl", False, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", False, "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", False, "gnu affero general public license", ("affero general public license",)),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("binary forms", "modification", "conditions")),
    ("mpl", False, "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute", "hereby granted")),
    ("cc", False, "licensed under a creative commons attribution license", ("creative commons attribution",)),
)

#: Licences and notices at full length: label, text, mandatory key phrases.
TEXTS = (
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("hereby granted", "deal in the software without restriction", "substantial portions")),
    ("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("binary forms", "must retain the above copyright notice")),
    ("bsd", """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", ("endorse or promote", "prior written permission")),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee", "hereby granted")),
    ("apache", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license", "in compliance with the license")),
    ("gpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see""", ("gnu general public license", "free software foundation")),
    ("lgpl", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", ("gnu lesser general public license", "free software foundation")),
    ("agpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu affero general public license", "free software foundation")),
    ("mpl", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ("mozilla public license", "source code form")),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""", ("must not be misrepresented", "plainly marked as such")),
    ("unlicense", """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered software", "public domain")),
    ("bsl", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""", ("any person or organization", "accompanying documentation")),
)


def words_of(text: str) -> list[str]:
    """A template's words, as ``words`` finds them."""
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text.lower()).split()


def _templates() -> list[tuple[str, bool, list[str], set[int]]]:
    """label, base, words, and the places of mandatory words; a phrase counts where it first stands."""
    found = []
    for label, base, text, phrases in (*TEMPLATES, *((label, False, text, phrases) for label, text, phrases in TEXTS)):
        of, key = words_of(text), set()
        for phrase in map(str.split, phrases):
            at = next(i for i in range(len(of)) if of[i : i + len(phrase)] == phrase)
            key.update(range(at, at + len(phrase)))
        found.append((label, base, of, key))
    return found


INDEX = _templates()
VOCABULARY = sorted({w for _, _, of, _ in INDEX for w in of})


#: Fixed value: the only character but A-Z whose lower case is an ASCII letter and nothing else.
KELVIN = "\u212a"


def words(text: Column) -> Column:
    """A text's words, in order, after an empty one where the text doesn't begin with a word; null has none.

    They equal a template's words where they would if only A-Z had been put in
    lower case: no other character becomes ASCII alone, but for one, which
    another takes the place of.
    """
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit("\u2126")))
    return F.split(plain, f"[{NOT_WORD}]+")


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that have each word of the templates; one row a word comes to the driver."""
    listed = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, ["", *VOCABULARY])))
    counts = docs.select(F.explode(F.array_union(listed, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    found = {r.w: r["count"] for r in counts.collect()}
    return found.pop("", 0), found


def _segments() -> list[dict]:
    """Of each full text: its segments and key phrases, with their places in it, and how far shifts may lie apart.

    Phrases that another text has too don't tell them apart, and are left out if there are others.
    """
    found, every = [], [f" {' '.join(words_of(text))} " for _, text, _ in TEXTS]
    for t, (label, text, phrases) in enumerate(TEXTS):
        of = words_of(text)
        phrases = [p for p in phrases if sum(f" {p} " in other for other in every) == 1] or phrases
        cuts = [*range(0, max(1, len(of) - SEGMENT + 1), SEGMENT), len(of)]
        parts = [(a, of[a:b], False) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for phrase in map(str.split, phrases):
            parts.append((next(i for i in range(len(of)) if of[i : i + len(phrase)] == phrase), phrase, True))
        found += [{"text": t, "label": label, "seg": k, "offset": a, "words": w, "key": key, "band": max(8, -(-len(of) // 8))} for k, (a, w, key) in enumerate(parts)]
    return found


SEGMENTS = _segments()
_SEGMENT_KIND = "array<struct<text: int, seg: int, offset: int, words: array<string>, key: boolean, band: int, anchor: string, at: int, weight: double>>"


def segments(total: int, df: dict[str, int]) -> tuple[list[dict], list[float]]:
    """The segments with their anchors and weights, and the weight of each whole text; key phrases have none."""
    entries, whole = [], [0.0] * len(TEXTS)
    for s in SEGMENTS:
        _, anchor, at = min((df.get(w, 0), w, i) for i, w in enumerate(s["words"]))
        weight = 0.0 if s["key"] else sum(idf(total, df.get(w, 0)) for w in s["words"])
        whole[s["text"]] += weight
        entries.append({k: s[k] for k in ("text", "seg", "offset", "words", "key", "band")} | {"anchor": anchor, "at": at, "weight": weight})
    return entries, whole


def idf(total: int, df: int) -> float:
    return math.log((total + 1) / (df + 1)) + 1


KIND = "array<struct<template: int, label: string, base: boolean, anchor: string, at: int, whole: double, keys: int, postings: array<struct<w: string, place: int, idf: double, key: boolean>>>>"


def index(total: int, df: dict[str, int]) -> Column:
    """The templates with their anchors and postings, as one constant."""
    entries = []
    for t, (label, base, of, key) in enumerate(INDEX):
        anchor, at = min(((of[i], i) for i in key), key=lambda x: (df.get(x[0], 0), x))
        postings = [{"w": w, "place": i, "idf": idf(total, df.get(w, 0)), "key": i in key} for i, w in enumerate(of)]
        entries.append({"template": t, "label": label, "base": base, "anchor": anchor, "at": at, "whole": sum(p["idf"] for p in postings), "keys": len(key), "postings": postings})
    return F.from_json(F.lit(json.dumps(entries)), KIND)


def scan(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` has the found templates: template, label, start (a word from 0),
    share; full texts that are found by their segments are templates of their
    own, behind the others, and one on a border of stretches is there twice.
    ``score`` is the highest share of any template at any place of its anchor,
    or of a text's segments, and 0 without any.  Null and empty texts have no words: zero
    counts, null places, empty labels, no spans.  Repeated rows each get their
    row; a null doc_id is kept; an empty table gives an empty result.
    """
    total, df = frequencies(docs)
    parts, wholes = segments(total, df)
    anchors = sorted({min((df.get(of[i], 0), of[i]) for i in key)[1] for _, _, of, key in INDEX} | {s["anchor"] for s in parts})
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("lead", F.expr("int(w[0] = '')"))
    places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(anchors), F.struct(x.alias("w"), i.alias("pos")))), lambda h: h.isNotNull())
    count = F.expr("size(w) - lead - int(size(w) > 1 AND w[size(w) - 1] = '')").cast("long")
    rows = rows.select("doc_id", "w", "lead", count.alias("n_words"), places.alias("hits"), index(total, df).alias("templates"), F.from_json(F.lit(json.dumps(parts)), _SEGMENT_KIND).alias("segments"))
    # A posting counts where the document has its word at its place; get() is null before the first word and after the last.
    there = "filter(t.postings, p -> get(w, h.pos - t.at + p.place) <=> p.w)"
    tried = f"""flatten(transform(hits, h -> transform(filter(templates, t -> t.anchor = h.w), t ->
      transform(array({there}), here -> named_struct('template', t.template, 'label', t.label, 'base', t.base, 'start', h.pos - t.at - lead,
        'share', round(aggregate(here, 0D, (s, p) -> s + p.idf) / t.whole, 6), 'keys', t.keys = size(filter(here, p -> p.key))))[0])))"""
    whole_segments = """flatten(transform(hits, h -> transform(filter(segments, s -> s.anchor = h.w AND h.pos >= s.at AND slice(w, h.pos - s.at + 1, size(s.words)) = s.words),
      s -> named_struct('text', s.text, 'bucket', cast(floor((h.pos - s.at - lead - s.offset) / s.band) as int), 'seg', s.seg, 'key', s.key, 'weight', s.weight, 'start', h.pos - s.at - lead))))"""
    rows = rows.select("doc_id", "n_words", F.expr(tried).alias("tried"), F.expr(whole_segments).alias("parts"))
    labelled = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(x).alias("whole")) for (label, _, _), x in zip(TEXTS, wholes, strict=True)))
    # Parts are asked for by their stretch and the one behind it; a segment that stands there twice counts once.
    near = "filter(parts, e -> e.text = b.text AND (e.bucket = b.bucket OR e.bucket = b.bucket + 1))"
    edited = f"""transform(array_distinct(flatten(transform(parts, e -> array(named_struct('text', e.text, 'bucket', e.bucket), named_struct('text', e.text, 'bucket', e.bucket - 1))))), b ->
      transform(array({near}), n -> named_struct('template', {len(INDEX)} + b.text, 'label', texts[b.text].label, 'start', array_min(transform(n, e -> e.start)),
        'share', round(aggregate(array_distinct(transform(n, e -> named_struct('seg', e.seg, 'weight', e.weight))), 0D, (s, e) -> s + e.weight) / texts[b.text].whole, 6), 'key', exists(n, e -> e.key)))[0])"""
    rows = rows.withColumn("texts", labelled).withColumn("edited", F.expr(edited))
    rows = rows.withColumn("found", F.expr(f"filter(tried, x -> x.keys AND x.share >= {SHARE})")).withColumn("places", F.expr("transform(filter(found, x -> x.base), x -> x.start)"))
    again = f"filter(edited, x -> x.key AND x.share >= {EDITED})"
    labels = lambda of: F.expr(f"array_join(array_sort(array_distinct(transform({of}, x -> x.label))), ',')")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        labels("filter(found, x -> x.base)").alias("base_labels"), labels(f"concat(transform(found, x -> named_struct('label', x.label)), transform({again}, x -> named_struct('label', x.label)))").alias("labels"),
        F.coalesce(F.expr("array_max(concat(transform(tried, x -> x.share), transform(edited, x -> x.share)))"), F.lit(0.0)).alias("score"),
        F.expr(f"array_sort(concat(transform(found, x -> named_struct('template', x.template, 'label', x.label, 'start', x.start, 'share', x.share)), transform({again}, x -> named_struct('template', x.template, 'label', x.label, 'start', x.start, 'share', x.share))))").alias("spans"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


_VALUES = ", ".join(f"({t}, '{label}', {base}, '{w}', {i}, {i in key})" for t, (label, base, of, key) in enumerate(INDEX) for i, w in enumerate(of))
_PARTS = ", ".join(f"({s['text']}, '{s['label']}', {s['seg']}, {s['offset']}, {s['key']}, {s['band']}, {len(s['words'])}, {i}, '{w}')" for s in SEGMENTS for i, w in enumerate(s["words"]))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NOT_WORD}]+') AS words FROM documents),
postings(template, label, base, w, place, key) AS (VALUES {_VALUES}),
parts(text, label, seg, off, key, band, size, place, w) AS (VALUES {_PARTS}),
everywhere AS (SELECT rid, i - 1 AS pos, words[i] AS w FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
hits AS MATERIALIZED (SELECT rid, pos, w FROM everywhere WHERE w IN (SELECT w FROM postings)),
df AS (SELECT w, count(DISTINCT rid) AS df FROM hits GROUP BY w),
vocabulary AS (SELECT w, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1 AS idf FROM (SELECT DISTINCT w FROM postings) LEFT JOIN df USING (w)),
weighed AS (SELECT * FROM postings JOIN vocabulary USING (w)),
sums AS (SELECT template, label, base, sum(idf) AS whole, sum(key::INT) AS keys, arg_min(struct_pack(w, place), (df, w, place)) FILTER (key) AS anchor FROM weighed GROUP BY template, label, base),
tried AS (SELECT rid, template, label, base, whole, keys, pos - anchor.place AS start FROM hits JOIN sums ON hits.w = anchor.w),
starts AS (
  SELECT t.rid, t.template, any_value(t.label) AS label, any_value(t.base) AS base, t.start, round(sum(p.idf) / any_value(whole), 6) AS share, sum(p.key::INT) = any_value(keys) AS complete
  FROM tried t JOIN weighed p ON p.template = t.template JOIN hits h ON h.rid = t.rid AND h.pos = t.start + p.place AND h.w = p.w
  GROUP BY t.rid, t.template, t.start),
e AS (
  SELECT rid, count(*) FILTER (complete AND share >= {SHARE} AND base) AS n_base,
         min(start) FILTER (complete AND share >= {SHARE} AND base) AS first_word, max(start) FILTER (complete AND share >= {SHARE} AND base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (complete AND share >= {SHARE} AND base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (complete AND share >= {SHARE}) AS labels, max(share) AS score
  FROM starts GROUP BY rid),
segs AS (SELECT h.rid, p.text, p.seg, any_value(p.key) AS key, floor((h.pos - p.place - any_value(p.off)) / any_value(p.band)) AS bucket, sum(idf) AS weight
  FROM hits h JOIN parts p ON p.w = h.w JOIN vocabulary v ON v.w = h.w GROUP BY h.rid, p.text, p.seg, h.pos - p.place HAVING count(*) = any_value(p.size)),
wholes AS (SELECT text, any_value(label) AS label, sum(idf) AS whole FROM parts JOIN vocabulary USING (w) WHERE NOT key GROUP BY text),
stretches AS (SELECT DISTINCT rid, text, seg, key, bucket, CASE WHEN key THEN 0 ELSE weight END AS weight FROM (SELECT rid, text, seg, key, weight, bucket FROM segs UNION ALL SELECT rid, text, seg, key, weight, bucket - 1 FROM segs)),
edited AS (SELECT rid, text, bucket, any_value(label) AS label, round(sum(weight) / any_value(whole), 6) AS share, bool_or(key) AS key FROM (SELECT DISTINCT ON (rid, text, bucket, seg) * FROM stretches) JOIN wholes USING (text) GROUP BY rid, text, bucket),
x AS (SELECT rid, list(DISTINCT label) FILTER (key AND share >= {EDITED}) AS labels, max(share) AS share FROM edited GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(CASE WHEN e.labels IS NULL THEN [] ELSE string_split(e.labels, ',') END, coalesce(x.labels, [])))), ',') AS labels,
       greatest(coalesce(score, 0), coalesce(x.share, 0))::DOUBLE AS score
FROM d LEFT JOIN e USING (rid) LEFT JOIN x USING (rid)
"""
