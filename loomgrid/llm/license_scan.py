"""License scans by a positional rare-token index, in DataFrame functions only.

Each text becomes the sequence of its words. The words of the licence templates are counted over all
documents. A file is a candidate for a template if it holds every word of the template's mandatory key
phrases; then the template's words of highest inverse document frequency that the file holds, and those
of the key phrases, are looked up in the template's postings, and postings vote for (template, file
position less template position). A template holds where at least ``min_votes`` places (all of its key
phrases, if those have fewer words) agree on the relative position and all places of its key phrases
are among them. So no template takes look-ups from another, and words that stand elsewhere in the file
take no label away. Long licences are several templates, one a passage, so that a holder's name or a
changed paragraph moves only what is in the same passage.

Base phrases are found everywhere as consecutive words; their words are looked for first.

Texts are read twice, once for the counts and once for the look-ups, and not stored. What reaches the
driver is one number a template word; what is broadcast are the templates.

Null and empty texts have no words, no labels and score 0. Very long texts are whole rows like others.
Ties of words with equal counts go to the first by name; of places, all count. Repeated rows, null or
repeated doc_ids are rows of their own, told apart by a number stored with them. An empty table gives no
rows. Extra columns stay; those named like a made one are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize

#: Phrases that give a label wherever their words stand consecutively.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label, passage of a licence or its notice, key phrases that must stand at their place.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["unless required by applicable law or agreed to in writing", "governing permissions and limitations under the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain the above copyright notice"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", ["to use reproduce display distribute execute and transmit the software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["distributed in the hope that it will be useful", "gnu general public license for more details"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["shall be included in all copies or substantial portions of the software"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["including commercial applications and to alter it and redistribute it freely"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["the origin of this software must not be misrepresented"]),
]

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def key_places(text: str, keys: list[str]) -> list[int]:
    """Places in a template of the words of its key phrases."""
    whole, out = f" {text} ", set()
    for k in keys:
        first = whole[: whole.index(f" {k} ")].count(" ")
        out.update(range(first, first + len(k.split(" "))))
    return sorted(out)


def _starts(words: Column, phrase: str) -> Column:
    """Every place, from 0, where the phrase's words stand consecutively."""
    first, *rest = phrase.split(" ")
    places = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())

    def follows(i: Column) -> Column:
        held = F.lit(True)
        for k, word in enumerate(rest, 1):
            held &= F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return held

    return F.filter(places, follows)


def _holds(known: str, words: list[str]) -> Column:
    return reduce(and_, (F.array_contains(known, w) for w in sorted(set(words))))


def scan(docs: DataFrame, text: str = "text", rare_words: int = 8, min_votes: int = 3, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """Columns of ``docs`` but ``text``, and n_words, n_base, first_word, last_word, base_labels, labels, score,
    matches (label, first word, share of the looked-up places that agree)."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    keep = [c for c in docs.columns if c != text and c not in made]
    spark = docs.sparkSession
    split = [(label, body.split(" "), keys) for label, body, keys in templates]
    vocabulary = sorted({w for _, body, _ in split for w in body} | {w for p, _ in BASE_PHRASES for w in p.split(" ")})
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), _GAP, " "))
    words = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(F.translate(spaced, _UPPER, _LOWER), " "))
    known = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))

    # how many files hold each word of the templates: at most a row for each
    holding = docs.select(words.alias("words")).select(F.explode(known).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    by_idf = [w for _, w in sorted((r["n"], r["w"]) for r in holding)]

    def looked_up(t: int) -> Column:
        """The template and its look-up words in a file; null if the file lacks a word of its key phrases."""
        _, own, keys = split[t]
        in_keys = sorted({w for k in keys for w in k.split(" ")})
        rare = F.slice(F.filter(F.array(*(F.lit(w) for w in by_idf if w in own)).cast("array<string>"), lambda w: F.array_contains("known", w)), 1, rare_words)
        return F.when(_holds("known", in_keys), F.struct(F.lit(t).alias("template"), F.array_union(rare, F.array(*map(F.lit, in_keys))).alias("rare")))

    read = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), words.alias("words")).select("row", "words", known.alias("known"))
    candidates = F.array_compact(F.array(*map(looked_up, range(len(split)))))
    none = F.array().cast("array<int>")
    starts = [F.when(_holds("known", p.split(" ")), _starts(F.col("words"), p)).otherwise(none) for p, _ in BASE_PHRASES]
    placed = read.select("row", "words", "known", candidates.alias("candidates"), *(s.alias(f"p{k}") for k, s in enumerate(starts)))
    wanted = F.flatten(F.transform("candidates", lambda u: u["rare"]))
    at = F.when(F.size("candidates") > 0, F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("wanted", x["w"])))
    placed = placed.withColumn("wanted", F.array_distinct(wanted)).select("row", F.size("words").cast("long").alias("n_words"), "candidates", at.alias("at"), *(f"p{k}" for k in range(len(starts))))
    files = materialize(placed.withColumn("rid", F.monotonically_increasing_id()), "licence-words")

    postings = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, {_quoted(w)}, {k})" for t, (_, own, _) in enumerate(split) for k, w in enumerate(own)) + " AS p(template, w, place)")
    rare = files.where(F.size("candidates") > 0).select("rid", "at", F.explode("candidates").alias("u")).select("rid", "u.template", "u.rare", "at")
    rare = rare.select("rid", "template", "rare", F.explode(F.filter("at", lambda x: F.array_contains("rare", x["w"]))).alias("x"))
    votes = rare.withColumn("w", F.col("x")["w"]).join(F.broadcast(postings), ["template", "w"]).groupBy("rid", "template", (F.col("x")["i"] - F.col("place")).alias("offset"))
    votes = votes.agg(F.collect_set("place").alias("places"), F.first("rare").alias("rare"))
    rows = (f"({t}, {_quoted(label)}, split({_quoted(' '.join(own))}, ' '), array({', '.join(map(str, key_places(' '.join(own), keys)))}))" for t, (label, own, keys) in enumerate(split))
    sizes = spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS s(template, label, template_words, key_places)")
    expected = F.size(F.filter("template_words", lambda w: F.array_contains("rare", w)))
    verified = (F.size("places") >= F.least(F.lit(min_votes), F.size("key_places"))) & (F.size(F.array_except("key_places", "places")) == 0)
    aligned = votes.join(F.broadcast(sizes), "template").where(verified).select("rid", "label", F.greatest("offset", F.lit(0)).cast("long").alias("first_word"), (F.size("places") / expected).alias("share"))
    matches = aligned.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("label", "first_word", "share"))).alias("matches"))

    all_starts = F.concat(*(F.col(f"p{k}") for k in range(len(starts))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, label) for k, (_, label) in enumerate(BASE_PHRASES))))
    out = files.select("row", "rid", "n_words", all_starts.alias("starts"), base.alias("base")).join(matches, "rid", "left")
    matched = F.coalesce("matches", F.array().cast("array<struct<label:string,first_word:bigint,share:double>>"))
    return out.select(
        *(F.col("row")[c].alias(c) for c in keep), "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform(matched, lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(matched, lambda m: m["share"])), F.lit(0.0))).alias("score"),
        matched.alias("matches"),
    )


def scan_sql(rare_words: int = 8, min_votes: int = 3) -> str:
    """The same rows in DuckDB SQL, for ``documents`` and the columns of the query."""
    bodies = ", ".join(f"({t}, {_quoted(label)}, {_quoted(body)})" for t, (label, body, _) in enumerate(TEMPLATES))
    keys = ", ".join(f"({t}, {k})" for t, (_, body, keys) in enumerate(TEMPLATES) for k in key_places(body, keys))
    phrases = " UNION ALL ".join(
        f"SELECT a.rid, a.i, {_quoted(label)} label FROM pos a " + " ".join(f"JOIN pos w{k} ON w{k}.rid = a.rid AND w{k}.i = a.i + {k} AND w{k}.w = {_quoted(w)}" for k, w in enumerate(p.split(" ")) if k) + f" WHERE a.w = {_quoted(p.split(' ')[0])}"
        for p, label in BASE_PHRASES
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') words FROM documents),
    pos AS (SELECT rid, unnest(words) w, generate_subscripts(words, 1) - 1 i FROM docs),
    bodies(t, label, body) AS (VALUES {bodies}),
    post AS (SELECT t, unnest(string_split(body, ' ')) w, generate_subscripts(string_split(body, ' '), 1) - 1 place FROM bodies),
    keyed(t, place) AS (VALUES {keys}),
    key_words AS (SELECT DISTINCT t, w FROM keyed JOIN post USING (t, place)),
    held AS (SELECT DISTINCT rid, w FROM pos WHERE w IN (SELECT w FROM post)),
    df AS (SELECT w, count(*) n FROM held GROUP BY w),
    cand AS (SELECT rid, t FROM held JOIN key_words k USING (w) GROUP BY rid, t HAVING count(*) = (SELECT count(*) FROM key_words x WHERE x.t = k.t)),
    own AS (SELECT DISTINCT t, w FROM post),
    ranked AS (SELECT c.rid, c.t, o.w, row_number() OVER (PARTITION BY c.rid, c.t ORDER BY df.n, o.w) rk FROM cand c JOIN own o USING (t) JOIN held h ON h.rid = c.rid AND h.w = o.w JOIN df ON df.w = o.w),
    rare AS (SELECT rid, t, w FROM ranked WHERE rk <= {rare_words} OR (t, w) IN (SELECT t, w FROM key_words)),
    votes AS (SELECT r.rid, r.t, pos.i - post.place o, count(DISTINCT post.place) votes, count(DISTINCT k.place) keys
        FROM rare r JOIN pos ON pos.rid = r.rid AND pos.w = r.w JOIN post ON post.t = r.t AND post.w = r.w LEFT JOIN keyed k ON k.t = post.t AND k.place = post.place GROUP BY 1, 2, 3),
    expected AS (SELECT rid, t, count(*) n FROM rare JOIN post USING (t, w) GROUP BY rid, t),
    need AS (SELECT t, count(*) n FROM keyed GROUP BY t),
    matches AS (SELECT v.rid, b.label, v.votes / e.n share FROM votes v JOIN need ON need.t = v.t AND v.keys = need.n AND v.votes >= least({min_votes}, need.n) JOIN expected e ON e.rid = v.rid AND e.t = v.t JOIN bodies b ON b.t = v.t),
    base AS ({phrases}),
    by_base AS (SELECT rid, count(*) n_base, min(i) first_word, max(i) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM base GROUP BY rid),
    by_all AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM matches) GROUP BY rid),
    best AS (SELECT rid, max(share) share FROM matches GROUP BY rid)
    SELECT d.doc_id, cast(len(d.words) AS bigint) n_words, coalesce(b.n_base, 0) n_base, cast(b.first_word AS bigint) first_word, cast(b.last_word AS bigint) last_word,
        coalesce(b.base_labels, '') base_labels, coalesce(a.labels, '') labels, cast(CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(s.share, 0.0) END AS double) score
    FROM docs d LEFT JOIN by_base b USING (rid) LEFT JOIN by_all a USING (rid) LEFT JOIN best s USING (rid)"""
