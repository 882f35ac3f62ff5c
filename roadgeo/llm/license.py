"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, as_text

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and words of the templates whose pairs of words blocks are joined with, lines by which texts name a license first,
#: then the texts and notices of the licenses themselves.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
)
#: Share of a template's pairs of words that a block must hold, least words from one block's start to the next's. Blocks are twice
#: as long as a step, so any step of words in a row lies in one; a template's step is at least its own length.
CONTAINED, STEP = 0.9, 32
#: Between words stands anything but digits, letters a-z and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Array of a text's words. lower() equals lowering A-Z alone here, once the Kelvin sign, the one other character that it turns into an ASCII letter of its own, is put aside."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd"))), BETWEEN, -1), "")


def pairs_of(words):
    """Every two words in a row, as one token each."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def tokens_of(template: str) -> list[str]:
    """The template's distinct pairs of words in a row, sorted."""
    w = template.split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def step_of(template: str) -> int:
    """Words from one block's start to the next's, for the blocks that this template is held against: STEP, doubled until the template is no longer."""
    step, n = STEP, len(template.split())
    while step < n:
        step *= 2
    return step


def token_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' tokens, rarest first by the number of documents of the whole table that hold them, ties by token.

    What is counted, shuffled and collected is bounded by the templates' vocabulary.
    """
    vocabulary = sorted({w for _, t in templates for w in tokens_of(t)})
    words = docs.select(words_of(as_text(docs)).alias("w"))
    held = words.select(F.explode(F.array_intersect(pairs_of(F.col("w")), F.array(*map(F.lit, vocabulary)))).alias("token"))
    counts = {r.token: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    Tokens are pairs of words in a row, so words of a template that are scattered over a block don't count. A block joins a
    template if it holds `contained` of its tokens or more (each template is held against blocks of twice its length or
    more). Templates' tokens are ordered by frequency, rarest first: a match must share one of a template's first tokens
    (prefix filter), have enough tokens of the vocabulary (length filter), and enough left on either side of the shared one
    (positional filter); what is left is counted in full. The templates' index is broadcast: its size is fixed. score is the largest share held of a template
    joined, 1 if a phrase stands in the text, else 0. Null and empty texts have no words, null first_word and last_word
    and empty labels; repeated rows keep a row each.
    """
    order = token_order(docs, templates)
    rank = {w: k for k, w in enumerate(order)}
    sets = [(label, step_of(t), sorted(rank[w] for w in tokens_of(t))) for label, t in templates]
    index = [(label, step, ids, need, k, ids[k]) for label, step, ids in sets for need in [ceil(contained * len(ids) - 1e-9)] for k in range(len(ids) - need + 1)]
    firsts = sorted({order[i] for *_, i in index})
    rows = ", ".join(f"('{label}', {step}, array({', '.join(map(str, ids))}), {need}, {k}, {i})" for label, step, ids, need, k, i in index)
    prefixes = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(label, step, template, need, k, token)")
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])

    base = docs.select(F.monotonically_increasing_id().alias("row"), as_long(docs, "doc_id").alias("doc_id"), words_of(as_text(docs)).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    base = base.withColumn("phrased", F.arrays_overlap("w", F.array(*[F.lit(p.split()[0]) for p, _ in PHRASES]))).withColumn("near", F.arrays_overlap(pairs_of(F.col("w")), F.array(*map(F.lit, firsts))))
    for k, (phrase, _) in enumerate(PHRASES):
        stands = " and ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(phrase.split()))
        base = base.withColumn(f"p{k}", F.expr(f"case when phrased then filter(sequence(0, size(w) - 1), i -> {stands}) else array() end"))
    cut = [f"transform(sequence(0, cast((n_words - 1) div {x} as int)), b -> struct({x} as step, slice(w, {x} * b + 1, {2 * x}) as words))" for x in sorted({step for _, step, _ in sets})]
    blocks = F.expr(f"case when near then concat({', '.join(cut)}) end")
    places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    found = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    per_doc = base.select("row", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), found.alias("base"), F.explode_outer(blocks).alias("block"))

    vocabulary = F.array(*map(F.lit, order))
    held = F.array_sort(F.transform(F.array_intersect(pairs_of(F.col("block.words")), vocabulary), lambda x: F.element_at(ranks, x)))
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    tokens = per_doc.select(*own, F.col("block.step").alias("step"), held.alias("held")).select(*own, "step", "held", F.posexplode_outer("held").alias("at", "token"))
    left_t, left_b = F.size("template") - F.col("k") - 1, F.size("held") - F.col("at") - 1
    passes = (F.size("held") >= F.col("need")) & (F.least("k", "at") + 1 + F.least(left_t, left_b) >= F.col("need"))
    joined = tokens.join(F.broadcast(prefixes), (tokens["token"] == prefixes["token"]) & (tokens["step"] == prefixes["step"]) & passes, "left")
    share = F.size(F.array_intersect("held", "template")) / F.size("template")
    hit = F.col("label").isNotNull() & (F.size(F.array_intersect("held", "template")) >= F.col("need"))
    out = joined.groupBy(*own).agg(F.collect_set(F.when(hit, F.col("label"))).alias("more"), F.max(F.when(hit, share)).alias("share"))
    joined_labels = F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), joined_labels.alias("labels"), score.alias("score"))


def oracle_sql(templates=TEMPLATES, contained: float = CONTAINED) -> str:
    """DuckDB SQL for scan(): every block is held against every template."""
    rows = ", ".join(f"('{label}', {step_of(t)}, {tokens_of(t)!r})" for label, t in templates)
    steps = ", ".join(f"({x})" for x in sorted({step_of(t) for _, t in templates}))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    stands = [" AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())) for p, _ in PHRASES]
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {s}) AS p{k}" for k, s in enumerate(stands))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT r, doc_id, w, {places} FROM d),
        b AS (SELECT r, doc_id, len(w) AS n_words, {every} AS every, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM p),
        t(label, step, words) AS (VALUES {rows}),
        c AS (SELECT r, step, w[step * b + 1 : step * b + 2 * step] AS x FROM (SELECT r, w, step, unnest(range(0, (len(w) + step - 1) // step)) AS b FROM d, (VALUES {steps}) v(step))),
        k AS (SELECT r, step, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS block FROM c),
        s AS (SELECT r, label, len(list_intersect(block, words)) AS n, len(words) AS m FROM k JOIN t USING (step)),
        h AS (SELECT r, list(DISTINCT label) AS more, max(n / m) AS share FROM s WHERE n >= ceil({contained} * m - 1e-9) GROUP BY r)
        SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, (list_min(every) - 1)::BIGINT AS first_word, (list_max(every) - 1)::BIGINT AS last_word,
               array_to_string(list_sort(base), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
               greatest(coalesce(share, 0.0), CASE WHEN len(every) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
        FROM b LEFT JOIN h USING (r)"""
