"""Licence scan by a positional index of rare template words.

Native: DataFrame and SQL functions only.

TEMPLATES are notices, or parts of them, with mandatory key phrases. Steps:

1. In how many texts each template word stands is counted over all texts, which gives
   its IDF (a row for each template word, so the counts are small whatever the input).
2. A template's postings are its rare words (in at most a tenth of the texts) and in any
   case its four rarest. Its rarest ones that together hold over half of their IDF are
   its heads: a text that reaches half of the IDF has one of them.
3. One pass over the texts takes the places of indexed words, of key phrases and of base
   phrases. A text's words of highest IDF are looked up first: only templates of which a
   head stands there are intersected with the text's places. A match votes for the offset
   of text place minus template place; offsets are pooled in overlapping bins of 16 words,
   so an inserted word doesn't lose a notice.
4. Where the votes reach half of a template's IDF, a key phrase of it must stand among
   the words at that offset. A notice that goes on where another ends (LONGER) takes its
   place. No text is read again for that.

The base labels are the phrases in BASE, wherever their words stand consecutively.

score: 1 where a base phrase stands, else the best share of IDF of a verified template,
else 0. Nulls: a null text is empty; null ids are carried. Rows with equal doc_id and
text get the same result, each its own row. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.common import alnum_words, discard, documents, join_small, staged

#: Fixed by the contract: phrase and label.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: label, notice, key phrases of which one must stand.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["licenses license 2 0"]),
    ("gpl-3.0", "released under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "released under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0", "mozilla public license version 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0", "cc by nc 3 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0", "cc by sa 3 0"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["either version 3 of the license"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["either version 2 of the license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0", "eclipse public license 2 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
]

#: A notice that begins like another and goes on: its label, and the label of the other, not given at the same place.
LONGER = {"bsd-3-clause": "bsd-2-clause"}

RARE = 10
SURE = 4
BIN = 8

_KEY = ["doc_id", "_th"]


def template_index(docs: DataFrame) -> tuple[list[tuple[int, str, int, float]], list[float], dict[str, list[int]]]:
    """Postings (template, word, place, idf), each template's whole IDF, and the templates of which a word is a head."""
    lexicon = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    listed = "array(" + ", ".join(f"'{w}'" for w in lexicon) + ")"
    seen = docs.select(F.explode_outer(F.expr(f"array_append(array_intersect({alnum_words('text')}, {listed}), '')")).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most a row for each word of the templates
    n = df.pop("", 0)
    idf = {w: log(1 + (n + 1) / (df.get(w, 0) + 0.5)) for w in lexicon}
    postings, whole, heads = [], [], {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        by_rarity = sorted(set(notice.split()), key=lambda w: (df.get(w, 0), w))
        kept = [w for i, w in enumerate(by_rarity) if i < SURE or RARE * df.get(w, 0) <= n]
        own = [(t, w, i, idf[w]) for i, w in enumerate(notice.split()) if w in set(kept)]
        postings += own
        whole.append(sum(x[3] for x in own))
        mass = 0.0
        for w in kept:
            heads.setdefault(w, []).append(t)
            mass += sum(x[3] for x in own if x[1] == w)
            if 2 * mass > whole[-1] + 1e-9:
                break
    return postings, whole, heads


def _anchored(phrases: list[tuple[str, str]], rarity: dict[str, float]) -> list[tuple[str, str, str]]:
    """Of each phrase its rarest word, a test (SQL) of the words around place i of w, and what it gives: the place of its first word and a name."""
    out = []
    for phrase, name in phrases:
        words = phrase.split()
        at = max(range(len(words)), key=lambda k: rarity.get(words[k], 0.0))
        around = " AND ".join(f"get(w, i + {k - at}) = '{x}'" for k, x in enumerate(words) if k != at)
        out.append((words[at], around or "true", f"struct(cast(i - {at} AS long) AS p, {name} AS l)"))
    return out


def _found(rules: list[tuple[str, str, str]], kind: str) -> str:
    """SQL: the array of what the rules give at the places in ps."""
    each = [f"transform(filter(ps, i -> w[i] = '{word}' AND {around}), i -> {gives})" for word, around, gives in rules]
    return f"concat({', '.join(each)})" if each else f"cast(array() AS array<struct<p:long,l:{kind}>>)"


def scan(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, str, int, float]], list[float]]:
    """doc_id, _th, n_words, base, keys, hits and tried (templates to look at) of each text, staged; the postings and each template's IDF."""
    postings, whole, heads = template_index(docs)
    idf = {w: x for _, w, _, x in postings}
    keys = [(k, str(t)) for t, (_, _, own) in enumerate(TEMPLATES) for k in own]
    base, keyed = _anchored([(p, f"'{x}'") for p, x in BASE], idf), _anchored(keys, idf)
    wanted = sorted({p[1] for p in postings} | {x[0] for x in (*base, *keyed)})
    listed, indexed = ("array(" + ", ".join(f"'{w}'" for w in x) + ")" for x in (wanted, sorted(idf)))
    lookup = "map(" + ", ".join(f"'{w}', array({', '.join(map(str, ts))})" for w, ts in heads.items()) + ")"
    head = "array(" + ", ".join(f"'{w}'" for w in heads) + ")"
    # Only a text that holds a wanted word is looked through, and its places only once.
    ps = f"CASE WHEN arrays_overlap(w, {listed}) THEN filter(sequence(0, size(w) - 1), i -> array_contains({listed}, w[i])) ELSE cast(array() AS array<int>) END"
    hits = f"transform(filter(ps, i -> array_contains({indexed}, w[i])), i -> struct(i AS p, w[i] AS w))"
    tried = f"array_distinct(flatten(transform(filter(ps, i -> array_contains({head}, w[i])), i -> element_at({lookup}, w[i]))))"
    row = f"struct(size(w) AS n, {_found(base, 'string')} AS base, {_found(keyed, 'int')} AS keys, {tried} AS tried, {hits} AS hits)"
    found = f"transform(array({alnum_words('text')}), w -> transform(array({ps}), ps -> {row})[0])[0]"
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.expr(found).alias("_f"))
    return staged(rows.select(*_KEY, F.col("_f.n").cast("long").alias("n_words"), "_f.base", "_f.keys", "_f.tried", "_f.hits"), "licence-places"), postings, whole


def verified(rows: DataFrame, postings: list[tuple[int, str, int, float]], whole: list[float]) -> DataFrame:
    """doc_id, _th, more (labels) and share of the texts in which a template is verified, staged."""
    table = rows.sparkSession.createDataFrame(postings, "t int, w string, i int, idf double")
    asked = rows.filter("size(tried) > 0")
    spread = asked.select(*_KEY, "tried", F.explode("hits").alias("x")).select(*_KEY, "tried", "x.p", "x.w")
    # TEMPLATES bounds the postings: a few hundred rows.
    votes = spread.join(F.broadcast(table), "w").filter("array_contains(tried, t)")
    votes = votes.select(*_KEY, "t", "i", "idf", F.explode(F.expr(f"array((p - i) div {BIN}, (p - i) div {BIN} - 1)")).alias("bin")).groupBy(*_KEY, "t", "bin", "i").agg(F.max("idf").alias("idf"))
    least = F.element_at(F.array(*(F.lit(x) for x in whole)), F.col("t") + 1)
    best = votes.groupBy(*_KEY, "t", "bin").agg(F.sum("idf").alias("s")).withColumn("share", F.least(F.col("s") / least, F.lit(1.0))).filter("share >= 0.5")
    cands = staged(best.groupBy(*_KEY).agg(F.collect_list(F.struct("t", "bin", "share")).alias("cands")), "licence-candidates")
    both = join_small(asked.select(*_KEY, "keys").distinct(), cands, _KEY, "inner", salt=F.col("_th"))
    sizes = "CASE x.t " + " ".join(f"WHEN {t} THEN {len(notice.split())}" for t, (_, notice, _) in enumerate(TEMPLATES)) + " END"
    near = f"k.l = x.t AND k.p >= greatest(x.bin * {BIN}, 0) AND k.p < greatest(x.bin * {BIN}, 0) + {sizes} + {3 * BIN}"
    sure = both.select(*_KEY, F.expr(f"filter(cands, x -> exists(keys, k -> {near}))").alias("sure"))
    numbers = {label: t for t, (label, _, _) in enumerate(TEMPLATES)}
    part = " OR ".join(f"x.t = {numbers[b]} AND exists(sure, y -> y.t = {numbers[a]} AND abs(x.bin - y.bin) <= 2)" for a, b in LONGER.items())
    names = "array(" + ", ".join(f"'{x}'" for x, _, _ in TEMPLATES) + ")"
    kept = sure.select(*_KEY, F.expr(f"filter(sure, x -> NOT ({part}))").alias("sure")).filter("size(sure) > 0")
    out = kept.select(*_KEY, F.expr(f"array_distinct(transform(sure, x -> {names}[x.t]))").alias("more"), F.expr("array_max(sure.share)").alias("share"))
    out = staged(out, "licence-labels")
    discard(cands)
    return out


def licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, see op6."""
    places, postings, whole = scan(docs.select("doc_id", "text"))
    summed = verified(places, postings, whole)
    base = places.select(*_KEY, "n_words", F.col("base").alias("_p"))
    rows = join_small(base, summed, _KEY, salt=F.col("_th"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_p").cast("long").alias("n_base"),
        F.expr("array_min(_p.p)").alias("first_word"),
        F.expr("array_max(_p.p)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(_p.l)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(_p.l, coalesce(more, cast(array() AS array<string>)))), ',')").alias("labels"),
        F.expr("CASE WHEN size(_p) > 0 THEN 1.0D ELSE coalesce(share, 0.0D) END").alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
