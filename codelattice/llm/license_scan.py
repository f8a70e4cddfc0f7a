"""License scans with a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import cut, lower_ascii

#: A word: a run of digits, a-z (A-Z are lower-cased before) and all characters from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template's key phrase that the index holds.
RARE = 3


@dataclass(frozen=True)
class Template:
    """A license text: its label, its words, and where the key phrase stands that must be there exactly."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def _template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, must = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
    return Template(label, words, (at, at + len(must)), base)


#: Phrases that name a license by themselves, then license texts and notices with their key phrases.
TEMPLATES = (
    _template("gpl", "gnu general public license", base=True),
    _template("apache", "apache license", base=True),
    _template("cc-by", "cc by", base=True),
    _template("mit", "mit license", base=True),
    _template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement""", "permission is hereby granted free of charge"),
    _template("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied""",
              "apache license version 2 0"),
    _template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution""", "redistribution and use in source and binary forms"),
    _template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 3 of the license or at your option any later version""", "free software you can redistribute it"),
    _template("lgpl", "gnu lesser general public license"),
    _template("agpl", "gnu affero general public license"),
    _template("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at""", "mozilla public license"),
    _template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    _template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies""", "permission to use copy modify and or distribute this software"),
    _template("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
              "unencumbered software released into the public domain"),
    _template("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications
        and to alter it and redistribute it freely subject to the following restrictions""", "alter it and redistribute it freely"),
)


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def license_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, known, w): how many words a text has, which licence words are among them, and
    all of its words where every word of some key phrase is, else null."""
    vocabulary = sorted({w for t in templates for w in t.words})
    phrases = sorted({tuple(sorted(set(t.words[slice(*t.key)]))) for t in templates})
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    # An exploded array of one keeps the words from being cut out again for every use.
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(words)).alias("w"))
    rows = rows.select("id", "w", F.explode(F.array(F.array_intersect("w", _texts(vocabulary)))).alias("known"))
    possible = F.exists(F.array(*map(_texts, phrases)), lambda p: F.size(F.array_intersect(p, F.col("known"))) == F.size(p))
    return rows.select("id", F.size("w").cast("long").alias("n_words"), "known", F.when(possible, F.col("w")).alias("w"))


def word_weights(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """The IDF of every licence word over all documents. The result is as small as the templates."""
    seen = words.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r.word: r.n for r in seen}  # the empty word counts the documents
    return {w: math.log(1 + n.get("", 0) / (1 + n.get(w, 0))) for w in sorted({w for t in templates for w in t.words})}


def rare_places(t: Template, weights: dict[str, float], most: int = RARE) -> list[int]:
    """The places of the key phrase's words of highest IDF."""
    return sorted(sorted(range(*t.key), key=lambda i: (-weights[t.words[i]], -len(t.words[i]), i))[:most])


def _starts(templates: tuple[Template, ...], places: list[list[int]]) -> Column:
    """(t, start) of the templates whose rare words all stand at their relative positions.

    The index maps a rare word to the templates and the places in them where it stands. A word's
    position less its place is a start it speaks for; starts that all rare words of a template speak
    for stand side by side once the postings are sorted.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for n, (t, at) in enumerate(zip(templates, places, strict=True)):
        for p in at:
            index.setdefault(t.words[p], []).append((n, p))
    posting = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
    table = F.create_map(*(x for w, e in index.items() for x in (F.lit(w), F.array(*(posting(*y) for y in e)))))
    rare = _texts(index)
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.when(F.array_contains(rare, x), x).alias("x"))), lambda h: h["x"].isNotNull())
    spoken = F.flatten(F.transform(hits, lambda h: F.transform(F.try_element_at(table, h["x"]), lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["p"]).alias("start")))))
    needed = F.array(*(F.lit(len(at)) for at in places))
    return _let(F.sort_array(spoken), lambda v: F.filter(v, lambda x, i: (
        (x["start"] >= 0) & F.coalesce(F.get(v, i + F.get(needed, x["t"]) - 1) == x, F.lit(False)) & ~F.coalesce(F.get(v, i - 1) == x, F.lit(False)))))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Find license phrases and texts in every whole document.

    The words of each text are cut out once (``license_words``); texts without all words of any key
    phrase need no look further. Of each template's key phrase the words with the highest IDF over
    all documents are its postings. A document's places of these words, less the word's own place in
    the template, are intersected: where all rare words agree on a start, the key phrase is compared
    word by word, and the template's share is the IDF-weighted share of its words that stand at
    their relative positions.

    Returns ``id_col``, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (with those of longer texts whose
    key phrase stands; both sorted and comma-joined), score (the largest share of a template whose
    key phrase stands; a base phrase alone counts one half; 0 if none), spans (label, start, share,
    base for each place). One row per input row, repeated rows included; null is an empty text; an
    empty table gives no rows. Nothing is shuffled but the word counts.
    """
    words = cut(license_words(docs, id_col=id_col, text_col=text_col, templates=templates), "license-words")
    weights = word_weights(words, templates)
    places = [rare_places(t, weights) for t in templates]
    total = [sum(weights[w] for w in t.words) or 1.0 for t in templates]
    table = F.array(*(
        F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.key[0]).alias("at"), _texts(t.words[slice(*t.key)]).alias("key"),
                 F.array(*(F.struct(F.lit(w).alias("w"), F.lit(weights[w] / n).alias("share")) for w in t.words)).alias("words"))
        for t, n in zip(templates, total, strict=True)
    ))

    def span(x: Column) -> Column:
        def of(t: Column) -> Column:
            hit = F.slice("w", x["start"] + t["at"] + 1, F.size(t["key"])) == t["key"]
            share = F.aggregate(
                F.transform(t["words"], lambda e, i: F.when(F.get("w", x["start"] + i) == e["w"], e["share"]).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
            return F.when(hit, F.struct(
                t["label"].alias("label"), (x["start"] + t["at"]).alias("start"), F.when(t["base"], 0.5).otherwise(F.least(share, F.lit(1.0))).alias("share"), t["base"].alias("base")))

        return _let(F.get(table, x["t"]), of)

    # A key phrase may stand where its template would begin before the text: starts count from the key phrase.
    keyed = tuple(Template(t.label, t.words[t.key[0] :], (0, t.key[1] - t.key[0]), t.base) for t in templates)
    starts = _starts(keyed, [[p - t.key[0] for p in at] for t, at in zip(templates, places, strict=True)])
    moved = F.transform(starts, lambda x: F.struct(x["t"].alias("t"), (x["start"] - F.get(F.array(*(F.lit(t.key[0]) for t in templates)), x["t"])).alias("start")))
    spans = F.filter(F.transform(moved, span), lambda s: s.isNotNull())
    none = F.array().cast("array<struct<label: string, start: int, share: double, base: boolean>>")
    rows = words.select("id", "n_words", F.explode(F.array(F.when(F.col("w").isNotNull(), spans).otherwise(none))).alias("spans"))
    rows = rows.withColumn("bases", F.filter("spans", lambda s: s["base"]))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts_of = F.transform("bases", lambda x: x["start"])
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.size("bases").cast("long").alias("n_base"),
        F.array_min(starts_of).cast("long").alias("first_word"), F.array_max(starts_of).cast("long").alias("last_word"),
        label("bases").alias("base_labels"), label("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"), "spans",
    )
