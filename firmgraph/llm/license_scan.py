"""Licence scan by a positional rare-token index.

Each licence template is a list of words with a mandatory key phrase; its postings are (word, position). The document frequency
of every template word is counted over all documents. In each file, for each template, the words of the template with the
highest inverse document frequency among those that the file has (RARE of them) are looked up: an occurrence at place p of the
word that the template has at position q puts the template at p - q. A template is found where the key phrase stands word by
word, and VOTES postings of rare words (or all there are, if a template has fewer) agree on that place, give or take SLACK
words. Its score there is the share of the template's words, weighted by rarity, that stand at their places within SLACK, so
altered, missing or added words in the rest of a text lower the score only; from LEAST_SHARE on, the label is given.

The base's phrases are templates whose key is the whole phrase: all places where it stands are counted, however long the file,
as each has the phrase's rarest word. Words around them enter the score, but need not be there.

Texts are split into words once; what is kept of them are the places of template words. Everything happens within a row; only
the counts of the few template words are shuffled.

Defined results: a null text counts as empty (no words, no labels, score 0); a very long text is scanned whole; rows are never
joined or grouped, so repeated rows, null ids and further columns do not matter; of several places of a template the best
score counts; of an empty table nothing is returned.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.llm.common import Workspace

#: A word: a run of what is neither ASCII punctuation, white space nor control, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, VOTES, SLACK, LEAST_SHARE = 8, 2, 3, 0.6


@dataclass(frozen=True)
class Template:
    label: str
    key: str  # words that must stand one after the other
    before: str = ""  # words that stand before and after
    after: str = ""
    whole: bool = False  # whether most of the words around the key must stand there too

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.key} {self.after}".split()

    @property
    def lead(self) -> int:
        return len(self.before.split())


#: The phrases and labels of the report's base.
BASE = (
    Template("gpl", "gnu general public license", before="this work is licensed under the", after="version 3"),
    Template("apache", "apache license", before="licensed under the", after="version 2 0"),
    Template("cc-by", "cc by", before="licensed under", after="4 0"),
    Template("mit", "mit license", before="released under the"),
)
#: The method's own labels: names of licences, and whole texts or notices of public licences.
OWN = (
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0", before="licensed under the"),
    Template("mpl", "mozilla public license"),
    Template("cc-by-nc", "cc by nc", before="licensed under", after="4 0"),
    Template("cc-by-sa", "cc by sa", before="licensed under", after="4 0"),
    Template("gpl-text", "free software you can redistribute it and or modify it under the terms of the"),
    Template("apache-text", "you may not use this file except in compliance with the license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
    Template(
        "gpl-text", "free software you can redistribute it", whole=True, before="this program is",
        after="and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "apache-text", "except in compliance with the license", whole=True, before="licensed under the apache license version 2 0 the license you may not use this file",
        after="you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "mit-text", "permission is hereby granted free of charge", whole=True,
        after="to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    Template(
        "bsd-text", "redistribution and use in source and binary forms", whole=True,
        after="with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "isc-text", "permission to use copy modify and or distribute this software", whole=True,
        after="for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    Template(
        "zlib-text", "provided as is without any express or implied warranty", whole=True, before="this software is",
        after="in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions",
    ),
    Template(
        "mpl-text", "subject to the terms of the mozilla public license", whole=True, before="this source code form is",
        after="v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    Template(
        "unlicense", "free and unencumbered software", whole=True, before="this is",
        after="released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: n_base counts the places of base phrases; found has the places by template, in words from 0.
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")


def file_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def rarity(hits: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents; at most one row a word comes to the driver."""
    held = F.array_distinct(F.transform("__hits", lambda x: x["w"]))
    counts = hits.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # len(vocabulary) + 1 rows at most; "" counts the documents
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def _table(rows: list[dict], kind: str) -> str:
    """A constant array of structs; one JSON text is planned much faster than an expression for each value."""
    return f"from_json('{json.dumps(rows)}', 'array<struct<{kind}>>')"


def _keys(t: Template, idf: dict[str, float]) -> str:
    """Where a key phrase stands whole, found from the hits of its rarest word: s, its place among words, and i, among hits."""
    key = t.key.split()
    at = max(range(len(key)), key=lambda i: (idf[key[i]], -i))
    tests = [f"x.w = '{key[at]}'"]
    for j, w in enumerate(key):
        if j != at:
            tests.append(f"get(__hits, x.i + {j - at}).w = '{w}' and get(__hits, x.i + {j - at}).p = x.p + {j - at}")
    return f"transform(filter(__hits, x -> {' and '.join(tests)}), x -> named_struct('s', x.p - {at}, 'i', x.i - {at}))"


def _near(t: Template, start: str) -> str:
    """The hits in reach of a template whose key stands at start."""
    reach = len(t.words) + SLACK
    return f"slice(__hits, greatest({start}.i + 1 - {t.lead + SLACK}, 1), {t.lead + reach + SLACK + 1})"


def _votes(t: Template, idf: dict[str, float], start: str) -> str:
    """Whether the rarest of the template's words that the file has put it at this start.

    Words are known by their place in the order of rarity; the file's RARE-th of them is the last that may vote.
    """
    order = sorted(set(t.words), key=lambda w: (-idf[w], w))
    known = f"filter(transform(split('{' '.join(order)}', ' '), (w, r) -> if(exists(__hits, h -> h.w = w), r, null)), r -> r is not null)"
    places = _table([{"w": w, "q": q, "r": order.index(w)} for q, w in enumerate(t.words)], "w: string, q: int, r: int")
    last = f"element_at(slice({known}, 1, {RARE}), -1)"
    agree = f"size(filter({places}, y -> y.r <= {last} and exists({_near(t, start)}, h -> h.w = y.w and abs(h.p - y.q - ({start}.s - {t.lead})) <= {SLACK})))"
    return f"{agree} >= least({VOTES}, {len(t.words)})"


def _share(t: Template, idf: dict[str, float], start: str) -> str:
    """The share of a template's weighted words that stand at their places."""
    total = sum(idf[w] + 0.01 for w in t.words)
    slack = SLACK if t.whole else 0
    places = _table([{"w": w, "q": q, "v": round((idf[w] + 0.01) / total, 9)} for q, w in enumerate(t.words)], "w: string, q: int, v: double")
    return f"aggregate({places}, 0D, (acc, y) -> acc + if(exists({_near(t, start)}, h -> h.w = y.w and abs(h.p - y.q - ({start}.s - {t.lead})) <= {slack}), y.v, 0D))"


def _found(t: Template, keys: str, idf: dict[str, float]) -> str:
    """Places of the key phrase, with the share; of whole texts those with votes and enough of the words."""
    scored = f"transform({keys}, k -> named_struct('s', k.s, 'share', {_share(t, idf, 'k')}))"
    if t.whole:
        voted = f"filter({keys}, k -> {_votes(t, idf, 'k')})"
        scored = f"filter(transform({voted}, k -> named_struct('s', k.s, 'share', {_share(t, idf, 'k')})), z -> z.share >= {LEAST_SHARE}D)"
    # files without the key phrase, nearly all, cost nothing more
    return f"if(size({keys}) > 0, {scored}, array())"


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those in keep, if it is given), then the results in RESULTS; a column of docs with the name of a result is left out."""
    templates = base + own
    vocabulary = template_words(templates)
    hits = F.filter(F.transform("__words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    held = docs.select(*[F.col(f"`{c}`") for c in kept], file_words(F.col("text")).alias("__words"))
    held = held.select(*[F.col(f"`{c}`") for c in kept], F.size("__words").cast("long").alias("n_words"), hits.alias("__hits"))
    held = Workspace(docs.sparkSession, "licences").save(held, "hits")
    idf = rarity(held, vocabulary)
    held = held.withColumn("__hits", F.transform("__hits", lambda x, i: F.struct(x["p"].alias("p"), x["w"].alias("w"), i.alias("i"))))
    keyed = held.withColumns({f"__keys_{n}": F.expr(_keys(t, idf)) for n, t in enumerate(templates)})
    found = keyed.withColumns({f"__at_{n}": F.expr(_found(t, f"__keys_{n}", idf)) for n, t in enumerate(templates)})
    at = {t: f"__at_{n}" for n, t in enumerate(templates)}
    places = lambda t: F.transform(at[t], lambda y: y["s"].cast("long"))
    label = lambda ts: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(at[t]) > 0, F.lit(t.label)) for t in ts])))), ",")
    best = F.greatest(*[F.coalesce(F.array_max(F.transform(c, lambda y: y["share"])), F.lit(0.0)) for c in at.values()])
    scored = found.withColumn("__base", F.array_sort(F.flatten(F.array(*[places(t) for t in base])))).withColumns({
        "n_base": F.size("__base").cast("long"),
        "first_word": F.get("__base", F.lit(0)),
        "last_word": F.get("__base", F.size("__base") - 1),
        "base_labels": label(base),
        "labels": label(templates),
        "score": F.least(F.round(best, 6), F.lit(1.0)),
        "found": F.array(*[F.struct(F.lit(t.label).alias("label"), places(t).alias("starts")) for t in templates]),
    })
    return scored.select(*[F.col(f"`{c}`") for c in kept], *RESULTS)
