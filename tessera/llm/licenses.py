"""License scans by a positional rare-token index, in DataFrame functions only.

The index is made of license templates. Words that few templates have say most about which license a text is (their
inverse document frequency among templates is highest); each template is indexed by its rarest words and their
positions. A text is looked up by all its words that the index has. Every posting votes for a place where the
template would begin: text position minus template position. A template is found where a mandatory key phrase of it
stands exactly at its place and enough of its indexed words agree on that place, give or take a few words.

A text without any mandatory phrase can't be found, so only texts that contain one are looked up at all; that is an
exact filter. All is a row-wise expression over one scan, without a shuffle.

Base labels come from phrases whose words stand consecutively. Words: A-Z lower-cased, then runs of what isn't an ASCII
character other than a letter or digit.

Defined cases. Null and empty texts have no words, no labels and score 0. Repeated rows and null doc_ids are scanned
like any other row. Several places of one template count once. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, documents

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label)
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, template, mandatory key phrases)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("you may not use this file except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("the terms of the gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("the terms of the gnu lesser general public license",)),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("the terms of the gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("the terms of the mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("the terms of the eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("free and unencumbered software released into the public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license to view a copy of this license visit http creativecommons org licenses by nd 4 0", ("creative commons attribution noderivatives",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", ("no part of this publication may be reproduced",)),
)
INDEX_WORDS = 12
TOLERANCE = 3
LEAST_SHARE = 0.5


@lru_cache(maxsize=1)
def index() -> tuple[list[str], dict[int, list[tuple[str, int]]]]:
    """(license words, postings (word, position) of each template). The templates bound both."""
    words = [t.split() for _, t, _ in TEMPLATES]
    df: dict[str, int] = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log((1 + len(words)) / n) for x, n in df.items()}
    postings, used = {}, set()
    for k, w in enumerate(words):
        once = [x for x in dict.fromkeys(w) if w.count(x) == 1]  # of one place only
        best = sorted(once, key=lambda x: (-idf[x], x))[:INDEX_WORDS]
        postings[k] = [(x, w.index(x)) for x in best]
        used |= set(best)
    return sorted(used), postings


def normalized(text: Column) -> Column:
    """The words of a text with one space between them, and none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " "))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(spaced: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number of places, first, last) of a phrase in ` w0 w1 ... `. Places are word numbers, else null."""
    held = F.contains(spaced, F.lit(f" {phrase} "))
    count = F.when(held, F.regexp_count(spaced, F.lit(f" (?={re.escape(phrase).replace(chr(92) + ' ', ' ')} )")).cast("long")).otherwise(F.lit(0).cast("long"))
    first = F.when(held, _spaces(F.substr(spaced, F.lit(1), F.locate(f" {phrase} ", spaced))) - 1)
    last = F.when(held, n_words - _spaces(F.substring_index(spaced, f" {phrase} ", -1)) - len(phrase.split()))
    return count, first, last


#: A template's number and a place in one number; places may lie before the text's first word.
_SPAN, _BEFORE = 1 << 40, 1 << 20


def _lookup(words: Column) -> Column:
    """Of an array of words: struct(label, score) for each place where a template is found.

    Postings and templates are constants that the expression holds once, whatever their number."""
    _, postings = index()
    by_word: dict[str, list[dict]] = {}
    for k, own in postings.items():
        for w, off in own:
            by_word.setdefault(w, []).append({"t": k, "off": off})
    all_of = [
        {"label": label, "keys": [{"at": _place_of(text, key), "words": key.split()} for key in keys], "posted": [{"w": w, "off": off} for w, off in postings[k]]}
        for k, (label, text, keys) in enumerate(TEMPLATES)
    ]
    posted = F.from_json(F.lit(json.dumps(by_word)), "map<string, array<struct<t bigint, off bigint>>>")
    templates = F.from_json(F.lit(json.dumps(all_of)), "array<struct<label string, keys array<struct<at bigint, words array<string>>>, posted array<struct<w string, off bigint>>>>")
    slips = F.array(*(F.lit(x).cast("long") for x in range(-TOLERANCE, TOLERANCE + 1)))

    def word_at(i: Column) -> Column:
        return F.get(words, i.cast("int"))

    def key_stands(key: Column, at: Column) -> Column:
        def here(slip: Column) -> Column:
            i = at + key["at"] + slip
            return (i >= 0) & (word_at(i) == F.get(key["words"], F.lit(0))) & (F.slice(words, (F.greatest(i, F.lit(0)) + 1).cast("int"), F.size(key["words"])) == key["words"])

        return F.exists(slips, lambda slip: F.coalesce(here(slip), F.lit(False)))

    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda p: p["w"].isin(sorted(by_word)))
    votes = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(posted, p["w"]), lambda q: q["t"] * _SPAN + _BEFORE + p["i"] - q["off"])))

    def found(vote: Column) -> Column:
        t = F.element_at(templates, (F.shiftright(vote, 40) + 1).cast("int"))
        at = F.pmod(vote, F.lit(_SPAN)) - _BEFORE
        agree = F.size(F.filter(t["posted"], lambda q: F.exists(slips, lambda slip: F.coalesce(word_at(at + q["off"] + slip) == q["w"], F.lit(False)))))
        stands = F.exists(t["keys"], lambda key: key_stands(key, at))
        return F.struct(t["label"].alias("label"), F.when(stands, agree / F.size(t["posted"])).otherwise(F.lit(0.0)).alias("score"))

    return F.filter(F.transform(F.array_distinct(votes), found), lambda x: x["score"] >= LEAST_SHARE)


def _place_of(template: str, key: str) -> int:
    w, p = template.split(), key.split()
    return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, for each row."""
    rows = docs.select(F.col(key).alias("doc_id"), normalized(F.col(text)).alias("norm"))
    n_words = F.when(F.col("norm") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("norm")) + 1)
    rows = rows.select("doc_id", "norm", n_words.alias("n_words"), F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).alias("spaced"))
    places = [phrase_places(F.col("spaced"), F.col("n_words"), p) for p, _ in BASE]
    may = F.lit(False)
    for _, _, keys in TEMPLATES:
        for k in keys:
            may = may | F.contains("spaced", F.lit(f" {k} "))
    base = F.sort_array(F.array_distinct(F.array_compact(F.array(*(F.when(c > 0, F.lit(label)) for (c, _, _), (_, label) in zip(places, BASE, strict=True))))))
    rows = rows.select(
        "doc_id", "n_words", sum((c for c, _, _ in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f for _, f, _ in places)).alias("first_word"), F.greatest(*(x for _, _, x in places)).alias("last_word"), base.alias("base"),
        # inside a lambda the words are split once, not wherever they are read
        F.when(may, F.element_at(F.transform(F.array(F.split("norm", " ")), _lookup), 1)).alias("found"),
    )
    found = F.coalesce(F.col("found"), F.from_json(F.lit("[]"), "array<struct<label string, score double>>"))
    labels = F.sort_array(F.array_distinct(F.concat(F.col("base"), F.transform(found, lambda x: x["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan_licenses(documents(spark, sf_dir))


def _sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def words(x: str) -> str:
        return "[" + ", ".join(map(text, x.split())) + "]"

    _, postings = index()
    posted = ", ".join(f"({k}, {text(w)}, {off})" for k, own in postings.items() for w, off in own)
    keys = ", ".join(f"({k}, {text(label)}, {_place_of(t, key)}, {words(key)}, {len(postings[k])})" for k, (label, t, ks) in enumerate(TEMPLATES) for key in ks)
    base = ", ".join(f"({words(p)}, {text(label)})" for p, label in BASE)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}', ' ', 'g')) AS norm FROM documents),
w AS (SELECT doc_id, r, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM d),
b(phrase, label) AS (VALUES {base}),
h AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase)) AS i FROM w, b),
f AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM h GROUP BY r),
p(t, x, off) AS (VALUES {posted}),
k(t, label, place, phrase, n) AS (VALUES {keys}),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w),
v AS (SELECT DISTINCT r, t, x, i - off AS pos FROM u JOIN p USING (x)),
c AS (
  SELECT DISTINCT r, t, pos, n, label FROM (SELECT DISTINCT r, t, pos FROM v) JOIN w USING (r) JOIN k USING (t), range(-{TOLERANCE}, {TOLERANCE} + 1) AS s(slip)
  WHERE pos + place + slip >= 0 AND w[pos + place + slip + 1 : pos + place + slip + len(phrase)] = phrase),
s AS (SELECT c.r, c.label, count(DISTINCT v.x) / c.n AS score FROM c JOIN v ON c.r = v.r AND c.t = v.t AND abs(v.pos - c.pos) <= {TOLERANCE} GROUP BY c.r, c.t, c.pos, c.n, c.label),
g AS (SELECT r, list(DISTINCT label) AS found, max(score) AS score FROM s WHERE score >= {LEAST_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN f USING (r) LEFT JOIN g USING (r)
"""


OP8_SQL = _sql()
