"""Licence scans with a positional rare-token index.

The index holds, for each licence word, its postings: which phrase or template
it stands in and at what offset.  Words are weighed by inverse document
frequency over the indexed texts.  A file is scanned by looking up the places
of each phrase's and template's highest-IDF word; place minus offset is where
the text would have to start, the other words' postings must agree at the same
relative positions, and a template also needs its mandatory key phrases, word
for word.

The share of a template's words that agree at its best start is its coverage;
with the key phrases present and a coverage of `COVERAGE` it gives its label.
`score` is the largest coverage that gave a label (1 for a base phrase).

Texts without any of the words that every indexed text needs one of are not
split into postings at all.

Defined results: null and empty texts have no words and no labels (empty
strings, score 0); repeated rows come out once each; matches may overlap;
first_word and last_word are null without a base phrase.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: Highest-IDF words of a template whose places are looked up.
ANCHORS = 3
#: What parts words (A-Z are lower-cased after the split, so they are word letters here).
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its words, and phrases without which it is another one."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as their licences word them.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Each phrase and each template's key phrases hold a word that holds one of these.
NEEDED = ("licen", "redistribution", "permission", "unencumbered", "cc")


class Index:
    """IDF weights and postings of phrases and templates."""

    def __init__(self, base=BASE_PHRASES, templates=TEMPLATES, needed=NEEDED):
        self.base, self.templates, self.needed = base, templates, needed
        texts = [p.split() for p, _ in base] + [t.text.split() for t in templates]
        df = Counter(w for t in texts for w in set(t))
        self.idf = {w: math.log((1 + len(texts)) / n) for w, n in df.items()}
        for phrase in [p for p, _ in base] + [t.keys[0] for t in templates]:
            if not any(s in w for w in phrase.split() for s in needed):
                raise ValueError(f"no needed word in {phrase!r}")

    def rarest(self, words: list[str], k: int) -> list[int]:
        """Offsets of the k words of highest IDF, the first of equal ones first."""
        seen, out = set(), []
        for j in sorted(range(len(words)), key=lambda j: (-self.idf.get(words[j], 99.0), j)):
            if words[j] not in seen:
                seen.add(words[j])
                out.append(j)
        return out[:k]

    def vocabulary(self) -> list[str]:
        """Words whose places are looked up: the anchors of every phrase and template."""
        out = set()
        for words, k in [(p.split(), 1) for p, _ in self.base] + [(key.split(), 1) for t in self.templates for key in t.keys] + [(t.text.split(), ANCHORS) for t in self.templates]:
            out |= {words[j] for j in self.rarest(words, k)}
        return sorted(out)


def _quoted(words: list[str]) -> str:
    if any(re.search(r"[^0-9a-z]", w) for w in words):
        raise ValueError("indexed texts are lower-case words")
    return ", ".join(f"'{w}'" for w in words)


def _places(phrase: str, index: Index) -> str:
    """SQL: the sorted starts of a phrase, by the places of its rarest word."""
    words = phrase.split()
    j = index.rarest(words, 1)[0]
    starts = f"transform(filter(hits, h -> h.w = '{words[j]}'), h -> h.i - {j})"
    return f"filter({starts}, s -> s >= 0 and slice(words, s + 1, {len(words)}) = array({_quoted(words)}))"


def _coverage(t: Template, index: Index) -> str:
    """SQL: the largest share of a template's words that agree at one start."""
    words = t.text.split()
    starts = ", ".join(f"transform(filter(hits, h -> h.w = '{words[j]}'), h -> h.i - {j})" for j in index.rarest(words, ANCHORS))
    agree = f"size(filter(transform(array({_quoted(words)}), (w, j) -> coalesce(get(words, s + j) = w, false)), x -> x))"
    return f"coalesce(array_max(transform(array_distinct(concat({starts})), s -> {agree} / {len(words)}.0D)), 0.0D)"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    index = index or Index()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("parts", F.split("t", PARTS, -1)).withColumn("low", F.lower("t"))
    ends = (F.element_at("parts", 1) == "").cast("int") + F.when(F.size("parts") > 1, (F.element_at("parts", -1) == "").cast("int")).otherwise(0)
    candidate = F.lit(False)
    for s in index.needed:
        candidate = candidate | F.contains("low", F.lit(s))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select("doc_id", (F.size("parts") - ends).cast("long").alias("n_words"), F.when(candidate, F.col("parts")).otherwise(none).alias("parts"))
    # lower() also folds letters beyond A-Z, which occur in no indexed word; two of them fold to A-Z and are kept apart.
    rows = rows.withColumn("words", F.expr("transform(filter(parts, w -> w <> ''), w -> if(w rlike '[\\u212A\\u0130]', w, lower(w)))")).drop("parts")
    hits = f"filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), h -> h.w in ({_quoted(index.vocabulary())}))"
    rows = rows.withColumn("hits", F.expr(hits))
    rows = rows.withColumn("base", F.array(*[F.expr(_places(p, index)) for p, _ in index.base]))
    verified: list[Column] = []
    for t in index.templates:
        keys = F.lit(True)
        for key in t.keys:
            keys = keys & (F.size(F.expr(_places(key, index))) > 0)
        verified.append(F.struct(F.lit(t.label).alias("label"), F.when(keys, F.expr(_coverage(t, index))).otherwise(F.lit(0.0)).alias("c")))
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.filter(F.array(*verified), lambda x: x["c"] >= COVERAGE)).otherwise(F.expr("cast(array() as array<struct<label: string, c: double>>)")))
    starts = F.flatten("base")
    base_labels = F.filter(F.array(*[F.when(F.size(F.col("base")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(index.base)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "n_words", starts.alias("starts"), F.array_sort(F.array_distinct(base_labels)).alias("own"), "found")
    more = F.transform("found", lambda x: x["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", more))), ",").alias("labels"),
        F.greatest(F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda x: x["c"])), F.lit(0.0))).alias("score"),
    )


def oracle_sql(index: Index | None = None) -> str:
    """The scan in DuckDB's SQL, over `documents`."""
    index = index or Index()

    def words(text: str) -> str:
        return "[" + _quoted(text.split()) + "]"

    def starts(text: str, k: int) -> str:
        w = text.split()
        own = [f"list_transform(list_filter(range(0, len(w)), lambda i: w[i + 1] = '{w[j]}'), lambda i: i - {j})" for j in index.rarest(w, k)]
        return own[0] if len(own) == 1 else f"list_distinct(list_concat({', '.join(own)}))" if len(own) == 2 else f"list_distinct(list_concat({own[0]}, list_concat({own[1]}, {own[2]})))"

    def places(phrase: str) -> str:
        n = len(phrase.split())
        return f"list_filter({starts(phrase, 1)}, lambda s: s >= 0 AND w[s + 1 : s + {n}] = {words(phrase)})"

    found = []
    for t in index.templates:
        n = len(t.text.split())
        agree = f"len(list_filter(range(0, {n}), lambda j: s + j >= 0 AND w[s + j + 1] = ({words(t.text)})[j + 1])) / {n}.0::DOUBLE"
        best = f"coalesce(list_max(list_transform({starts(t.text, ANCHORS)}, lambda s: {agree})), 0)"
        keys = " AND ".join(f"len({places(k)}) > 0" for k in t.keys)
        found.append(f"CASE WHEN {keys} THEN {best} ELSE 0 END")
    base = ", ".join(f"{places(p)} AS b{k}" for k, (p, _) in enumerate(index.base))
    covers = ", ".join(f"{f} AS c{k}" for k, f in enumerate(found))
    own = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(index.base))
    more = ", ".join(f"CASE WHEN c{k} >= {COVERAGE} THEN '{t.label}' END" for k, t in enumerate(index.templates))
    top = ", ".join(f"CASE WHEN c{k} >= {COVERAGE} THEN c{k} ELSE 0 END" for k in range(len(found)))
    all_base = "list_concat(" * (len(index.base) - 1) + "b0" + "".join(f", b{k})" for k in range(1, len(index.base)))
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ','), '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents), "
        f"b AS (SELECT doc_id, w, {base} FROM t), c AS (SELECT *, {all_base} AS starts, {covers} FROM b) "
        f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word, "
        f"{joined.format(own)} AS base_labels, {joined.format(own + ', ' + more)} AS labels, CAST(greatest(CASE WHEN len(starts) > 0 THEN 1 ELSE 0 END, {top}) AS DOUBLE) AS score FROM c"
    )
