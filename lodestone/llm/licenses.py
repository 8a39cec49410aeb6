"""Licence scan: sentences to identifiers, identifier sequences to ordered licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Normalised licence sentences (a full stop in a version number is kept) by identifier.
SENTENCES = {
    "apache_ref": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache_obtain": ["you may obtain a copy of the license at http www.apache.org licenses license-2.0", "you may obtain a copy of the license at"],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_asis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd_names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "epl_ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0"],
    "bsd_ref": ["released under the bsd license", "licensed under the bsd license"],
    "gpl2_ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2_free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl3_free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "lgpl21_free": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"
    ],
    "lgpl_hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3_free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc_by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc_by_sa": ["licensed under cc by-sa 4.0"],
    "cc_by_nc": ["licensed under cc by-nc 4.0"],
    "mpl_ref": ["this source code form is subject to the terms of the mozilla public license v"],
    "reserved": ["all rights reserved"],
}

#: Licence, the rule's name, its sentence identifiers in their order.
RULES = [
    ("Apache-2.0", "notice", ["apache_ref"]),
    ("Apache-2.0", "header", ["apache_ref", "apache_comply", "apache_obtain", "apache_asis"]),
    ("MIT", "notice", ["mit_ref"]),
    ("MIT", "text", ["mit_grant", "mit_notice", "mit_asis"]),
    ("BSD-2-Clause", "text", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD", "notice", ["bsd_ref"]),
    ("BSD-3-Clause", "text", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("ISC", "text", ["isc_grant"]),
    ("Unlicense", "text", ["unlicense"]),
    ("CC0-1.0", "notice", ["cc0"]),
    ("EPL-2.0", "notice", ["epl_ref"]),
    ("GPL-2.0", "notice", ["gpl2_ref"]),
    ("GPL-3.0", "notice", ["gpl3_ref"]),
    ("GPL-2.0-or-later", "header", ["gpl2_free", "gpl_hope"]),
    ("GPL-3.0-or-later", "header", ["gpl3_free", "gpl_hope"]),
    ("LGPL-2.1-or-later", "header", ["lgpl21_free", "lgpl_hope"]),
    ("AGPL-3.0-or-later", "header", ["agpl3_free", "gpl_hope"]),
    ("CC-BY-4.0", "notice", ["cc_by"]),
    ("CC-BY-SA-4.0", "notice", ["cc_by_sa"]),
    ("CC-BY-NC-4.0", "notice", ["cc_by_nc"]),
    ("MPL-2.0", "notice", ["mpl_ref"]),
    ("proprietary", "notice", ["reserved"]),
]

RESERVED, NEAR = "proprietary", 8
#: A piece ends at a line break, or at . ! ? ; : before white space, a quote or the end. A known sentence
#: goes over ; and : and single line breaks if its words do, and ends at the others.
BOUNDARY = "[\\n\\r]+|[.!?]+(?=[\"')\\]]*(?:\\s|$))"
#: Characters that stand for ends of pieces within a sentence, and for wraps, which aren't counted.
BREAK, WRAP = "\x01", "\x02"
#: No known sentence has more words, so none has more lines.
LINES = max(len(s.split()) for group in SENTENCES.values() for s in group)


def normalised(sentence: Column) -> Column:
    """Lower case; runs of all but letters, digits, inner points and hyphens become one space."""
    inner = F.regexp_replace(F.lower(sentence), "(?<![\\p{L}\\p{N}])[.-]+|[.-]+(?![\\p{L}\\p{N}])", " ")
    return F.trim(F.regexp_replace(inner, "[^\\p{L}\\p{N}.-]+", " "))


def identified(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Array of (pos: index of the sentence's first piece, id) of the known sentences of a text, in order.

    A known sentence is found where it is made of whole lines and pieces, however it is wrapped. Texts
    and sentences that hold none of the words that every known one has some of are dropped before they
    are normalised."""
    known = {s: k for k, group in sentences.items() for s in group}
    longest = F.array(*(F.lit(s) for s in sorted(known, key=len, reverse=True)))
    lookup = F.create_map(*(F.lit(v) for pair in known.items() for v in pair))
    most = max([LINES, *(len(s.split()) for s in known)])
    marks = "(?i)licen[sc]|copyright|permission|warrant|redistribut|reserved|software"
    none = F.array().cast("array<struct<pos:int,id:string>>")

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def at_line(lines: Column, j: Column) -> Column:
        """The longest known sentence that begins with the j-th line."""
        rest = F.array_join(F.transform(F.slice(lines, j + 1, most), lambda x: x.s), "\n")
        fits = lambda r: F.filter(longest, lambda w: F.startswith(F.translate(r, "\n", " "), w) & F.substring(r, F.length(w) + 1, F.lit(1)).isin("", "\n"))
        return let(rest, lambda r: let(F.get(fits(r), 0), lambda w: F.struct(w.alias("s"), F.size(F.split(F.substring(r, F.lit(1), F.length(w)), "\n")).alias("n"))))

    def breaks(x: Column) -> Column:
        return F.length(x) - F.length(F.translate(x, BREAK, ""))

    def of_group(groups: Column, g: Column) -> Column:
        """The known sentences between two ends of sentences."""
        raw = F.split(g.s, f"(?=[{BREAK}{WRAP}])")
        lines = F.filter(F.transform(raw, lambda x, k: F.struct(k.alias("k"), normalised(x).alias("s"))), lambda x: x.s != "")
        tried = lambda own: F.transform(own, lambda x, j: F.when(F.exists(longest, lambda w: F.startswith(w, x.s)), F.struct(x.k.alias("k"), j.alias("j"), at_line(own, j).alias("hit"))))
        hits = let(lines, lambda own: F.filter(tried(own), lambda h: h.hit.s.isNotNull()))
        apart = let(hits, lambda all_: F.filter(all_, lambda h: ~F.exists(all_, lambda o: (o.j < h.j) & (h.j < o.j + o.hit.n))))
        before = g.at + breaks(F.array_join(F.slice(groups, 1, g.at), ""))
        return F.transform(apart, lambda h: F.struct((before + breaks(F.array_join(F.slice(raw, 1, h.k + 1), ""))).cast("int").alias("pos"), F.element_at(lookup, h.hit.s).alias("id")))

    def of_text(groups: Column) -> Column:
        marked = F.filter(F.transform(groups, lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: x.s.rlike(marks))
        return F.flatten(F.transform(marked, lambda g: of_group(groups, g)))

    return F.when(text.rlike(marks), let(F.split(unwrapped(text), BOUNDARY), of_text)).otherwise(none)


def unwrapped(text: Column) -> Column:
    """Single line breaks become WRAP after a comma, or before a small letter or a digit, and BREAK
    elsewhere, like ; and : at the end of a piece. The next line may start with a comment's signs."""
    text = F.translate(text, BREAK + WRAP, "  ")
    text = F.regexp_replace(text, "(?:(?<=,)[ \\t]*\\r?\\n[ \\t]*(?=[\\p{L}\\p{N}])|(?<=[\\p{L}\\p{N}])[ \\t]*\\r?\\n[ \\t]*(?=[\\p{Ll}\\p{N}]))", f" {WRAP}")
    text = F.regexp_replace(text, "(?<=\\S)[ \\t]*\\r?\\n(?=[^\\p{L}\\p{N}\\n\\r]*[\\p{L}\\p{N}])", f" {BREAK}")
    return F.regexp_replace(text, "[;:]+(?=[\"')\\]]*(?:\\s|$))", f" {BREAK}")


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """docs' columns but the text, and licenses: array of (license, rule, first, last, sentences), with
    the places of a match's first and last sentence. A rule matches where all its identifiers follow in
    order, other sentences between them or not; of rules that match from the same sentence the longest
    is reported. Runs row by row, without a shuffle."""
    others = [c for c in docs.columns if c not in (text, "__ids", "licenses")]
    found = docs.select(*(F.col(f"`{c}`") for c in others), identified(F.col(text), sentences).alias("__ids"))

    def match(ids: list[str]) -> Column:
        """Greedy walk over the sequence: array of (first, last) of each full match."""
        wanted = F.array(*(F.lit(x) for x in ids))
        state = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            hit = x.id == F.get(wanted, a["at"])
            start = F.when(a["at"] == 0, x.pos).otherwise(a.first)
            done = hit & (a["at"] == len(ids) - 1)
            return F.struct(
                F.when(done, F.lit(0)).when(hit, a["at"] + 1).otherwise(a["at"]).alias("at"),
                F.when(hit, start).otherwise(a.first).alias("first"),
                F.when(done, F.concat(a.out, F.array(F.struct(start.alias("first"), x.pos.alias("last"))))).otherwise(a.out).alias("out"),
            )

        return F.aggregate(F.col("__ids"), state, step, lambda a: a.out)

    def reported(license_: str, rule: str, ids: list[str]) -> Column:
        hits = match(ids)
        for longer in (match(r[2]) for r in rules if len(r[2]) > len(ids) and r[2][0] == ids[0]):
            hits = F.transform(F.array(F.struct(hits.alias("h"), longer.alias("l"))), lambda x: F.filter(x.h, lambda h: ~F.exists(x.l, lambda m: m.first == h.first)))[0]
        return F.transform(
            hits,
            lambda h: F.struct(F.lit(license_).alias("license"), F.lit(rule).alias("rule"), h.first.alias("first"), h["last"].alias("last"), F.lit(len(ids)).alias("sentences")),
        )

    none = F.array().cast("array<struct<license:string,rule:string,first:int,last:int,sentences:int>>")
    of = F.concat(none, *(reported(*r) for r in rules if r[0] != RESERVED))
    kept = F.concat(none, *(reported(*r) for r in rules if r[0] == RESERVED))
    # a reservation of rights that stands in a licence's text or header, or shortly before it, belongs to that
    apart = lambda x: F.concat(x.of, F.filter(x.kept, lambda k: ~F.exists(x.of, lambda m: (m.sentences > 1) & (m.first <= k.first + NEAR) & (k.first <= m["last"] + NEAR))))
    matched = F.when(F.size("__ids") > 0, F.transform(F.array(F.struct(of.alias("of"), kept.alias("kept"))), apart)[0])
    empty = F.array().cast("array<struct<license:string,rule:string,first:int,last:int,sentences:int>>")
    return found.select(*(F.col(f"`{c}`") for c in others), F.coalesce(matched, empty).alias("licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with a licence: its licences and matches, in order. Null and empty texts
    have none; repeated rows each give a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).where(F.size("licenses") > 0)
    said = F.transform("licenses", lambda x: F.concat_ws(":", x.license, x.rule, x.first, x["last"]))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.license))), ",").alias("licenses"),
        F.array_join(F.array_sort(said), ",").alias("matches"),
        F.size("licenses").cast("long").alias("n_matches"),
    )
