"""Licence scans by recognising sentences and matching their order against rules.

A text is cut into sentences within paragraphs (licence texts are often wrapped), and a
sentence that is not known into its lines; each is lower-cased and reduced to letters and digits and looked up
among known licence sentences. The identifiers found, in order, are matched against
rules from the most specific to the least; a rule takes the identifiers it matches, so
each sentence counts for one licence. What no rule takes is reported.

A row is handled alone by DataFrame functions: no shuffle, no Python. Texts without one
of the words that every known sentence has are not cut at all.

Defined results: null and empty texts have no sentences and no licence; repeated
notices give their licence once; rows that repeat get equal results; further columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.session import evaluated_once

# Known sentences, normalised, and rules over their identifiers.
SENTENCES = {
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_program": "this program is free software",
    "gpl3_later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl3_line": "licensed under the gnu general public license version 3",
    "apache2_the": "licensed under the apache license version 2 0 the license",
    "apache2_line": "licensed under the apache license version 2 0",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_line": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_4_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "reserved": "all rights reserved license",
}
RULES = (
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("GPL-3.0-or-later", ("gpl_program", "gpl3_later", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_program", "gpl3_later")),
    ("GPL-2.0-or-later", ("gpl_program", "gpl2_later")),
    ("Apache-2.0", ("apache2_the", "apache2_comply", "apache2_basis")),
    ("Apache-2.0", ("apache2_the", "apache2_comply")),
    ("Apache-2.0", ("apache2_the",)),
    ("Apache-2.0", ("apache2_line",)),
    ("MIT", ("mit_line",)),
    ("MIT", ("mit_under",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-3.0-only", ("gpl3_line",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-4.0", ("cc_by_4_work",)),
)
#: Every known sentence has one of these.
MARKS = r"(?i)licen[cs]e|copyright|permission|redistribut|free software|warrant|cc[^a-z0-9]+by"
SPACE = r"[ \t\r\n\f]"
STOPS = rf"[.!?;:]+{SPACE}+"
BY_PARAGRAPHS = rf"{STOPS}|\n{SPACE}*\n"
LINES = r"[\r\n]+"


def _known(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    names = F.create_map(*[F.lit(x) for name, said in SENTENCES.items() for x in (said, name)])

    def identify(part: Column) -> Column:
        return names[F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " "))]

    def found(part: Column) -> Column:
        lines = F.filter(F.transform(F.split(part, LINES), identify), lambda x: x.isNotNull())
        whole = identify(part)
        return F.when(whole.isNotNull(), F.array(whole)).when(part.rlike(LINES), lines).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(text, BY_PARAGRAPHS), found))


def _matched(start: Column) -> Column:
    """The rules in turn, each on what those before it left.

    A mark stays where a rule took identifiers, so that what stood apart before and
    after them does not become neighbours.
    """
    rules = F.array(
        *[
            F.struct(F.lit("".join(f"<{p}>" for p in parts)).alias("run"), F.lit(name).alias("name"))
            for name, parts in RULES
        ]
    )

    def apply(acc: Column, rule: Column) -> Column:
        names = F.when(
            F.contains(acc.rest, rule.run), F.array_union(acc.names, F.array(rule.getField("name")))
        ).otherwise(acc.names)
        return F.struct(F.replace(acc.rest, rule.run, F.lit("<>")).alias("rest"), names.alias("names"))

    return F.aggregate(rules, start, apply)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licenses (in order of the rules) and
    leftover (identifiers that no rule takes) of every document."""
    marked = F.coalesce(F.col("text").rlike(MARKS), F.lit(False))
    none = F.array().cast("array<string>")
    found = F.when(marked, _known(F.col("text"))).otherwise(none)
    rows = evaluated_once(docs.select("doc_id", found.alias("found")), "found")
    tagged = F.array_join(F.transform("found", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    rows = rows.select("doc_id", F.array_join("found", ",").alias("sentences"), tagged.alias("tagged"))
    start = F.struct(F.col("tagged").alias("rest"), none.alias("names"))
    matched = F.when(F.col("tagged") == "", start).otherwise(_matched(start))
    rows = evaluated_once(rows.withColumn("matched", matched), "matched")
    left = F.trim(F.regexp_replace(F.regexp_replace("matched.rest", "<>", ""), "[<>]+", " "))
    return rows.select(
        "doc_id",
        "sentences",
        F.array_join("matched.names", ",").alias("licenses"),
        F.replace(left, F.lit(" "), F.lit(",")).alias("leftover"),
    )
