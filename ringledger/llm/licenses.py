"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and looked up in a table of known licence sentences.
The identifiers found, in the order of the text, are matched against ordered rules: within a family of
licences the first rule that matches names the licence. All of it happens within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm.rows import texts

#: Known sentences in normal form (lower case, runs of other characters as one space) by identifier.
SENTENCES = {
    "apache2.ref": ("licensed under the apache license version 2.0", "this file is licensed under the apache license version 2.0", "released under the apache license version 2.0", "spdx license identifier apache 2.0", "licensed under apache 2.0"),
    "apache2.grant": ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",),
    "apache2.comply": ("you may not use this file except in compliance with the license",),
    "apache2.copy": ("you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at"),
    "apache2.basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache2.see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit.ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit", "distributed under the mit license", "the mit license", "mit license", "license mit"),
    "mit.grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit.notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "bsd.ref": ("licensed under the bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license that can be found in the license file"),
    "bsd3.ref": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "bsd2.ref": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "bsd.grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd.source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd.binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd.endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd.advert": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "gpl3.ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3.0 only", "licensed under the gpl v3", "licensed under the gplv3"),
    "gpl3.later": ("either version 3 of the license or at your option any later version", "spdx license identifier gpl 3.0 or later"),
    "gpl2.ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "spdx license identifier gpl 2.0 only", "licensed under the gpl v2", "licensed under the gplv2"),
    "gpl2.later": ("either version 2 of the license or at your option any later version", "spdx license identifier gpl 2.0 or later"),
    "gpl.grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "lgpl3.ref": ("licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only"),
    "lgpl2.ref": ("licensed under the gnu lesser general public license version 2.1", "this work is licensed under the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1 only"),
    "agpl3.ref": ("licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 only"),
    "mpl2.ref": ("this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"),
    "isc.ref": ("licensed under the isc license", "released under the isc license", "spdx license identifier isc"),
    "unlicense.ref": ("this is free and unencumbered software released into the public domain",),
    "cc0.ref": ("licensed under cc0 1.0", "this work is dedicated to the public domain", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    "ccby.ref": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "ccbysa.ref": ("licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "ccbync.ref": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "ccbyncsa.ref": ("licensed under cc by nc sa 4.0", "this work is licensed under cc by nc sa 4.0"),
    "ccbynd.ref": ("licensed under cc by nd 4.0", "this work is licensed under cc by nd 4.0"),
    "ccbyncnd.ref": ("licensed under cc by nc nd 4.0", "this work is licensed under cc by nc nd 4.0"),
    "reserved": ("all rights reserved",),
}

#: Families and their rules in order. A rule is a licence and the identifiers that must follow
#: each other, other known sentences between them allowed.
RULES = {
    "apache": (("Apache-2.0", "apache2.grant apache2.copy apache2.basis apache2.see"), ("Apache-2.0", "apache2.ref"), ("Apache-2.0", "apache2.grant"), ("Apache-2.0", "apache2.comply apache2.basis")),
    "mit": (("MIT", "mit.grant mit.notice asis"), ("MIT", "mit.ref"), ("MIT-partial", "mit.grant")),
    "bsd": (("BSD-4-Clause", "bsd.grant bsd.source bsd.binary bsd.advert"), ("BSD-3-Clause", "bsd.grant bsd.source bsd.binary bsd.endorse"), ("BSD-2-Clause", "bsd.grant bsd.source bsd.binary"), ("BSD-3-Clause", "bsd3.ref"), ("BSD-2-Clause", "bsd2.ref"), ("BSD", "bsd.ref")),
    "gpl": (("GPL-3.0-or-later", "gpl.grant gpl3.later"), ("GPL-2.0-or-later", "gpl.grant gpl2.later"), ("GPL-3.0-or-later", "gpl3.later"), ("GPL-2.0-or-later", "gpl2.later"), ("GPL-3.0-only", "gpl3.ref"), ("GPL-2.0-only", "gpl2.ref"), ("GPL", "gpl.grant")),
    "lgpl": (("LGPL-3.0-only", "lgpl3.ref"), ("LGPL-2.1-only", "lgpl2.ref")),
    "agpl": (("AGPL-3.0-only", "agpl3.ref"),),
    "mpl": (("MPL-2.0", "mpl2.ref"),),
    "isc": (("ISC", "isc.ref"),),
    "public": (("Unlicense", "unlicense.ref"), ("CC0-1.0", "cc0.ref")),
    "cc": (("CC-BY-NC-ND-4.0", "ccbyncnd.ref"), ("CC-BY-NC-SA-4.0", "ccbyncsa.ref"), ("CC-BY-NC-4.0", "ccbync.ref"), ("CC-BY-ND-4.0", "ccbynd.ref"), ("CC-BY-SA-4.0", "ccbysa.ref"), ("CC-BY-4.0", "ccby.ref")),
    "reserved": (("LicenseRef-all-rights-reserved", "reserved"),),
}

#: A sentence ends at one of these marks before white space, or with the line.
ENDS, BREAK = "([.!?;])[ \\t\\r\\f\\x0B\\n]+", "[^a-z0-9.\\n]+"


def known_sentences() -> list[tuple[str, str]]:
    return [(text, name) for name, found in SENTENCES.items() for text in found]


def rule_pattern(sequence: str) -> str:
    """A pattern over the joined identifiers, each between spaces."""
    return " " + " (?:.* )?".join(x.replace(".", "[.]") for x in sequence.split()) + " "


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ENDS, "$1\n"), BREAK, " ")
    table = F.create_map(*(F.lit(x) for pair in known_sentences() for x in pair))
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.try_element_at(table, F.trim(x, F.lit(" .")))), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentences`` (identifiers in order) and ``licenses`` (in the order of the families) of every text.

    Null and empty texts have none of either. Whole texts are read. Nothing is shuffled, and rows map one
    to one, repeated ones too.
    """
    found = texts(docs).select("doc_id", sentence_ids(F.col("text")).alias("sentences"))
    joined = found.withColumn("joined", F.concat(F.lit(" "), F.array_join("sentences", "  "), F.lit(" ")))
    named = []
    for rules in RULES.values():
        first = F.lit(None).cast("string")
        for name, sequence in reversed(rules):
            first = F.when(F.col("joined").rlike(rule_pattern(sequence)), F.lit(name)).otherwise(first)
        named.append(first)
    licenses = F.when(F.size("sentences") > 0, F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>"))
    return joined.select("doc_id", "sentences", licenses.alias("licenses"))


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def digest_sql() -> str:
    """The same rows in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(text)}, {quoted(name)})" for text, name in known_sentences())
    cases = ", ".join("case " + " ".join(f"when regexp_matches(joined, {quoted(rule_pattern(s))}) then {quoted(name)}" for name, s in rules) + " end" for rules in RULES.values())
    return f"""
with known(sentence, name) as (values {values}),
cut as (
  select doc_id, rid, unnest(parts) as part, generate_subscripts(parts, 1) as pos from (
    select doc_id, row_number() over () as rid, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([.!?;])[ \\t\\r\\f\\v\\n]+', '\\1' || chr(10), 'g'), '[^a-z0-9.\\n]+', ' ', 'g'), chr(10)) as parts from documents)
), named as (
  select rid, any_value(doc_id) as doc_id, coalesce(list(name order by pos) filter (where name is not null), []) as names
  from cut left join known on trim(part, ' .') = sentence group by rid
), joined as (select doc_id, names, ' ' || array_to_string(names, '  ') || ' ' as joined from named)
select doc_id, cast(len(names) as bigint) as n_sentences, array_to_string(names, ',') as sentences,
  coalesce(array_to_string(list_filter([{cases}], lambda x: x is not null), ','), '') as licenses from joined
"""
