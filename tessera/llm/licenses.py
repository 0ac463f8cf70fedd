"""Licence scans by sentence rules.

A text is cut into sentences, twice: line by line, and with wrapped lines joined. The cutter knows that a full stop after "v",
an initial or a list number ends nothing. Sentences are normalised (lower case, runs of other characters than letters and
digits become one space, list numbers go) and mapped to identifiers:

* ``T:<name>`` for a known sentence of a licence's own text, of which names that are filled in may be anything;
* ``N:<licence>`` for each licence that a notice names ("released under the MIT License", "covered by GPL v2 or MIT, see
  below", ``SPDX-License-Identifier: MIT OR Apache-2.0``), or that a line which holds nothing else names ("The MIT License (MIT)").
  What a notice denies ("not licensed under", "never intended to be released under") is not taken.

The sequence of a document's identifiers is then matched against the rules, each an ordered list of identifiers. Of rules
that match, one whose identifiers are part of another's gives way to it (three clauses win over two). All of it happens
within a row: nothing is shuffled.

Defined cases: a null text is empty; a text without known sentences has empty results; a sentence that repeats counts each
time; repeated rows each get their row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Names under which licences are cited, normalised, without "the", "license" and "version".
NAMES = {
    "MIT": ["mit", "expat", "x11"],
    "Apache-2.0": ["apache 2 0", "apache 2", "asl 2 0", "apache software 2 0"],
    "Apache-1.1": ["apache 1 1"],
    "GPL-1.0": ["gnu general public 1", "gnu gpl 1", "gpl 1", "gpl 1 0", "gplv1"],
    "GPL-2.0": ["gnu general public 2", "gnu gpl 2", "gnu gpl 2 0", "gpl 2", "gpl 2 0", "gplv2", "gnu gplv2"],
    "GPL-3.0": ["gnu general public 3", "gnu gpl 3", "gnu gpl 3 0", "gpl 3", "gpl 3 0", "gplv3", "gnu gplv3"],
    "LGPL-2.1": ["gnu lesser general public 2 1", "lgpl 2 1", "lgplv2 1", "gnu lgpl 2 1"],
    "LGPL-3.0": ["gnu lesser general public 3", "lgpl 3", "lgpl 3 0", "lgplv3", "gnu lgpl 3"],
    "AGPL-3.0": ["gnu affero general public 3", "agpl 3", "agpl 3 0", "agplv3", "gnu agpl 3"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD": ["bsd"],
    "ISC": ["isc"],
    "MPL-2.0": ["mozilla public 2 0", "mozilla public 2", "mpl 2 0", "mpl 2"],
    "MPL-1.1": ["mozilla public 1 1", "mpl 1 1"],
    "EPL-1.0": ["eclipse public 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public 2 0", "epl 2 0"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"],
    "BSL-1.0": ["boost software 1 0", "boost 1 0"],
    "Zlib": ["zlib"],
    "WTFPL": ["wtfpl"],
    "Unlicense": ["unlicense"],
    "Artistic-2.0": ["artistic 2 0"],
    "Artistic-1.0": ["artistic 1 0"],
    "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause", "free public 1 0 0"],
    "OFL-1.1": ["sil open font 1 1", "sil open font", "open font 1 1", "ofl 1 1", "sil ofl 1 1", "ofl"],
    "CDDL-1.0": ["common development and distribution 1 0", "common development and distribution cddl 1 0", "cddl 1 0"],
    "CDDL-1.1": ["common development and distribution 1 1", "cddl 1 1"],
    "PSF-2.0": ["python software foundation 2", "python software foundation", "psf 2", "psf 2 0", "psf"],
    "Python-2.0": ["python 2 0", "python"],
    "EUPL-1.1": ["european union public 1 1", "eupl 1 1"],
    "EUPL-1.2": ["european union public 1 2", "eupl 1 2"],
    "LGPL-2.0": ["gnu library general public 2", "lgpl 2", "lgpl 2 0", "lgplv2", "gnu lgpl 2"],
    "AGPL-1.0": ["affero general public 1", "agpl 1 0"],
    "GFDL-1.1": ["gnu free documentation 1 1", "gfdl 1 1"],
    "GFDL-1.2": ["gnu free documentation 1 2", "gfdl 1 2"],
    "GFDL-1.3": ["gnu free documentation 1 3", "gfdl 1 3"],
    "AFL-3.0": ["academic free 3 0", "afl 3 0"],
    "OSL-3.0": ["open software 3 0", "osl 3 0"],
    "ECL-2.0": ["educational community 2 0", "ecl 2 0"],
    "NCSA": ["university illinois ncsa open source", "ncsa"],
    "PostgreSQL": ["postgresql"],
    "OpenSSL": ["openssl"],
    "PHP-3.01": ["php 3 01"],
    "Ruby": ["ruby"],
    "Vim": ["vim"],
    "Beerware": ["beerware", "beer ware"],
    "MS-PL": ["microsoft public", "ms pl"],
    "MS-RL": ["microsoft reciprocal", "ms rl"],
    "CPL-1.0": ["common public 1 0", "cpl 1 0"],
    "IPL-1.0": ["ibm public 1 0", "ipl 1 0"],
    "QPL-1.0": ["q public 1 0", "qpl 1 0"],
    "UPL-1.0": ["universal permissive 1 0", "upl 1 0"],
    "ZPL-2.1": ["zope public 2 1", "zpl 2 1"],
    "LPPL-1.3c": ["latex project public 1 3c", "lppl 1 3c"],
    "CeCILL-2.1": ["cecill 2 1"],
    "MulanPSL-2.0": ["mulan psl 2", "mulan psl 2 0", "mulan permissive software 2"],
    "BlueOak-1.0.0": ["blue oak model 1 0 0"],
    "ODbL-1.0": ["open database 1 0", "odbl 1 0", "open data commons open database 1 0"],
    "ODC-By-1.0": ["open data commons attribution 1 0", "odc by 1 0"],
    "PDDL-1.0": ["open data commons public domain dedication and 1 0", "pddl 1 0"],
    "SSPL-1.0": ["server side public 1", "sspl 1", "sspl 1 0"],
    "BUSL-1.1": ["business source 1 1", "busl 1 1"],
    "MPL-1.0": ["mozilla public 1 0", "mpl 1 0"],
    "Proprietary": ["proprietarylicense", "commerciallicense"],
}

#: Licences that exist with "or any later version".
LATER = ["LGPL-2.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]

_NOTICE = "the above copyright notice and this permission notice"
#: Sentences of licences' own texts, normalised, as patterns; what is filled in is bounded.
SENTENCES = {
    "mit-grant": "^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": f"^{_NOTICE} shall be included in all copies or substantial portions of the software$",
    "as-is": "^the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "boost-grant": "^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "apache-except": "you may not use this (?:file|software|work) except in compliance with the license$",
    "apache-copy": "^you may obtain a copy of the license at http",
    "apache-basis": "^unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl-terms": "redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl-terms": "redistribute it and or modify it under the terms of the gnu lesser general public license",
    "agpl-terms": "redistribute it and or modify it under the terms of the gnu affero general public license",
    "version-1-later": "version 1 of the license orlater",
    "version-2-later": "version 2 of the license orlater",
    "version-2.1-later": "version 2 1 of the license orlater",
    "version-3-later": "version 3 of the license orlater",
    "version-2": "version 2 of the license$",
    "version-2.1": "version 2 1 of the license$",
    "version-3": "version 3 of the license$",
    "gpl-warranty": "^this (?:program|library|software) is distributed in the hope that it will be useful but without any warranty",
    "bsd-grant": "^redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met$",
    "bsd-source": "^redistributions? of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer$",
    "bsd-binary": "^redistributions? in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution$",
    "bsd-endorse": "^(?:neither the names? of .{1,120} nor the names of (?:its|any|their|the) .{0,20}contributors|the names? of .{1,120}) may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission$",
    "bsd-advert": "^all advertising materials mentioning features or use of this software must display the following acknowledge?ment$",
    "isc-grant": f"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that {_NOTICE} appear in all copies$",
    "zlib-grant": "^permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions$",
    "mpl-header": "^this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0$",
    "unlicense": "^this is free and unencumbered software released into the public domain$",
    "wtfpl": "^you just do what the fuck you want to$",
    "cc0-deed": "has (?:dedicated|waived) .{0,80}the work to the public domain",
    "apache-defines": "^license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document$",
    "0bsd-grant": "^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted$",
    "ofl-goals": "^the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects",
    "ofl-mean": "^the ofl allows the licensed fonts to be used studied modified and redistributed freely as long as they are not sold by themselves$",
    "cddl-use": "^the contents of this file are subject to the terms of the common development and distribution license",
    "psf-agreement": "^this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using",
    "eupl-applies": "^this european union public licen[sc]e the eupl applies to the work",
    "gpl-2-named": "under the terms of (?:the )?gnu general public license(?: gpl)? version 2(?: only| as published by the free software foundation|$)",
    "gpl-3-named": "under the terms of (?:the )?gnu general public license(?: gpl)? version 3(?: only| as published by the free software foundation|$)",
    "lgpl-2.1-named": "under the terms of (?:the )?gnu (?:lesser|library) general public license(?: lgpl)? version 2 1(?: only| as published by the free software foundation|$)",
    "lgpl-3-named": "under the terms of (?:the )?gnu lesser general public license(?: lgpl)? version 3(?: only| as published by the free software foundation|$)",
    "boost-end": "^the copyright notices in the software and this entire statement including the above license grant",
    "ncsa-grant": "to deal with the software without restriction",
    "postgresql-grant": "^permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "epl-content": "^this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|v |version )?2 0",
    "epl-1-content": "^this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|v |version )?1 0",
    "ms-pl-accept": "^if you use the software you accept this license$",
    "reserved": "^all rights reserved$",
}

#: Licences of texts that come as a sequence of sentences.
SEQUENCES = [
    ("MIT", ["mit-grant", "as-is"]),
    ("MIT", ["mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-except", "apache-copy"]),
    ("Apache-2.0", ["apache-except", "apache-basis"]),
    ("GPL-1.0-or-later", ["gpl-terms", "version-1-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "version-2-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "version-3-later"]),
    ("GPL-2.0", ["gpl-terms", "version-2"]),
    ("GPL-3.0", ["gpl-terms", "version-3"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "version-2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "version-3-later"]),
    ("LGPL-2.1", ["lgpl-terms", "version-2.1"]),
    ("LGPL-3.0", ["lgpl-terms", "version-3"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "version-3-later"]),
    ("AGPL-3.0", ["agpl-terms", "version-3"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("MPL-2.0", ["mpl-header"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("Apache-2.0", ["apache-defines"]),
    ("0BSD", ["0bsd-grant"]),
    ("OFL-1.1", ["ofl-goals"]),
    ("OFL-1.1", ["ofl-mean"]),
    ("CDDL-1.0", ["cddl-use"]),
    ("PSF-2.0", ["psf-agreement"]),
    ("EUPL-1.2", ["eupl-applies"]),
    ("GPL-2.0", ["gpl-2-named"]),
    ("GPL-3.0", ["gpl-3-named"]),
    ("LGPL-2.1", ["lgpl-2.1-named"]),
    ("LGPL-3.0", ["lgpl-3-named"]),
    ("BSL-1.0", ["boost-end"]),
    ("NCSA", ["ncsa-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("EPL-2.0", ["epl-content"]),
    ("EPL-1.0", ["epl-1-content"]),
    ("MS-PL", ["ms-pl-accept"]),
]

VERBS = "(?:licen[sc]ed|released|distributed|published|available|provided|free|covered|governed|redistributed|used)"
#: Every known sentence and every notice holds this (tested), in whatever way its words are parted; the rest is not looked at.
HINT = rf"licen|permission|warrant|public[^a-z0-9]+domain|reserved|redistribution|advertising|what[^a-z0-9]+the[^a-z0-9]+fuck|the names?[^a-z0-9]+of|copyright[^a-z0-9]+notice|{VERBS}[^a-z0-9]+(?:for[^a-z0-9]+use[^a-z0-9]+)?(?:under|by)"
#: Read before sentences are cut: full stops and colons that end none, and marks that would get lost.
BEFORE = [
    (r"(?m)^[ \t]*(?:[#*;%>|]+|//+|--+)[ \t]*", ""),  # comment marks
    (r"([0-9])\+", "$1 or later "),
    (r"\b(v|ver|vers|no|inc|ltd|corp|e\.g|i\.e|[a-z])\.[ \t]", "$1 "),
    (r"(?m)^[ \t]*([0-9]{1,2})\.[ \t]", "$1 "),
    (r"(licen[sc]es?|identifier)[ \t]*:", "$1 "),
]
CUT = r"([.!?:;])\s+|\n"
#: Read in sentences once they are normalised.
AFTER = [
    (r"^(?:[0-9]{1,2}|[a-d]|i{1,3}) ", ""),
    (r"\bor (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?\b", "orlater"),
    (r"\borlater of the license\b", "orlater"),
]
#: Words that may stand between a denial and what it denies, besides two others.
BETWEEN = "(?:be|been|being|is|are|was|were|to|have|has|had|intended|meant|supposed|planned|going|allowed|yet|ever|currently|officially|originally|otherwise)"
DENIED = rf"\b(?:not|never|cannot|nor|no longer|neither) (?:{BETWEEN} ){{0,6}}(?:[a-z]+ )?(?:[a-z]+ )?{VERBS} (?:for use )?(?:under|by)\b"
#: The expression of an SPDX tag as it stands: identifiers, operators, exceptions and parentheses (the group).
EXPRESSION = r"(?i)spdx-license-identifier:[ \t]*([(a-z0-9][a-z0-9.+()\- \t]*[a-z0-9.+)])"
#: Where a notice cites licences: all known names in the rest (the group) count.
CITING = rf"(?:^spdx license identifier|\b{VERBS} (?:for use )?under|\b(?:covered|governed) by) (.+)$"
#: Publishers and makers stand after these too, so that the rest (the group) must be names and no more.
BY = rf"\b{VERBS} (?:for use )?by (.{{2,80}})$"
#: A line of names and nothing else, as long as it says "license" (the group).
ALONE = r"^(.{0,60}licen[sc]e.{0,60})$"
#: Read in what is cited: "commercial" and "proprietary" are names before "license" and alone; words that say nothing go.
CITED = [
    (r"\b(proprietary|commercial)(?: licen[sc]e\b| or\b| and\b|$)", "$1license "),
    (r"(?:\b[0-9]{1,2} )?\b(?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4}\b", " "),
    (r"\b(?:spdx|identifier|licen[sc]es?|licensed|version|the|only|terms|and conditions|dual|an?|of|under)\b", " "),
    (r"\bv ?([0-9])", "$1"),
    (r" +", " "),
]


def names() -> dict[str, str]:
    """Cited name to licence, with those of later versions."""
    plain = {name: licence for licence, some in NAMES.items() for name in some}
    return plain | {f"{name} orlater": f"{licence}-or-later" for name, licence in plain.items() if licence in LATER}


def _any_name() -> str:
    return "|".join(sorted(names(), key=lambda n: (-len(n), n)))


def name_pattern() -> str:
    """Known names, the longest first, with the number that goes on, which makes it another version (the group)."""
    return rf"\b((?:{_any_name()})(?: [0-9]{{1,2}})?)\b"


def only_names() -> str:
    return rf"^(?:(?:{_any_name()})(?: or\b| and\b| with\b)? ?)+$"


def rules() -> list[tuple[str, list[str]]]:
    """Licence and its ordered identifiers: one of a notice for each name, and the sequences."""
    return [(licence, [f"N:{licence}"]) for licence in sorted(set(names().values()))] + [(licence, [f"T:{x}" for x in some]) for licence, some in SEQUENCES]


def rule_pattern(wanted: list[str]) -> str:
    return " " + " (?:.* )?".join(x.replace(".", r"\.") for x in wanted) + " "


def gives_way(licence: str, hits: dict[str, list[list[str]]]) -> list[str]:
    """Licences whose rules hold all identifiers of a rule of this one, and more: where they match, it doesn't count."""
    own = hits[licence]
    more = [other for other, some in hits.items() if other != licence and any(set(a) < set(b) for a in own for b in some)]
    return more + [other for other in hits if licence == "BSD" and other.startswith("BSD-")]


def by_licence() -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for licence, wanted in rules():
        out.setdefault(licence, []).append(wanted)
    return out


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def identifiers(sentences: Column) -> Column:
    """The identifiers of the known sentences among lower-case sentences, in order; of one that has several, with spaces."""
    of_name = F.create_map(*[F.lit(v) for kv in names().items() for v in (kv[0], f"N:{kv[1]}")])

    def one(s: Column) -> Column:
        known = [F.when(s.rlike(pattern), F.lit(f"T:{k}")) for k, pattern in SENTENCES.items()]
        plain = lambda cited: F.trim(replaced(cited, CITED))
        citing, by, alone = (plain(F.regexp_extract(s, p, 1)) for p in (CITING, BY, ALONE))
        rest = F.when(s.rlike(DENIED), F.lit("")).when(citing != "", citing).when(by.rlike(only_names()), by).when(alone.rlike(only_names()), alone).otherwise(F.lit(""))
        cited = F.transform(F.regexp_extract_all(rest, F.lit(name_pattern()), F.lit(1)), lambda x: F.try_element_at(of_name, x))
        return F.concat_ws(" ", *known, F.array_distinct(F.filter(cited, lambda x: x.isNotNull())))

    clean = lambda s: replaced(F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")), AFTER)
    # each step once for a sentence: later steps read the array of the step before
    hinted = F.transform(F.filter(sentences, lambda s: s.rlike(HINT)), clean)
    return F.filter(F.transform(hinted, one), lambda x: x != "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, comma between), identifiers (of its sentences, in order), n_sentences (that are known), expressions.

    ``expressions``: those of SPDX tags as they stand, with one space between words, each once, sorted, with semicolons."""
    # a space before each line, so that the first word of a line has one before it as others have
    cut = lambda t: F.split(F.regexp_replace(t, CUT, "$1\n "), "\n")
    joined = F.regexp_replace(F.regexp_replace("_t", r"\n\s*\n", ". "), r"\n\s*", " ")
    lowered = F.lower(text_of())
    tagged = F.transform(F.regexp_extract_all(text_of(), F.lit(EXPRESSION), F.lit(1)), lambda x: F.regexp_replace(x, r"[ \t]+", " "))
    tagged = F.when(F.contains(lowered, F.lit("spdx-license-identifier:")), F.concat_ws(";", F.array_sort(F.array_distinct(tagged)))).otherwise(F.lit(""))
    texts = docs.select("doc_id", F.when(lowered.rlike(HINT), lowered).otherwise(F.lit("")).alias("_t"), tagged.alias("expressions"))
    texts = texts.withColumn("_t", F.when(F.col("_t") != "", replaced(F.col("_t"), BEFORE)).otherwise(F.col("_t")))
    found = texts.select("doc_id", "expressions", identifiers(cut(F.col("_t"))).alias("_lines"), identifiers(cut(joined)).alias("_wrapped"))
    some = F.size("_lines") + F.size("_wrapped") > 0
    chain = [F.concat(F.lit(" "), F.concat_ws(" ", k), F.lit(" ")) for k in ("_lines", "_wrapped")]
    hits = by_licence()
    matched = F.array_compact(
        F.array(*[F.when(F.greatest(*[c.rlike("|".join(map(rule_pattern, some_rules))) for c in chain]), F.lit(licence)) for licence, some_rules in hits.items()])
    )
    found = found.withColumn("_hits", F.when(some, matched).otherwise(F.array().cast("array<string>")))
    stays = [F.when(F.array_contains("_hits", licence) & ~F.arrays_overlap("_hits", F.array(*map(F.lit, more))), F.lit(licence)) for licence in hits if (more := gives_way(licence, hits))]
    yielding = [licence for licence in hits if gives_way(licence, hits)]
    left = F.concat(F.filter("_hits", lambda x: ~x.isin(yielding)), F.array_compact(F.array(*stays)))
    longer = F.when(F.size("_lines") >= F.size("_wrapped"), F.col("_lines")).otherwise(F.col("_wrapped"))
    return found.select(
        "doc_id",
        F.when(some, F.concat_ws(",", F.array_sort(left))).otherwise(F.lit("")).alias("licenses"),
        F.concat_ws(" ", longer).alias("identifiers"),
        F.size(longer).cast("long").alias("n_sentences"),
        "expressions",
    )


def sql() -> str:
    """The same for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def steps(t: str, some: list[tuple[str, str]]) -> str:
        for pattern, by in some:
            t = f"regexp_replace({t}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
        return t

    of_name = "MAP {" + ", ".join(f"{quote(k)}: {quote('N:' + v)}" for k, v in names().items()) + "}"
    cut = lambda t: f"string_split(regexp_replace({t}, {quote(CUT)}, '\\1\n ', 'g'), '\n')"
    clean = steps("trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))", AFTER)
    plain = lambda p: f"trim({steps(f'regexp_extract(s, {quote(p)}, 1)', CITED)})"
    only = lambda t: f"regexp_matches({t}, {quote(only_names())})"
    known = ", ".join(f"CASE WHEN regexp_matches(s, {quote(p)}) THEN {quote('T:' + k)} END" for k, p in SENTENCES.items())
    rest = (
        f"CASE WHEN regexp_matches(s, {quote(DENIED)}) THEN '' WHEN {plain(CITING)} <> '' THEN {plain(CITING)} WHEN {only(plain(BY))} THEN {plain(BY)} "
        f"WHEN {only(plain(ALONE))} THEN {plain(ALONE)} ELSE '' END"
    )
    cited = f"list_filter(list_transform(regexp_extract_all({rest}, {quote(name_pattern())}, 1), lambda x: element_at(names, x)[1]), lambda x: x IS NOT NULL)"
    hits = by_licence()
    matched = ", ".join(
        f"CASE WHEN {' OR '.join(f'regexp_matches({c}, {quote(rule_pattern(w))})' for w in some for c in ('lines_', 'wrapped_'))} THEN {quote(licence)} END" for licence, some in hits.items()
    )
    way = " AND ".join(f"NOT (x = {quote(licence)} AND list_has_any(hits, [{', '.join(map(quote, more))}]))" for licence in hits if (more := gives_way(licence, hits)))
    return f"""
WITH maps AS (SELECT {of_name} AS names),
low AS (
  SELECT doc_id, lower(coalesce(text, '')) AS t,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), {quote(EXPRESSION)}, 1), lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')))), ';') AS expressions
  FROM documents),
clean AS (SELECT doc_id, CASE WHEN regexp_matches(t, {quote(HINT)}) THEN {steps("t", BEFORE)} ELSE '' END AS t FROM low),
two AS (
  SELECT doc_id, 1 AS way, unnest({cut("t")}) AS s, generate_subscripts({cut("t")}, 1) AS i FROM clean WHERE t <> '' UNION ALL
  SELECT doc_id, 2, unnest({cut("u")}), generate_subscripts({cut("u")}, 1)
  FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '\n\\s*\n', '. ', 'g'), '\n\\s*', ' ', 'g') AS u FROM clean WHERE t <> '')),
sentences AS (SELECT doc_id, way, i, {clean} AS s FROM two WHERE regexp_matches(s, {quote(HINT)})),
read_ AS (SELECT doc_id, way, i, list_filter([{known}], lambda x: x IS NOT NULL) AS a, {cited} AS b FROM sentences, maps),
ids AS (
  SELECT doc_id, way, i, array_to_string(a || list_filter(b, lambda x, k: list_position(b, x) = k), ' ') AS id FROM read_ WHERE len(a) + len(b) > 0),
chains AS (
  SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY i) FILTER (WHERE way = 1), '') AS one, coalesce(string_agg(id, ' ' ORDER BY i) FILTER (WHERE way = 2), '') AS two_,
    count(*) FILTER (WHERE way = 1) AS n1, count(*) FILTER (WHERE way = 2) AS n2
  FROM ids GROUP BY doc_id),
found AS (
  SELECT *, list_filter([{matched}], lambda x: x IS NOT NULL) AS hits FROM (SELECT *, ' ' || one || ' ' AS lines_, ' ' || two_ || ' ' AS wrapped_ FROM chains))
SELECT doc_id, coalesce(array_to_string(list_sort(list_filter(hits, lambda x: {way})), ','), '') AS licenses,
  coalesce(CASE WHEN n1 >= n2 THEN one ELSE two_ END, '') AS identifiers, CAST(coalesce(greatest(n1, n2), 0) AS BIGINT) AS n_sentences, coalesce(expressions, '') AS expressions
FROM low LEFT JOIN found USING (doc_id)
"""
