"""Licence scan by sentence rules (native: DataFrame functions only).

Method. A text is normalised (A-Z lowered, every run of other characters one space) and keeps its
breaks: line feeds and sentence ends. A known licence sentence is found where it begins and ends at a
break; breaks inside it count as spaces, so hard-wrapped texts and "v. 2.0" don't hide it. What is
found gives the document's sequence of sentence identifiers, and each ordered rule that is a
subsequence of it recognises a licence. A rule may overrule less specific ones.

All of it is one projection: no shuffle, and the only state is the fixed table of sentences below.
SQL states the query with the short one-line SENTENCES and RULES alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import ascii_lower, table, without

# Sentences of well-known licences and notices in normalised form.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-title": "mit license",
    "grant-free": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "keep-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-title": "apache license version 2 0",
    "apache-file": "you may not use this file except in compliance with the license",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl3-notice": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3-notice": "this work is licensed under the gnu affero general public license version 3",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc0-notice": "released under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}
# Licence, its sentences in order, the licences that it overrules.
RULES = (
    ("MIT", ("mit-notice",), ()),
    ("MIT", ("mit-title", "grant-free", "keep-notice", "as-is"), ()),
    ("MIT", ("grant-free", "keep-notice"), ()),
    ("Apache-2.0", ("apache-notice",), ()),
    ("Apache-2.0", ("apache-title", "apache-file"), ()),
    ("GPL-2.0", ("gpl2-notice",), ()),
    ("GPL-3.0", ("gpl3-notice",), ()),
    ("GPL", ("gpl-program", "gpl-no-warranty"), ()),
    ("LGPL-3.0", ("lgpl3-notice",), ()),
    ("AGPL-3.0", ("agpl3-notice",), ()),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary"), ()),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse"), ("BSD-2-Clause",)),
    ("MPL-2.0", ("mpl2-notice",), ()),
    ("CC-BY-4.0", ("cc-by-4",), ()),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",), ()),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",), ()),
    ("CC0-1.0", ("cc0-notice",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("proprietary", ("all-rights",), ()),
)
_SUBJECTS = ("program", "library", "software", "file", "package")
_GPL = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license "
_FSF = "as published by the free software foundation"
_LATER = " or at your option any later version"


def _versions(kind: str, version: str) -> tuple[str, ...]:
    """The grant of a GNU licence with its version, in the usual wordings."""
    ways = (f"{_FSF} either version {version} of the license{_LATER}", f"{_FSF} version {version} of the license", f"version {version} {_FSF}", f"{_FSF} version {version}")
    return tuple(_GPL.format(x, kind) + way for x in _SUBJECTS for way in ways)


#: The complete standard wordings of the sentences above, and more sentences of the same licences; * is 1 to 16 words.
FULL = {
    "grant-free": (
        SENTENCES["grant-free"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        SENTENCES["grant-free"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    "keep-notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "as-is": (
        SENTENCES["as-is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        SENTENCES["as-is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement",
    ),
    "mit-title": ("the mit license", "the mit license mit", "mit license mit"),
    "mit-notice": ("licensed under the mit license", "this project is licensed under the mit license"),
    "apache-notice": ("licensed under the apache license version 2 0 the license", "the asf licenses this file to you under the apache license version 2 0 the license"),
    "apache-title": ("apache license version 2 0 january 2004",),
    "gpl-program": tuple(_GPL.format(x, "") + end for x in _SUBJECTS for end in ("", _FSF)),
    "gpl2-program": _versions("", "2"),
    "gpl3-program": _versions("", "3"),
    "lgpl21-program": _versions("lesser ", "2 1"),
    "lgpl3-program": _versions("lesser ", "3"),
    "agpl3-program": _versions("affero ", "3"),
    "gpl-no-warranty": tuple(f"this {x} is distributed in the hope that it will be useful but without any warranty{end}" for x in _SUBJECTS for end in ("", " without even the implied warranty of merchantability or fitness for a particular purpose")),
    "bsd-source": (SENTENCES["bsd-source"] + " this list of conditions and the following disclaimer",),
    "bsd-binary": (SENTENCES["bsd-binary"] + " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": (
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of * nor the names of * contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "mpl2-notice": ("this source code form is subject to the terms of the mozilla public license version 2 0",),
    # Titles and opening sentences of whole legal texts.
    "apache-terms": ("terms and conditions for use reproduction and distribution",),
    "gpl1-title": ("gnu general public license version 1 february 1989",),
    "gpl2-title": ("gnu general public license version 2 june 1991",),
    "gpl3-title": ("gnu general public license version 3 29 june 2007",),
    "lgpl2-title": ("gnu library general public license version 2 june 1991",),
    "lgpl21-title": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3-title": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3-title": ("gnu affero general public license version 3 19 november 2007",),
    "gfdl-title": tuple(f"gnu free documentation license version {v}" for v in ("1 1 march 2000", "1 2 november 2002", "1 3 3 november 2008")),
    "fsf-copies": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "mpl11-title": ("mozilla public license version 1 1",),
    "mpl2-title": ("mozilla public license version 2 0",),
    "mpl-definitions": ("definitions",),
    "cc0-title": ("cc0 1 0 universal", "creative commons cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    "cc0-purpose": ("statement of purpose",),
    "artistic-title": ("the artistic license", "the artistic license 2 0", "artistic license 2 0"),
    "artistic-preamble": ("preamble",),
    "isc-title": ("isc license", "the isc license", "isc license iscl"),
    "isc-grant": tuple(
        f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("or ", "")
    ),
    "hpnd-grant": tuple(
        f"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies{end}"
        for end in ("", " and that both that copyright notice and this permission notice appear in supporting documentation")
    ),
    "psf-title": ("python software foundation license version 2", "psf license agreement for python *"),
    "psf-agreement": ("terms and conditions for accessing or otherwise using python",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    **{f"cc-{short}-4": tuple(f"this work is licensed under {a}creative commons {long} 4 0 international license" for a in ("a ", "the ")) for short, long in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"))},
}
_WHOLE = ("MIT", "BSD-2-Clause", "BSD-3-Clause")
#: RULES and those over FULL; "all rights reserved" above a whole text's conditions doesn't make it proprietary.
FULL_RULES = (
    *[(name, ids, (*less, "proprietary") if name in _WHOLE and len(ids) > 1 else less) for name, ids, less in RULES],
    ("GPL-2.0", ("gpl2-program",), ("proprietary",)),
    ("GPL-3.0", ("gpl3-program",), ("proprietary",)),
    ("LGPL-2.1", ("lgpl21-program",), ("proprietary",)),
    ("LGPL-3.0", ("lgpl3-program",), ("proprietary",)),
    ("AGPL-3.0", ("agpl3-program",), ("proprietary",)),
    ("Apache-2.0", ("apache-title", "apache-terms"), ("proprietary",)),
    ("GPL-1.0", ("gpl1-title", "fsf-copies"), ("proprietary", "GPL")),
    ("GPL-2.0", ("gpl2-title", "fsf-copies"), ("proprietary", "GPL")),
    ("GPL-3.0", ("gpl3-title", "fsf-copies"), ("proprietary", "GPL")),
    ("LGPL-2.0", ("lgpl2-title", "fsf-copies"), ("proprietary", "GPL")),
    ("LGPL-2.1", ("lgpl21-title", "fsf-copies"), ("proprietary", "GPL")),
    ("LGPL-3.0", ("lgpl3-title", "fsf-copies"), ("proprietary", "GPL")),
    ("AGPL-3.0", ("agpl3-title", "fsf-copies"), ("proprietary", "GPL")),
    ("GFDL", ("gfdl-title",), ("proprietary",)),
    ("MPL-1.1", ("mpl11-title", "mpl-definitions"), ("proprietary",)),
    ("MPL-2.0", ("mpl2-title", "mpl-definitions"), ("proprietary",)),
    ("CC0-1.0", ("cc0-title", "cc0-purpose"), ("proprietary",)),
    ("Artistic", ("artistic-title", "artistic-preamble"), ("proprietary",)),
    ("ISC", ("isc-grant",), ("proprietary",)),
    ("HPND", ("hpnd-grant",), ("proprietary",)),
    ("PSF-2.0", ("psf-title",), ("proprietary",)),
    ("PSF-2.0", ("psf-agreement",), ("proprietary",)),
    ("Zlib", ("zlib-grant",), ("proprietary",)),
)


def wordings(sentences: dict) -> dict[str, str]:
    """Wording to identifier, of a table that has one or several wordings by identifier."""
    return {words: name for name, some in sentences.items() for words in ((some,) if isinstance(some, str) else some) if words.strip()}


def hints(known: dict[str, str]) -> str:
    """A pattern of words, one of which each wording has: its longest."""
    found = sorted({max((w for w in words.split() if w != "*"), key=len) for words in known})
    return f"(?<![a-z0-9])(?:{'|'.join(found)})(?![a-z0-9])"


def pattern_of(words: str) -> str:
    """A wording as it stands in a normalised text, whose breaks are line feeds."""
    return "[ \\n]".join("[a-z0-9]+(?:[ \\n][a-z0-9]+){0,15}?" if w == "*" else re.escape(w) for w in words.split())


ALL_SENTENCES = {name: (*((SENTENCES[name],) if name in SENTENCES else ()), *FULL.get(name, ())) for name in SENTENCES | FULL}
#: Texts without one of these have no known sentence.
HINTS = hints(wordings(ALL_SENTENCES))
CUT = r"\n|[.;!?]+(?:[\x20\x09-\x0D]+|$)"
#: Ends of sentences, besides line feeds.
ENDS = r"[.;:!?]+(?=[\x20\x09-\x0D]|$)"
RESULTS = ("sentence_ids", "licenses")


def find_licenses(docs: DataFrame, text_col: str = "text", sentences: dict | None = None, rules=FULL_RULES) -> DataFrame:
    """Add sentence_ids (known sentences in order) and licenses (recognised, sorted), both array<string>.

    `sentences` has one normalised wording, or a tuple of them, by identifier. Null and empty texts
    have none. A sentence that stands twice counts twice; a rule's sentences may have others between
    them; of wordings that begin at one place the longest counts. "All rights reserved" means
    proprietary only where no whole licence is recognised. All input rows and columns stay (those
    named like a result give way), repeated rows each with theirs; an empty table gives an empty
    table; texts of any length are read whole.
    """
    known = wordings(sentences or ALL_SENTENCES)
    rows = without(docs, *RESULTS)
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(text, ENDS, "\n"), "[^a-z0-9\n]+", " ")
    plain = F.btrim(F.regexp_replace(plain, " ?\n[ \n]*", "\n"), F.lit(" \n"))
    order = sorted(known, key=lambda words: (-len(words), words))
    # A number before the sentence is a list's.
    whole = "(?:^|\n)(?:[0-9]{1,2}[ \n])?(" + "|".join(pattern_of(words) for words in order) + ")(?=\n|$)"
    found = F.transform(F.regexp_extract_all(plain, F.lit(whole), F.lit(1)), lambda x: F.translate(x, "\n", " "))
    exact = F.create_map(*[F.lit(x) for words, name in known.items() if "*" not in words for x in (words, name)]) if any("*" not in w for w in known) else None
    wild = [(pattern_of(words), known[words]) for words in order if "*" in words]
    name_of = lambda x: F.coalesce(*([exact[x]] if exact is not None else []), *[F.when(x.rlike(f"^(?:{like})$"), F.lit(name)) for like, name in wild])
    ids = F.filter(F.transform(found, name_of), lambda i: i.isNotNull())
    found = rows.withColumn("sentence_ids", F.when(text.rlike(hints(known)), ids).otherwise(F.array().cast("array<string>")))
    # Each identifier stands between two bars, so a rule's sentences in order are a LIKE pattern.
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    hit = {i: line.like("".join(f"%|{name}|" for name in names) + "%") for i, (_, names, _) in enumerate(rules)}
    over = lambda licence: [hit[i] for i, (_, _, less) in enumerate(rules) if licence in less]
    named = []
    for i, (licence, _, _) in enumerate(rules):
        condition = hit[i]
        for stronger in over(licence):
            condition = condition & ~stronger
        named.append(F.when(condition, F.lit(licence)))
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def sql() -> str:
    known = ", ".join(f"('{words}', '{name}')" for name, words in SENTENCES.items())
    cases = []
    for licence, names, _ in RULES:
        test = "line LIKE '" + "".join(f"%|{n}|" for n in names) + "%'"
        for _, other, less in RULES:
            if licence in less:
                test += " AND NOT line LIKE '" + "".join(f"%|{n}|" for n in other) + "%'"
        cases.append(f"CASE WHEN {test} THEN '{licence}' END")
    return rf"""
WITH known(s, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, i, trim(regexp_replace(p[i], '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{CUT}') AS p FROM documents))
), ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, '|' || string_agg(id, '||' ORDER BY i) || '|' AS line FROM parts JOIN known USING (s) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct([{", ".join(cases)}])), ','), '') AS licenses
FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id
"""


SQL = sql()
