"""License scan by sentences: known sentences become identifiers, identifier sequences become licenses.

A text is cut into sentences, each sentence is lower-cased and reduced to words of ASCII
letters and digits, and sentences that are known are replaced by their identifier. The
identifiers of a text, in order, are then matched against an ordered list of rules; a
rule that matches takes its identifiers away from the later, less specific rules. Only
DataFrame functions are used, row by row, so the scan needs no shuffle.

``with_licenses`` cuts at every line end and has its SQL. ``with_wrapped_licenses`` knows
more sentences and finds them across the line ends of a paragraph, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Normalised sentences of public licenses, by identifier.
SENTENCES = {
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIsMit",
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "this project is licensed under the apache license version 2 0": "Apache2Ref",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "this work is licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "this program is free software": "FreeSoftware",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 3 of the license or at your option any later version": "Version3Plus",
    "either version 2 of the license or at your option any later version": "Version2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "licensed under the bsd 2 clause license": "Bsd2Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under the creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4Ref",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "CcBySa4Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "all rights reserved": "AllRights",
}

# Licenses and their identifier sequences, the more specific first.
RULES = (
    ("MIT", ("MitTitle", "MitGrant", "MitNotice", "AsIsMit")),
    ("MIT", ("MitGrant", "MitNotice", "AsIsMit")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-2.0", ("Apache2Ref", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Apache2Ref", "ApacheComply")),
    ("GPL-3.0-or-later", ("FreeSoftware", "GplTerms", "Version3Plus", "GplHope")),
    ("GPL-3.0-or-later", ("FreeSoftware", "GplTerms", "Version3Plus")),
    ("GPL-2.0-or-later", ("FreeSoftware", "GplTerms", "Version2Plus", "GplHope")),
    ("GPL-2.0-or-later", ("FreeSoftware", "GplTerms", "Version2Plus")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("ISC", ("IscGrant",)),
    ("MIT", ("MitRef",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("Unlicense", ("UnlicenseRef",)),
    ("MIT", ("MitTitle",)),
)

_CC_NAMES = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
_CC_KINDS = {"4 0": "international", "3 0": "unported"}
_GRANTS = ("licensed under", "released under", "available under", "distributed under", "this work is licensed under", "this project is licensed under")


def _cc_sentences() -> dict[str, str]:
    out = {}
    for code, name in _CC_NAMES.items():
        for version, kind in _CC_KINDS.items():
            full = f"creative commons {name} {version}"
            names = [f"cc {code} {version}", *(f"{the}{full}{tail}" for the in ("", "a ", "the ") for tail in ("", f" {kind}", " license", f" {kind} license"))]
            if "noncommercial" in full or "noderivatives" in full:
                names += [n.replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives") for n in names[1:]]
            ref = "Cc" + code.title().replace(" ", "") + version.split()[0] + "Ref"
            out |= {f"{grant} {n}": ref for grant in _GRANTS for n in names}
    zero = ("cc0", "cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license", "creative commons zero v1 0 universal", "the creative commons zero license")
    return out | {f"{grant} {n}": "Cc0Ref" for grant in (*_GRANTS, "dedicated to the public domain under") for n in zero}


def _gnu_sentences() -> dict[str, str]:
    """Notices that put a comma, or nothing, before the version, which makes one sentence of two."""
    out = {}
    for name, code, versions in (("general", "Gpl", "23"), ("lesser general", "Lgpl", "23"), ("affero general", "Agpl", "3")):
        terms = f"you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation"
        out[terms] = f"{code}Terms"
        for v in versions:
            full = "2 1" if code == "Lgpl" and v == "2" else v
            out[f"{terms} either version {full} of the license or at your option any later version"] = f"{code}{v}PlusTerms"
            out[f"{terms} version {full} of the license"] = out[f"{terms} version {full}"] = f"{code}{v}OnlyTerms"
    return out | {"either version 2 1 of the license or at your option any later version": "Version21Plus"}


#: What ``with_wrapped_licenses`` knows besides; "/" stands for a cut within a sentence.
WRAPPED_SENTENCES = SENTENCES | {s: i for s, i in (_cc_sentences() | _gnu_sentences()).items() if s not in SENTENCES} | {
    "this source code form is subject to the terms of the mozilla public license v/2 0": "Mpl2Ref",
}

WRAPPED_RULES = (
    *((f"{name}-{version}-or-later", ("FreeSoftware", f"{code}{v}PlusTerms", *hope)) for hope in (("GplHope",), ()) for name, code, v, version in (("GPL", "Gpl", "3", "3.0"), ("GPL", "Gpl", "2", "2.0"), ("LGPL", "Lgpl", "3", "3.0"), ("LGPL", "Lgpl", "2", "2.1"), ("AGPL", "Agpl", "3", "3.0"))),
    *((f"{name}-{version}-or-later", ("FreeSoftware", f"{code}Terms", plus)) for name, code, plus, version in (("LGPL", "Lgpl", "Version3Plus", "3.0"), ("LGPL", "Lgpl", "Version21Plus", "2.1"), ("AGPL", "Agpl", "Version3Plus", "3.0"))),
    *((f"{name}-{version}-only", ("FreeSoftware", f"{code}{v}OnlyTerms")) for name, code, v, version in (("GPL", "Gpl", "3", "3.0"), ("GPL", "Gpl", "2", "2.0"), ("LGPL", "Lgpl", "3", "3.0"), ("LGPL", "Lgpl", "2", "2.1"), ("AGPL", "Agpl", "3", "3.0"))),
    *RULES,
    *((f"CC-{code.upper().replace(' ', '-')}-{version.replace(' ', '.')}", ("Cc" + code.title().replace(" ", "") + version[0] + "Ref",)) for code in _CC_NAMES for version in _CC_KINDS if (code, version) not in (("by", "4 0"), ("by sa", "4 0"))),
    ("CC0-1.0", ("Cc0Ref",)),
)


def _tag(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def sentences(text: Column) -> Column:
    """Normalised sentences: cut at line ends and after ``. ; : ! ?`` before white space."""
    cut = F.split(F.regexp_replace(text, r"([.;:!?])[ \t\r]+", "$1\n"), "\n")
    clean = lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))
    return F.transform(cut, clean)


def license_ids(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; none for a null text.

    A sentence is first looked up in a hash set, so only a known one is searched for in the map.
    """
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    ids = F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.when(s.isin(*known), F.try_element_at(table, s)))
    return F.filter(ids, lambda i: i.isNotNull())


def matched_rules(ids: Column, rules=RULES) -> Column:
    """Licenses whose rules match the identifier sequence, in the order of the rules, each once."""
    start = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(_tag(seq)).alias("seq")) for name, seq in rules))
    first = F.struct(start.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["seq"], F.lit("|"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    return F.array_distinct(F.aggregate(table, first, step, lambda s: s["found"]))


def with_licenses(documents: DataFrame, text: str = "text", known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """Add sentence_ids and licenses (arrays of strings) to every row.

    Null, empty and license-free texts have two empty arrays. Texts are read whole; rows
    that repeat get equal answers; columns of these two names are replaced.
    """
    out = documents.withColumn("sentence_ids", license_ids(F.col(text), known))
    none = F.array().cast("array<string>")
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, matched_rules(F.col("sentence_ids"), rules)).otherwise(none))


def _marked(text: Column) -> Column:
    """Words of a text with one mark between lines (``|``), sentences (``/``) and paragraphs (``#``), else a space."""
    plain = F.translate(text, _UPPER + "|/#", _LOWER + "   ")
    cut = F.regexp_replace(F.regexp_replace(plain, r"[.;:!?]+(?=\s)", "/"), r"\r?\n", "|")
    clean = F.regexp_replace(cut, "[^a-z0-9|/]+", " ")
    ends = F.regexp_replace(F.regexp_replace(clean, r" ?\|(?: ?\|)+ ?", "#"), " ?/[ /|]*", "/")
    return F.regexp_replace(ends, r" ?([|#/]) ?", "$1")


def _pattern(known: dict[str, str]) -> str:
    """Known sentences by first word, the longest first, whole between marks; a line may end at any of their spaces."""
    rest: dict[str, list[str]] = {}
    for s in sorted(known, key=lambda s: (-len(s), s)):
        word, *more = s.split(" ", 1)
        rest.setdefault(word, []).append("".join(f" {m}" for m in more).replace(" ", "[ |]"))
    one = "|".join(f"{word}(?:{'|'.join(own)})" for word, own in rest.items())
    return f"(?<![a-z0-9 ])(?:{one})(?![a-z0-9 ])"


def wrapped_license_ids(text: Column, known: dict[str, str] = WRAPPED_SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, wrapped or on a line of their own."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    found = F.regexp_extract_all(F.trim(_marked(F.coalesce(text, F.lit("")))), F.lit(_pattern(known)), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, "|", " ")))


def with_wrapped_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """``with_licenses`` with the larger vocabulary and sentences that run over line ends of a paragraph."""
    out = documents.withColumn("sentence_ids", wrapped_license_ids(F.col(text)))
    none = F.array().cast("array<string>")
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, matched_rules(F.col("sentence_ids"), WRAPPED_RULES)).otherwise(none))


def oracle(known: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """DuckDB SQL for doc_id, sentence_ids, licenses (comma-joined) and n_sentences of ``documents``."""
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in known.items()) + "}"
    steps = [
        f"r{k} AS (SELECT * REPLACE (replace(rest, '{_tag(seq)}', '|') AS rest, CASE WHEN contains(rest, '{_tag(seq)}') THEN list_append(found, '{name}') ELSE found END AS found) FROM r{k - 1})"
        for k, (name, seq) in enumerate(rules, 1)
    ]
    return f"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.;:!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS cut FROM documents),
    n AS (SELECT doc_id, list_transform(cut, lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))) AS clean FROM s),
    k AS (SELECT {table} AS known),
    i AS (SELECT doc_id, list_filter(list_transform(clean, lambda x: known[x]), lambda x: x IS NOT NULL) AS ids FROM n, k),
    r0 AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', ''), '') AS rest, []::VARCHAR[] AS found FROM i),
    {", ".join(steps)},
    u AS (SELECT *, list_filter(found, lambda x, p: list_position(found, x) = p) AS once FROM r{len(rules)})
    SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(once, ',') AS licenses, len(ids)::BIGINT AS n_sentences FROM u"""
