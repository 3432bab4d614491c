"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor folder.

Built-in functions only. The passages of a text are its lines, its paragraphs and, if it is short, the whole of it. Only
texts and passages that show a family of licences, which a match has to, are looked at, each different one once; of
those a proven bound drops what shares too little with all templates. The few that are left are written, and their terms
meet the templates' weights in a join with a table of fixed size. A folder's licence is that of its licence files;
folders, not files, are joined with their ancestors, so the rows that are repeated are at most the depth of a path for
each different folder.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.session import written

THRESHOLD = 0.6
TAG = "<[^>]*>"
#: Between paragraphs: a line without a letter or digit, such as an empty one or the frame of a comment.
BLANK = r"\n[^A-Za-z0-9]*\n"
#: Characters of a text that is compared as a whole too, at most: short licence files.
WHOLE_CHARS = 4_000
LINE = r"\n[^A-Za-z0-9]*"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Notices, by licence. The customary words of each.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright is waived: public domain, CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
]


# What two customary short licences say.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_PROVIDED = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'

#: More notices, which take the terms' inverse frequencies from those above, so that these keep their scores.
FURTHER = [
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *[(f"LGPL-{v}", f"This work is licensed under the GNU Lesser General Public License, version {v.removesuffix('.0')}.") for v in ("2.1", "3.0")],
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    *[(f"{li}-{v}", f"SPDX-License-Identifier: {li}-{v}{end}") for li, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))
      for end in ("", "-only", "-or-later")],
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    *[(f"CC-{li}-4.0", f"Licensed under CC {li} 4.0.") for li in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    *[(li, f"GNU {kind} License Version {v}") for li, kind, v in (
        ("GPL-2.0", "General Public", "2, June 1991"), ("GPL-3.0", "General Public", "3, 29 June 2007"),
        ("LGPL-2.1", "Lesser General Public", "2.1, February 1999"), ("LGPL-3.0", "Lesser General Public", "3, 29 June 2007"),
        ("AGPL-3.0", "Affero General Public", "3, 19 November 2007"))],
    *[(li, f"This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version.")
      for li, what, sign, kind, comma, v in (("LGPL-2.1", "library", ";", "Lesser", ";", "2.1"), ("LGPL-3.0", "library", ":", "Lesser", ",", "3"), ("AGPL-3.0", "program", ":", "Affero", ",", "3"))],
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "The MIT License"), ("MIT", _GRANT), ("MIT", f"MIT License Copyright (c) {_GRANT} {_KEEP} {_AS_IS}"),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {_FORMS} {_SOURCE} {_BINARY} {_PROVIDED}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {_FORMS} {_SOURCE} {_BINARY} {_NAMES} {_PROVIDED}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *[(li, f"SPDX-License-Identifier: {li}") for li in ("MPL-2.0", "BSD-2-Clause", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0")],
]


def _word(*words: str) -> str:
    return f"(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:$|[^a-z0-9])"


def _version(v: str) -> str:
    return rf"(?:^|[^0-9.]){re.escape(v.removesuffix('.0'))}{r'(?:[.]0)?' if v.endswith('.0') else ''}(?:$|[^0-9.]|[.](?:$|[^0-9]))"


_GNU, _LESSER, _AFFERO = r"general public licen[cs]e|(?:^|[^a-z])[al]?gpl", r"lesser|library general|lgpl", r"affero|agpl"
_SENTENCE, _TWO, _ADVERTISING = "redistribution and use in source and binary forms", "@two-clauses", "@advertising"
_CC = {"nc": rf"(?:{_word('nc')}|non-?commercial)", "sa": rf"(?:{_word('sa')}|share-?alike)", "nd": rf"(?:{_word('nd')}|no-?deriv)"}


def _commons(*parts: str) -> list[tuple[list[str], list[str]]]:
    has = [f"(?:{_word('cc')}|creative commons)", f"(?:{_word('by')}|attribution)", _version("4.0")]
    return [(has + [_CC[p] for p in parts], [p for k, p in _CC.items() if k not in parts])]


#: What a passage in lower case (after it, marks of its whole text) has to show of a licence's family and version: one
#: of several pairs of patterns that are all there and patterns of which none is.
AGREES = {
    "Apache-2.0": [(["apache", _version("2.0")], [])],
    "MIT": [(["licen[cs]e|permission", f"(?:{_word('mit')}|permission is hereby granted)"], ["mit-0", "no attribution", "person or organization", "font software"])],
    "BSD-2-Clause": [(["bsd.?2|2.clause|two.clause|simplified bsd"], [_ADVERTISING]), ([_SENTENCE, _TWO], [_ADVERTISING])],
    "BSD-3-Clause": [([f"bsd.?3|3.clause|three.clause|{_SENTENCE}"], [_TWO, _ADVERTISING, "2.clause"])],
    "GPL-2.0": [([_GNU, _version("2.0")], [_LESSER, _AFFERO])],
    "GPL-3.0": [([_GNU, _version("3.0")], [_LESSER, _AFFERO]), ([_GNU, "free software"], [_LESSER, _AFFERO, "version [0-9]"])],
    "LGPL-2.1": [([_LESSER, _version("2.1")], [])],
    "LGPL-3.0": [([_LESSER, _version("3.0")], [])],
    "AGPL-3.0": [([_AFFERO, _version("3.0")], [])],
    "MPL-2.0": [([f"mozilla|{_word('mpl')}", _version("2.0")], [])],
    "ISC": [([f"{_word('isc')}|permission to use, copy, modify"], [])],
    "CC-BY-4.0": _commons(), "CC-BY-NC-4.0": _commons("nc"), "CC-BY-SA-4.0": _commons("sa"), "CC-BY-ND-4.0": _commons("nd"),
    "CC-BY-NC-SA-4.0": _commons("nc", "sa"), "CC-BY-NC-ND-4.0": _commons("nc", "nd"),
    "CC0-1.0": [(["cc0"], [])], "proprietary": [(["all rights reserved"], [])],
}
_GNU_VERSION = "either (version [0-9.]*[0-9]) of the"
_BINARY_FORM, _NO_NAMES = "redistributions in binary form must", r"neither\s+the\s+name|endorse\s+or\s+promote"
_MATERIALS = "all advertising materials"


def text_marks(text: Column) -> Column:
    """What of a whole text counts for its passages: a version of the GNU licence, clauses of the BSD licence."""
    low = F.lower(text)
    clauses = low.rlike(_BINARY_FORM) & ~low.rlike(_NO_NAMES)
    return F.concat_ws(
        " ", F.regexp_extract(low, _GNU_VERSION, 1), F.when(clauses, F.lit(_TWO)), F.when(low.rlike(_MATERIALS), F.lit(_ADVERTISING)))


def agreeing(passage: Column, marks: Column) -> Column:
    """The licences whose family and version the passage agrees with."""
    seen = F.concat_ws(" ", F.lower(passage), marks)

    def shows(ways: list[tuple[list[str], list[str]]]) -> Column:
        each = [reduce(and_, [seen.rlike(p) for p in has] + [~seen.rlike(p) for p in lacks]) for has, lacks in ways]
        return reduce(or_, each)

    return F.array_compact(F.array(*[F.when(shows(ways), F.lit(li)) for li, ways in AGREES.items()]))


def template_weights(templates: list[tuple[str, str]] = TEMPLATES, further: list[tuple[str, str]] = ()) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight of unit length), the terms' inverse frequencies, and that of any other term."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    seen = Counter(term for c in counts for term in c)
    idf = {term: math.log((1 + len(templates)) / (1 + n)) + 1 for term, n in seen.items()}
    rows, other = [], math.log(1 + len(templates)) + 1
    counts += [Counter(re.findall(TERM, text.lower())) for _, text in further]
    idf |= {term: other for c in counts for term in c if term not in idf}
    for i, ((licence, _), c) in enumerate(zip([*templates, *further], counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, licence, term, n * idf[term] / norm) for term, n in c.items()]
    return rows, idf, other


#: Of each licence one pattern that a passage itself has to show; a text without any has no licence.
FAMILIES = sorted({has[0] for ways in AGREES.values() for has, _ in ways})


def speaks(text: Column) -> Column:
    """Whether a text shows a family of licences at all."""
    return text.rlike(f"(?i)(?:{'|'.join(FAMILIES)})")


def _least(threshold: float) -> float:
    return max(threshold - 1e-6, 0.0) ** 2


def may_be_near(passage: Column, weights: list[tuple[int, str, str, float]], threshold: float) -> Column:
    """Whether the largest weights of the terms in a passage let it have a rounded cosine of ``threshold`` to a template."""
    largest: dict[str, float] = {}
    for _, _, t, w in weights:
        largest[t] = max(largest.get(t, 0.0), w * w)
    squares = F.create_map(*[F.lit(x) for pair in largest.items() for x in pair])
    terms = F.array_distinct(F.regexp_extract_all(F.lower(passage), F.lit(TERM), F.lit(0)))
    length = F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.coalesce(squares[t], F.lit(0.0)))
    return length >= _least(threshold)


def plain(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "\n")


def in_one_line(text: Column) -> Column:
    """A line's end and what frames the next line become a blank."""
    return F.regexp_replace(text, LINE, " ")


def passages(text: Column) -> Column:
    """The different lines and paragraphs of a text without tags, and the whole of a short one."""
    whole = F.when(F.char_length(text) <= WHOLE_CHARS, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.split(text, "\n"), F.transform(F.concat(F.split(text, BLANK), whole), in_one_line)))


def url_path(url: Column) -> Column:
    """host/path of an address, without a closing slash; null for what is none."""
    return F.nullif(F.rtrim(F.regexp_extract(url, r"^[a-z]+://([^?#]+)", 1), F.lit("/")), F.lit(""))


def parent(path: str) -> str:
    return f"nullif(regexp_extract({path}, '^(.*)/[^/]*$', 1), '')"


def notices(texts: DataFrame, threshold: float) -> DataFrame:
    """``print, licence, score``: the best template of each text of ``print, text`` that has a passage near one."""
    weights, idf, other = template_weights(TEMPLATES, FURTHER)
    table = texts.sparkSession.createDataFrame([(i, li, t, w, idf[t]) for i, li, t, w in weights], "template int, found string, term string, weight double, idf double")
    known = table.select("term", F.col("idf").alias("known")).distinct()
    # A text that many rows have is one row.
    some = texts.withColumn("plain", plain(F.col("text"))).where(speaks(in_one_line(F.col("plain"))))
    some = some.groupBy("print").agg(F.first(F.struct("text", "plain")).alias("t"))
    cut = some.select("print", text_marks(F.col("t.text")).alias("marks"), F.explode(passages(F.col("t.plain"))).alias("passage"))
    cut = written(cut.where(speaks(F.col("passage"))), "passages")
    # A passage goes by a 64-bit hash from here on: its text does not travel with each of its terms.
    name = F.xxhash64("passage").alias("name")
    near = cut.select("passage").distinct().where(may_be_near(F.col("passage"), weights, threshold))
    terms = near.select(name, F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TERM), F.lit(0))).alias("term"))
    terms = terms.groupBy("name", "term").agg(F.count("*").alias("n"))
    terms = written(terms.join(F.broadcast(known), "term", "left").withColumn("w", F.col("n") * F.coalesce("known", F.lit(other))), "terms")
    norms = terms.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    products = terms.join(F.broadcast(table), "term").groupBy("name", "template", "found").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = products.join(norms, "name").select("name", "found", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    scored = scored.where(F.col("cosine") >= threshold)
    scored = scored.groupBy("name", "found").agg(F.max("cosine").alias("cosine"))
    fits = cut.withColumn("name", name).join(scored, "name").where(F.array_contains(agreeing(F.col("passage"), F.col("marks")), F.col("found")))
    best = F.max_by(F.struct("found", "cosine"), F.struct("cosine", F.col("found")))
    return fits.groupBy("print").agg(best.alias("b")).select("print", F.col("b.found").alias("licence"), F.col("b.cosine").alias("score"))


def licences(files: DataFrame, path: Column, licence_file: Column, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, path, licence, score, how, licence_path``: one row for each row of ``files``.

    A text's own licence is the template with the largest cosine to one of its passages (see ``passages``) whose family and version agree
    (ties: the larger name), if at least ``threshold``. Else it has that of the nearest folder above it that holds a licence file with one: the
    licence file with the smallest path (of equal paths the smaller name). ``how`` is own, inherited or none. A null
    text has no own licence, a null path no folder; repeated rows stay; no rows give no rows; other columns are not
    read. Equal texts and passages go by 64-bit hashes.
    """
    rows = files.select(F.col(key).alias("key"), path.alias("path"), licence_file.alias("states"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    found = written(notices(rows.where(F.col("text").isNotNull()).select("print", "text"), threshold), "notices")
    rows = rows.drop("text").withColumn("folder", F.expr(parent("path")))
    own = rows.join(found, "print", "left")
    stated = own.where("states AND licence IS NOT NULL AND folder IS NOT NULL")
    stated = stated.groupBy(F.col("folder").alias("above")).agg(F.min(F.struct("path", "licence", "score")).alias("given"))
    folders = rows.where("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    ancestors = ancestors.select("folder", "depth", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = ancestors.join(stated, "above").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))
    out = own.join(nearest.withColumnRenamed("folder", "held"), F.col("folder") == F.col("held"), "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("key").alias(key), "path", F.coalesce("licence", "given.licence").alias("licence"),
        F.coalesce("score", F.when(F.col("licence").isNull(), F.col("given.score"))).alias("score"), how.alias("how"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("given.path")).alias("licence_path"))


def _values() -> tuple[str, str, float]:
    rows, idf, other = template_weights(TEMPLATES, FURTHER)
    table = ", ".join(f"({i}, '{li}', '{t}', {w!r}::DOUBLE)" for i, li, t, w in rows)
    return table, ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in sorted(idf.items())), other


def _shows(ways: list[tuple[list[str], list[str]]]) -> str:
    return " OR ".join("(" + " AND ".join([f"regexp_matches(seen, '{p}')" for p in has] + [f"NOT regexp_matches(seen, '{p}')" for p in lacks]) + ")" for has, lacks in ways)


_TABLE, _IDF, _OTHER = _values()
_FITS = " ".join(f"WHEN '{li}' THEN {_shows(ways)}" for li, ways in AGREES.items())
LICENCES_SQL = f"""
WITH t(template, found, term, weight) AS (VALUES {_TABLE}), k(term, idf) AS (VALUES {_IDF}),
r AS (SELECT 'page' AS kind, page_id AS id, html AS text, nullif(rtrim(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/'), '') AS path,
             coalesce(regexp_matches(url, '^[a-z]+://[^?#]+/([?#].*)?$'), false) AS states FROM pages
      UNION ALL SELECT 'document', doc_id, text, NULL, false FROM documents),
f AS (SELECT *, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS folder FROM r),
u AS (SELECT DISTINCT text, lower(text) AS low, regexp_replace(text, '{TAG}', chr(10), 'g') AS plain FROM r WHERE text IS NOT NULL),
m AS (SELECT *, concat_ws(' ', regexp_extract(low, '{_GNU_VERSION}', 1),
             CASE WHEN regexp_matches(low, '{_BINARY_FORM}') AND NOT regexp_matches(low, '{_NO_NAMES}') THEN '{_TWO}' END,
             CASE WHEN regexp_matches(low, '{_MATERIALS}') THEN '{_ADVERTISING}' END) AS marks,
             list_concat(regexp_split_to_array(plain, '{BLANK}'), CASE WHEN length(plain) <= {WHOLE_CHARS} THEN [plain] ELSE [] END) AS parts FROM u),
p AS (SELECT DISTINCT text, marks, unnest(list_concat(string_split(plain, chr(10)), list_transform(parts, lambda x: regexp_replace(x, '{LINE}', ' ', 'g')))) AS passage FROM m),
w AS (SELECT passage, term, count(*) AS n FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term
      FROM (SELECT DISTINCT passage FROM p)) GROUP BY ALL),
v AS (SELECT w.*, n * coalesce(idf, {_OTHER!r}) AS x FROM w LEFT JOIN k USING (term)),
norm AS (SELECT passage, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
dot AS (SELECT passage, template, found, sum(x * weight) AS dot FROM v JOIN t USING (term) GROUP BY ALL),
near AS (SELECT passage, found, round(dot / norm, 6) AS cosine FROM dot JOIN norm USING (passage) WHERE round(dot / norm, 6) >= {THRESHOLD}),
fit AS (SELECT text, found, cosine, concat_ws(' ', lower(passage), marks) AS seen FROM p JOIN near USING (passage)),
best AS (SELECT text, max(row(cosine, found)) AS b FROM fit WHERE CASE found {_FITS} END GROUP BY ALL),
own AS (SELECT f.*, b[1] AS score, b[2] AS licence FROM f LEFT JOIN best USING (text)),
stated AS (SELECT folder AS above, min(row(path, licence, score)) AS g FROM own
           WHERE states AND licence IS NOT NULL AND folder IS NOT NULL GROUP BY folder),
nearest AS (SELECT d.folder, arg_max(g, length(above)) AS g FROM (SELECT DISTINCT folder FROM f) d
            JOIN stated ON d.folder = above OR starts_with(d.folder, above || '/') GROUP BY d.folder)
SELECT kind, id, path, coalesce(licence, g[2]) AS licence, CASE WHEN licence IS NULL THEN g[3] ELSE score END AS score,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN licence IS NOT NULL THEN path ELSE g[1] END AS licence_path
FROM own LEFT JOIN nearest USING (folder)
"""
