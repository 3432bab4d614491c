import math
import random
import re
from collections import Counter

from attest.llm.licences import FURTHER, TEMPLATES, TERM, THRESHOLD, agreeing, licences, may_be_near, speaks, template_weights
from pyspark.sql import functions as F

APACHE, MIT, GPL = ("Licensed under the Apache License, Version 2.0.", "released under the mit license",
                    "<p>This work is licensed under the GNU General Public License, version 3.</p>")


def scan(spark, rows):
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'c' AS licence", "1 AS score")
    got = licences(files, F.col("path"), F.coalesce(F.col("path").rlike("/LICENSE$"), F.lit(False)), "doc_id", "text").collect()
    return sorted(((r.doc_id, r.licence, r.how, r.licence_path) for r in got), key=str)


def test_own_inherited_and_none(spark):
    rows = [(1, "r/LICENSE", "Title\n" + APACHE), (2, "r/a/b/c.txt", "plain"), (3, "r/a/LICENSE", MIT), (4, "r/ax/c.txt", "plain"),
            (5, "r/a/d.txt", "text\n" + GPL + "\nmore"), (6, "other/x.txt", "license? what a licence this may well be nobody here knows"),
            (7, "r/a/none.txt", None), (8, None, MIT), (9, "top", ""), (10, "z/y/LICENSE", "no words of it"), (11, "z/y/f", "f")]
    assert scan(spark, rows) == sorted([
        (1, "Apache-2.0", "own", "r/LICENSE"), (2, "MIT", "inherited", "r/a/LICENSE"), (3, "MIT", "own", "r/a/LICENSE"),
        (4, "Apache-2.0", "inherited", "r/LICENSE"), (5, "GPL-3.0", "own", "r/a/d.txt"), (6, None, "none", None),
        (7, "MIT", "inherited", "r/a/LICENSE"), (8, "MIT", "own", None), (9, None, "none", None), (10, None, "none", None),
        (11, None, "none", None)], key=str)


def test_ties_repeats_long_and_empty(spark):
    rows = [(1, "a/LICENSE", MIT), (1, "a/LICENSE", MIT), (1, "a/LICENSE", APACHE), (2, "a/x", "word " * 60_000), (None, "a/y", "\n" * 1000)]
    assert scan(spark, rows) == sorted([
        (1, "MIT", "own", "a/LICENSE"), (1, "MIT", "own", "a/LICENSE"), (1, "Apache-2.0", "own", "a/LICENSE"),
        (2, "Apache-2.0", "inherited", "a/LICENSE"), (None, "Apache-2.0", "inherited", "a/LICENSE")], key=str)
    assert scan(spark, []) == []


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"


def test_notices_without_the_word_licence(spark):
    rows = [(1, "b/LICENSE", "Copyright 2019 Google Inc. All rights reserved.\n" + BSD), (2, "b/x", "plain"), (3, "m/LICENSE", GRANT),
            (4, "m/x", "plain"), (5, "n/LICENSE", BSD.upper())]
    assert scan(spark, rows) == sorted([
        (1, "BSD-3-Clause", "own", "b/LICENSE"), (2, "BSD-3-Clause", "inherited", "b/LICENSE"), (3, "MIT", "own", "m/LICENSE"),
        (4, "MIT", "inherited", "m/LICENSE"), (5, "BSD-3-Clause", "own", "n/LICENSE")], key=str)


def test_bound_keeps_all_that_is_near(spark):
    rng, (weights, idf, other), near = random.Random(1), template_weights(TEMPLATES, FURTHER), set()
    for _ in range(20_000):
        words = re.findall(r"\S+", rng.choice([*TEMPLATES, *FURTHER])[1])
        passage = " ".join(rng.sample(words, rng.randint(1, len(words))) + rng.choices(["the", "some", "words"], k=rng.randint(0, 2)))
        x = {t: n * idf.get(t, other) for t, n in Counter(re.findall(TERM, passage.lower())).items()}
        norm, dots = math.sqrt(sum(v * v for v in x.values())), Counter()
        for i, _, t, w in weights:
            dots[i] += x.get(t, 0) * w
        if norm and round(max(dots.values()) / norm, 6) >= THRESHOLD:
            near.add(passage)
    assert len(near) > 5_000
    table = spark.createDataFrame([(p,) for p in near], "passage string")
    assert table.where(may_be_near(F.col("passage"), weights, THRESHOLD)).count() == len(near)
    fits = table.where(F.size(agreeing(F.col("passage"), F.lit("version 2.1"))) > 0)
    assert fits.count() > 1_000 and fits.where(~speaks(F.col("passage"))).count() == 0


def test_families_and_versions(spark):
    wanted = [
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"), ("GNU General Public License, version 2.", "GPL-2.0"),
        ("GNU General Public License, version 3.", "GPL-3.0"), ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("GNU Affero General Public License, version 3", "AGPL-3.0"), ("CC BY-SA 4.0", "CC-BY-SA-4.0"), ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY 3.0.", None), ("Licensed under the Apache License, Version 1.1.", None), ("Released under the ISC License.", "ISC"),
        ("Released under the Zlib License.", None), ("Licensed under the Eclipse Public License, Version 2.0.", None),
        ("Some rights reserved.", None), (BSD, "BSD-3-Clause"),
        (BSD + "\n1. Redistributions of source code must retain\n2. Redistributions in binary form must reproduce", "BSD-2-Clause"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\n"
         "as published by the Free Software Foundation; either version 2 of the License", "GPL-2.0"),
        *[(text, licence) for licence, text in TEMPLATES]]
    got = scan(spark, [(i, f"{i}/LICENSE", text) for i, (text, _) in enumerate(wanted)])
    found = {i: licence for i, licence, *_ in got}
    assert [(t, found[i]) for i, (t, _) in enumerate(wanted)] == wanted


APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */

int main() { return 0; }
"""
LGPL_HEADER = """/*
 * A small library.
 *
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
"""


def test_whole_files_and_headers_of_several_lines(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A Person\n\n" + GRANT.replace(", free", ",\nfree") + "\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    wanted = [(APACHE_FILE, "Apache-2.0"), (GPL_FILE, "GPL-3.0"), (MPL_HEADER, "MPL-2.0"), (LGPL_HEADER, "LGPL-2.1"), (mit, "MIT"),
              ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by the Free Software\n# Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
              ("MIT is a university.", None), ("MIT", None), ("\n" * 50_000 + GPL_FILE + "\n *" * 50_000, "GPL-3.0"), ("<p>" + GPL_FILE.replace("\n", "<br>") + "</p>", "GPL-3.0")]
    got = scan(spark, [(i, f"{i}/LICENSE", text) for i, (text, _) in enumerate(wanted)])
    found = {i: licence for i, licence, *_ in got}
    assert [(t[:40], found[i]) for i, (t, _) in enumerate(wanted)] == [(t[:40], li) for t, li in wanted]
