"""License scans (operator 1), DataFrame functions only.

The candidates of a file are its lines that can name a licence; of a licence file, known by its name, also its paragraphs,
wrapped lines joined, and its whole text, which counts before its parts where it is like a template. Each becomes a sparse TF-IDF vector over words; idf counts over all candidates of
the corpus and the templates. Its cosine with every template is a sum over shared terms (a join on the term with the
small, fixed template index), and the best template at or above ``threshold`` is the file's own licence. Files without
one inherit: licence files declare a licence for their directory, before headers do, and the nearest ancestor directory
with a declaration decides, up to the root. A licence file with words of no known licence declares that the licence is unknown: it
is ``none`` itself, and so is what would inherit from its directory, unless another licence file there is known. Ancestors are found by joining each directory's path prefixes with the
declaring directories, once per directory and not per file.

Defined cases: null and empty texts have no own licence and inherit. A null path has no ancestors. Cosine ties: the
template first by name. Several declarations in one directory: that of a licence file, then the one most files make, then the higher mean cosine,
then the name. Directories without a declaring ancestor, or below one of unknown
licence, give null licence and ``how`` = ``none``. Repeated rows stay, and rows of one ``file`` with other paths or texts
are files of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

# Names and wording of common licences' headers and files; short licences in full.
GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
NOTICE_MIT = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
LEAD_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
TWO_BSD = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD_BSD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GRANT_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
AS_IS_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = (
    ("0BSD", f"{GRANT_ISC}. {AS_IS_ISC}"),
    ("0BSD", "Zero-Clause BSD License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", GNU_HEADER.format("Affero General Public License", 3)),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", f"{LEAD_BSD} {TWO_BSD} {AS_IS_BSD}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", LEAD_BSD),
    ("BSD-3-Clause", f"{LEAD_BSD} {TWO_BSD} {THIRD_BSD} {AS_IS_BSD}"),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International."),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", GNU_HEADER.format("General Public License", 2)),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", GNU_HEADER.format("General Public License", 3)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", f"{GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {AS_IS_ISC}"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", GNU_HEADER.format("Lesser General Public License", 3)),
    ("MIT", f"{GRANT_MIT} {NOTICE_MIT} {AS_IS_MIT}"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", GRANT_MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT-0", "MIT No Attribution"),
    ("MIT-0", f"{GRANT_MIT.removesuffix(', subject to the following conditions:')}. {AS_IS_MIT}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MS-PL", "Microsoft Public License (Ms-PL)"),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Zlib", "zlib License"),
    ("proprietary", "All rights reserved."),
)
LINE = r"(?i)(licen[sc]|copyright|rights reserved|spdx|permission is hereby|permission to use|permission is granted|redistribution and use|creative commons|public domain|cc0 1|mit no attribution)"
#: Files that state a licence; one of unknown wording states an unknown licence. A notice beside it may state one, too.
LICENSE_FILE = r"(?i)(^|/)((un)?licen[sc]e|copying|notice)([.-][^/]*)?$"
STATES = r"(?i)(^|/)((un)?licen[sc]e|copying)([.-][^/]*)?$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def is_license_file(path: Column) -> Column:
    return F.coalesce(path.rlike(LICENSE_FILE), F.lit(False))


def candidates(text: Column, path: Column) -> Column:
    """The distinct pieces that can name a licence, each with whether it is a licence file's whole text. The cheap test of
    the whole text comes first."""
    flat = lambda t: F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))
    lines = F.transform(F.split(text, "\n"), F.trim)
    parts = F.concat(lines, F.transform(F.split(text, r"\n[ \t\r\f]*\n"), flat))
    able = lambda pieces: F.array_distinct(F.filter(pieces, lambda piece: piece.rlike(LINE)))
    whole = F.array(flat(text))
    as_rows = lambda pieces, whole: F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.lit(whole).alias("whole")))
    found = F.when(is_license_file(path), F.concat(as_rows(F.array_except(able(parts), whole), False), as_rows(able(whole), True))).otherwise(as_rows(able(lines), False))
    return F.when(text.rlike(LINE), found).otherwise(F.expr("cast(array() as array<struct<piece:string,whole:boolean>>)"))


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """``row, license, cosine, whole`` of the best template of each candidate at or above ``threshold``.

    ``files`` has ``row``, ``path`` and ``text``. Equal candidates are scored once, so a header that a third of all files
    carries is one row of the join, and its term statistics are pre-aggregated. From then on a candidate, which can be a
    whole text, is named by its MD5 digest.
    """
    spark = files.sparkSession
    lines = materialize(files.select("row", F.explode(candidates(F.col("text"), F.col("path"))).alias("x")).select("row", "x.piece", "x.whole", F.unhex(F.md5("x.piece")).alias("line")), "license_lines")
    distinct = materialize(lines.groupBy("line").agg(F.count("*").alias("n"), F.first("piece").alias("piece")), "license_distinct")
    known = spark.createDataFrame(list(templates), "license string, template string")
    terms = distinct.select("line", "n", F.explode(words(F.col("piece"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    notices = known.select("license", "template", F.explode(words(F.col("template"))).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))
    total = distinct.agg(F.sum("n").alias("n")).select(F.coalesce("n", F.lit(0)).alias("total"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    n = total.first()["total"]
    idf = F.log((F.lit(n) + 2) / (F.coalesce("df", F.lit(0)) + 1)) + 0.2
    x = terms.join(df, "term").select("line", "term", (F.sqrt("tf") * idf).alias("x"))
    y = notices.join(df, "term", "left").select("license", "template", "term", (F.sqrt("tf") * idf).alias("y"))
    # Dots and norms are sums of rounded decimals, so their order does not matter.
    dec = lambda c: c.cast("decimal(28,12)")
    nx = x.groupBy("line").agg(F.sqrt(F.sum(dec(F.col("x") * F.col("x"))).cast("double")).alias("nx"))
    ny = y.groupBy("license", "template").agg(F.sqrt(F.sum(dec(F.col("y") * F.col("y"))).cast("double")).alias("ny"))
    dot = x.join(F.broadcast(y), "term").groupBy("line", "license", "template").agg(F.sum(dec(F.col("x") * F.col("y"))).cast("double").alias("dot"))  # the templates are a fixed list
    scored = dot.join(nx, "line").join(F.broadcast(ny), ["license", "template"]).select("line", "license", F.round(F.col("dot") / (F.col("nx") * F.col("ny")), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    ranked = scored.groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select("line", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))
    return lines.join(materialize(ranked, "license_best"), "line").select("row", "license", "cosine", "whole")


def scan_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """``file, path, license, cosine, how, declared_in`` of every row of ``files`` (``file, path, text``).

    ``how`` is ``own``, ``inherited`` or ``none``. The own licence of a file with several is the one of highest cosine.
    """
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("\n", F.md5(told("file")), F.md5(told("path")), F.md5(told("text")))))  # equal rows have equal licences
    named = files.select("file", "path", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1).alias("dir"), "text", row.alias("row"))
    best = F.min(F.struct((~F.col("whole")).alias("w"), (-F.col("cosine")).alias("c"), "license")).alias("b")
    own = own_licenses(named, templates, threshold).groupBy("row").agg(best).select("row", F.col("b.license").alias("own"), (-F.col("b.c")).alias("own_cosine"))
    own = materialize(own, "license_own")
    narrow = named.select("file", "path", "dir", "row", F.coalesce(F.col("path").rlike(STATES) & F.col("text").rlike("[A-Za-z0-9]"), F.lit(False)).alias("states"))
    marked = materialize(narrow.join(own, "row", "left"), "license_files")
    # 0: a known licence file, 1: one of unknown licence, 2: headers.
    kind = F.when(F.col("own").isNull(), 1).when(is_license_file(F.col("path")), 0).otherwise(2)
    votes = marked.where("(own is not null or states) and path is not null").groupBy("dir", "own", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("own_cosine").cast("decimal(28,6)")).alias("c"))
    declared = votes.groupBy("dir").agg(F.min(F.struct("kind", (-F.col("n")).alias("n"), (-F.col("c") / F.col("n")).alias("c"), "own")).alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.own").alias("inherited"))
    depth = F.size(F.split("dir", "/"))
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(0), depth), lambda k: F.concat_ws("/", F.slice(F.split("dir", "/"), F.lit(1), k))))
    dirs = marked.where("path is not null").select("dir").distinct().withColumn("ancestor", F.explode(prefixes))
    nearest = dirs.join(declared, "ancestor").groupBy("dir").agg(F.max_by(F.struct(F.col("ancestor"), F.col("inherited")), F.length("ancestor")).alias("near"))
    nearest = materialize(nearest.select("dir", F.col("near.ancestor").alias("declared_in"), F.col("near.inherited").alias("inherited")), "license_dirs")
    out = marked.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull() & ~F.col("states")
    return out.select(
        "file", "path", F.coalesce("own", F.when(inherits, F.col("inherited"))).alias("license"), F.col("own_cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(inherits & F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(inherits, F.col("declared_in")).alias("declared_in"),
    )
