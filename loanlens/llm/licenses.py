"""License scans by canonical digest.

A text becomes canonical line by line: lower case, equivalent spellings unified, punctuation to
blanks, copyright lines dropped. The SHA-256 of the whole canonical text is hash-joined to the digests of
the known licences, which are made from their texts by the same expressions. Known texts inside other text are found by
runs: where a line equals the first line of a known text, the digest of as many lines as that text has is looked
up too. So a document that is a licence is found whole, however its lines are broken, and one that carries a licence or a
notice of one or more lines is found by that run.

Each text is read once; its digests, a few per document, are written, and all joins work on them. The known
texts are a small table (``LICENSES``, or the caller's own of ``license_id, text``): their first lines go into the
expression as literals, so a caller's table should hold a few thousand texts at most; ``KNOWN_BYTES`` bounds it.

Extent of ``LICENSES``: full texts of MIT, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Zlib, BSL-1.0 and Unlicense; titles or standard notices of
Apache-2.0, GPL, LGPL, AGPL and MPL-2.0; one-line notices and SPDX lines of some. Changed wordings are not known.

Cases: null text counts as empty; texts without letters or digits match nothing; repeated rows match alike (a
match belongs to id and text); a null doc_id is matched like any other; texts of any length are canonicalised whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import literal_table
from .tables import cut

KNOWN_BYTES = 4 << 20

# Public licence texts and notice sentences, as they stand (without copyright lines).
LICENSES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Apache License
Version 2.0, January 2004"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("GPL-3.0", """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007"""),
    ("GPL-2.0", """GNU GENERAL PUBLIC LICENSE
Version 2, June 1991"""),
    ("LGPL-3.0", """GNU LESSER GENERAL PUBLIC LICENSE
Version 3, 29 June 2007"""),
    ("LGPL-2.1", """GNU LESSER GENERAL PUBLIC LICENSE
Version 2.1, February 1999"""),
    ("AGPL-3.0", """GNU AFFERO GENERAL PUBLIC LICENSE
Version 3, 19 November 2007"""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# Equivalent spellings.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copy right", "copyright"),
             ("noncommercial", "non commercial"))


def canonical_lines(text: Column) -> Column:
    def line(x: Column) -> Column:
        y = F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
        for a, b in SPELLINGS:
            y = F.replace(y, F.lit(a), F.lit(b))
        return y

    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(r"(?i)^\s*(copyright|\(c\)|©)"))
    return F.filter(F.transform(kept, line), lambda x: x != "")


def _sha(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_texts(spark, licenses: DataFrame | None = None) -> DataFrame:
    """(license_id, first line, n_lines, digest) of the known texts."""
    known = licenses if licenses is not None else literal_table(spark, LICENSES, ["license_id", "text"])
    lines = known.select("license_id", canonical_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return lines.select("license_id", F.get("l", F.lit(0)).alias("first"), F.size("l").alias("n_lines"), _sha(F.col("l")).alias("digest")).distinct()


def digests(text: Column, starts: dict[str, list[int]]) -> Column:
    """struct(whole digest or null, digests of runs). A run starts where a line is a key of ``starts`` and has one of its lengths."""
    def both(lines: Column) -> Column:
        whole = F.when(F.size(lines) > 0, _sha(lines))
        if not starts:
            return F.struct(whole.alias("whole"), F.array().cast("array<string>").alias("runs"))
        lengths = F.create_map(*[x for line, n in sorted(starts.items()) for x in (F.lit(line), F.array(*[F.lit(k) for k in sorted(n)]))])
        at = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.try_element_at(lengths, x).alias("n"))), lambda x: x["n"].isNotNull())
        runs = F.flatten(F.transform(at, lambda x: F.transform(x["n"], lambda n: F.when(x["i"] + n <= F.size(lines), _sha(F.slice(lines, x["i"] + 1, n))))))
        return F.struct(whole.alias("whole"), F.array_distinct(F.array_compact(runs)).alias("runs"))

    return F.get(F.transform(F.array(canonical_lines(text)), both), F.lit(0))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text_digest (null without words), license_ids (sorted, comma
    joined, empty if none), n_licenses, and whole (the entire text is a known licence)."""
    spark = docs.sparkSession
    if licenses is not None and (licenses.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > KNOWN_BYTES:
        raise ValueError("the table of known licences is over KNOWN_BYTES")
    known = known_texts(spark, licenses)
    starts: dict[str, list[int]] = {}
    for first, n in sorted({(r["first"], r["n_lines"]) for r in known.collect()}):  # the known texts, bounded above
        starts.setdefault(first, []).append(n)
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("_text"), digests(F.col("text"), starts).alias("_d")))
    unit = F.explode(F.concat(F.transform(F.array_compact(F.array("_d.whole")), lambda x: F.struct(x.alias("digest"), F.lit(True).alias("whole"))),
                              F.transform("_d.runs", lambda x: F.struct(x.alias("digest"), F.lit(False).alias("whole")))))
    units = rows.select("doc_id", "_text", unit.alias("u")).select("doc_id", "_text", "u.*")
    found = (units.join(known.select("license_id", "digest").distinct(), "digest").groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"))
             .agg(F.array_sort(F.collect_set("license_id")).alias("ids"), F.max("whole").alias("is_whole")))
    out = rows.select("doc_id", "_text", F.col("_d.whole").alias("text_digest")).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "text_digest", F.array_join(ids, ",").alias("license_ids"), F.size(ids).cast("long").alias("n_licenses"),
                      F.coalesce("is_whole", F.lit(False)).alias("whole"))
