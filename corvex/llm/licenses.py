"""License scan: shingle postings retrieve templates, shingle containment in text windows decides.

DataFrame functions only. Words are runs of letters and digits, lower case; a shingle is SHINGLE words (a
template of fewer is one shingle, which any place of a text may hold). Steps:

1. documents that cannot hold any template are left out: of each template, words are chosen such that a text
   with none of them lacks more than 1 - CONTAINED of its shingles; a text with no chosen word of any
   template is no match for certain;
2. the remaining texts' shingles that occur in some template are kept, with their place, once for each
   template that has them. So each template is retrieved by its own shingles, whatever stands beside it:
   nothing is missed, be the template short, part of a longer one or among others;
3. a window starts at each place of a template's shingles and is SPREAD times the longest template, so what
   is found depends on no offset: an occurrence with words put in counts as long as its ends are less than
   that apart;
4. windows are verified by the exact share of the template's shingles.

Templates are a small fixed table, checked against MOST_TEMPLATES, so they travel as literals and broadcast.

Defined results: null and empty texts match nothing; rows with one id count as one document, whose null is a
value like others; a template found in several windows gives one row, with the best window's share, the first
of equals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
SPREAD = 3
MOST_TEMPLATES = 2000

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_END = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices and bodies as their publishers word them; of bodies of thousands of words, the first ones.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-permission": _MIT,
    "isc-permission": _ISC,
    "bsd-conditions": _BSD,
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means",
    "all-rights-bare": "All rights reserved.",
    "apache-header-end": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-body": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "mit-body": f"{_MIT}. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-body": f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-body": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense-body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl-body": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "cc0-body": "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gpl-2-body": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "gpl-3-body": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "lgpl-2.1-body": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    "lgpl-3-body": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "agpl-3-body": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
}
# At most four shingles each, so no word may be missing: notices of other variants and versions differ by one.
for _k, _t in {"gpl": "General", "lgpl": "Lesser General", "agpl": "Affero General"}.items():
    TEMPLATES[f"{_k}-line"] = f"licensed under the GNU {_t} Public License"
    TEMPLATES |= {f"{_k}-{v}-line": f"GNU {_t} Public License, version {v}" for v in ("2", "2.1", "3")}
for _k, _t in {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}.items():
    TEMPLATES |= {f"cc-{_k}-{v}-line": f"licensed under CC {_k} {v}" for v in ("2.0", "2.5", "3.0", "4.0")}
    TEMPLATES[f"cc-{_k}-4.0-name"] = f"Creative Commons {_t} 4.0 International"
    TEMPLATES |= {f"cc-{_k}-{v}-name": f"Creative Commons {_t} {v}" for v in ("2.0", "2.5", "3.0")}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Structs of pos and shingle; all words are one shingle where they are fewer than SHINGLE."""
    least = 1 if size == SHINGLE else size
    one = lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("shingle"))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), one)
    return F.when(F.size(w) < least, F.array().cast("array<struct<pos:int,shingle:string>>")).otherwise(many)


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles_of(text: str) -> list[str]:
    w = _words_of(text)
    return sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}) if w else []


def telling_words(text: str) -> list[str]:
    """Words of which a text that holds CONTAINED of this one has at least one: long ones first, until the
    shingles with none of them are fewer than CONTAINED of all."""
    left, total, chosen = _shingles_of(text), len(_shingles_of(text)), []
    for w in sorted(set(_words_of(text)), key=lambda w: (-len(w), w)):
        if len(left) < CONTAINED * total:
            break
        rest = [s for s in left if w not in s.split(" ")]
        if len(rest) < len(left):
            chosen, left = [*chosen, w], rest
    return chosen


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and template it contains: doc_id, license_id, n_matched and n_shingles
    (distinct shingles of the template in its best window, and of the template), first_word (the place, from
    0, of the template's first word in that window)."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} can be literals")
    spark: SparkSession = docs.sparkSession
    known = {k: _shingles_of(t) for k, t in templates.items()}
    known = {k: s for k, s in known.items() if s}
    rows = [(k, s, len(ss)) for k, ss in known.items() for s in ss]
    table = spark.createDataFrame(rows, "license_id string, shingle string, n_shingles bigint")
    span = max([len(s) for s in known.values()], default=1)
    telling = sorted({w for k in known for w in telling_words(templates[k])})
    ident = F.col(f"`{id_col}`")
    view = docs.select(ident.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    near = view.where(F.lower("text").rlike("|".join(map(re.escape, telling)) if telling else r"\b\B"))
    split = near.select("doc_id", words(F.col("text")).alias("w"))  # once, not anew for each shingle
    found = [shingles(F.col("w"))]
    short = sorted({s for ss in known.values() for s in ss if s.count(" ") + 1 < SHINGLE})
    for size in sorted({s.count(" ") + 1 for s in short}):  # places of notices of fewer words than a shingle
        found.append(F.filter(shingles(F.col("w"), size), lambda x: x["shingle"].isin(short)))
    places = split.select("doc_id", F.explode(F.concat(*found)).alias("x")).select("doc_id", "x.pos", "x.shingle")
    hits = places.join(F.broadcast(table), "shingle")
    within = W.partitionBy("doc_id", "license_id").orderBy("pos").rangeBetween(0, SPREAD * span - 1)
    n_matched = F.size(F.collect_set("shingle").over(within)).cast("bigint")
    windows = hits.select("doc_id", "license_id", "n_shingles", n_matched.alias("n_matched"), F.col("pos").alias("first_word"))
    good = windows.where(F.col("n_matched") >= CONTAINED * F.col("n_shingles"))
    best = F.max_by(F.struct("n_matched", "first_word"), F.struct("n_matched", -F.col("first_word")))
    return good.groupBy("doc_id", "license_id", "n_shingles").agg(best.alias("x")).select(
        "doc_id", "license_id", F.col("x.n_matched").alias("n_matched"), "n_shingles", F.col("x.first_word").cast("bigint").alias("first_word")
    )
