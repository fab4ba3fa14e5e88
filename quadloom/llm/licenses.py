"""License scans by canonical digest lookup."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import map_arrow

#: Licences by identifier, with the names that notices give them (fixed values).
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
#: What a notice says around the name; optional words are in brackets (fixed values).
NOTICES = ("[this work is] licensed under [the] {}", "[this work is] released under [the] {}", "[this work is] distributed under [the] {}", "[this work is] available under [the] {}", "license {}", "spdx license identifier {}", "{}")

#: Full texts short enough to state (fixed values).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_REST = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: The header of the GNU licences: its name, "either version N of the License, or (at your option) any later version".
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
TEXTS = {
    "BSD-2-Clause": BSD_START + BSD_END,
    "BSD-3-Clause": BSD_START + BSD_THIRD + BSD_END,
    "Unlicense": UNLICENSE,
    "Zlib": ZLIB,
    "MIT": MIT,
    "ISC": ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + ISC_REST,
    "0BSD": ISC_GRANT + "." + ISC_REST,
}

#: The long licences as published, one file each, named by identifier.
FOLDER = Path(__file__).parent / "license_texts"
#: Where the terms of such a file end; what follows tells how to apply them and is often left out.
TERMS_END = "END OF TERMS AND CONDITIONS"

#: Equivalent spellings in lower-case text, in this order (fixed values); what holds for Java's and Python's expressions alike.
SPELLINGS = (
    (r"licence", "license"),
    (r"licensor's|licensors'", "licensor"),
    (r"sub-licens", "sublicens"),
    (r"non-infring", "noninfring"),
    (r"non-commercial", "noncommercial"),
    (r"copyright\s+(?:owner|holder)s?", "copyright holder"),
    (r"http://", "https://"),
    (r"\bgnu\s+(?:gpl|general\s+public\s+license)\b|\bgpl\b", "gnu general public license"),
    (r"\bversion\s+(?=\d)|\bver\. ?(?=\d)|\bv\.?\s?(?=\d)", "version "),
)
#: Lines that only name who holds the rights; a wrapped line of a licence may begin with "copyright notice" and the like.
RIGHTS = r"^[^\p{L}\p{N}\n]*(?:copyright\b(?![ \t]*(?:notice|holder|owner|law|licen[cs]e|statement|interest|act|and|or|in|on|to)\b|[ \t]*$)|\(c\)|©|all rights reserved)[^\n]*$"
ENDING_ZERO = r"\b(version \d+) 0\b"


def canonical(text: str) -> str:
    """The canonical form of one unit, as canonical_column has it."""
    s = text.replace("\r", "\n").lower()
    s = re.sub("(?m)" + RIGHTS.replace(r"[^\p{L}\p{N}\n]", r"(?:(?!\n)[\W_])"), "", s)
    for old, new in SPELLINGS:
        s = re.sub(old, new, s)
    s = re.sub(r"(?:(?!\n)[\W_])+", " ", s)
    s = re.sub(ENDING_ZERO, r"\1", s)
    return re.sub(r"\s+", " ", s).strip()


def canonical_column(text: Column) -> Column:
    """Line breaks stay, so that the units can be cut; Java's expressions take \n alone for one, as Python's do."""
    s = F.regexp_replace(F.lower(F.replace(text, F.lit("\r"), F.lit("\n"))), "(?md)" + RIGHTS, "")
    for old, new in SPELLINGS:
        s = F.regexp_replace(s, old, new)
    return F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}\n]+", " "), ENDING_ZERO, "$1")


def _spread(notice: str) -> list[str]:
    """All readings of a notice with and without its words in brackets."""
    if "[" not in notice:
        return [notice]
    before, _, rest = notice.partition("[")
    inner, _, rest = rest.partition("]")
    return [" ".join(f"{before} {x} {after}".split()) for x in (inner, "") for after in _spread(rest)]


def known_texts(folder: str | Path | None = FOLDER) -> dict[str, str]:
    """Canonical form to identifier: notices by rule, the texts stated above, and the files of a folder by name."""
    out = {}
    for ident, names in NAMES.items():
        for name in (*names, ident):
            for notice in NOTICES:
                for reading in _spread(notice):
                    form = canonical(reading.replace("{}", name))
                    if len(form.split()) > 1:
                        out.setdefault(form, ident)
    texts = [*TEXTS.items(), ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER)]
    for short, name, versions in GNU:
        texts += [(f"{short}-{v}" if "." in v else f"{short}-{v}.0", GNU_HEADER.format(name=name, version=v)) for v in versions]
    for path in sorted(Path(folder).iterdir()) if folder else ():
        if path.is_file():
            whole = path.read_text(errors="replace")
            terms, end, _ = whole.partition(TERMS_END)
            texts += [(path.name, whole)] + ([(path.name, terms + end), (path.name, terms)] if end else [])
    for ident, text in texts:
        out[canonical(text)] = ident
        for name in (*NAMES.get(ident, ()), ident):
            for title in (name, f"The {name}"):
                out.setdefault(canonical(f"{title}\n\n{text}"), ident)
    out.pop("", None)
    return out


def known_digests(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, license); as many rows as licences are known, whatever the documents."""
    return spark.createDataFrame([(hashlib.sha256(form.encode()).hexdigest(), ident) for form, ident in sorted(texts.items())], "digest string, license string")


def beginnings(texts: dict[str, str]) -> dict[str, list[int]]:
    """The word counts of the known forms, by their first two words (or one)."""
    out: dict[str, set[int]] = {}
    for form in texts:
        words = form.split()
        out.setdefault(" ".join(words[:2]), set()).add(len(words))
    return {k: sorted(v) for k, v in out.items()}


def units(text: str, known: dict[str, list[int]]) -> Iterator[tuple[int, int, str]]:
    """(first word, end, digest) of every run of whole lines with the first words and the word count of a known form.

    text is canonical with its line breaks; how a licence is broken into lines and paragraphs does not matter.
    """
    words: list[str] = []
    starts = []
    for line in text.split("\n"):
        own = line.split()
        if own:
            starts.append(len(words))
            words += own
    ends = {*starts[1:], len(words)}
    for at in starts:
        for n in {*known.get(" ".join(words[at : at + 2]), ()), *known.get(words[at], ())}:
            if at + n in ends:
                yield at, at + n, hashlib.sha256(" ".join(words[at : at + n]).encode()).hexdigest()


UNIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("digest", T.StringType())])


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licenses (sorted, comma-separated, '' if none), n_hits, whole (the entire text is a licence); one row per distinct doc_id.

    Units of a document are its runs of whole lines, in full: single lines, paragraphs, paragraphs in a
    row and the whole text, whatever its length and blank lines. A unit counts if the digest of its
    canonical form is known; only units with the first words and the word count of a known form are
    hashed, so no other could match. n_hits counts units, one within another included. Rows with one
    doc_id count as one document; null ids are one row. Null and empty texts have no unit; an empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = known_texts() if texts is None else texts
    known = beginnings(texts)
    c = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_column(F.col("text")).alias("c"))
    begins = "(?md)^ ?(?:" + "|".join(re.escape(b).replace(r"\ ", r"\s+") for b in sorted(known)) + r")\b" if known else "(?!)"

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "whole": [], "digest": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(text.split())
            for at, end, digest in units(text, known):
                out["doc_id"].append(doc_id)
                out["whole"].append(at == 0 and end == n)
                out["digest"].append(digest)
        return out

    hits = map_arrow(c.where(F.col("c").rlike(begins)), each, UNIT).join(F.broadcast(known_digests(spark, texts)), "digest")
    # at most one row for each unit of a document; sets before the shuffle
    found = hits.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n_hits"), F.max("whole").alias("whole"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = found.withColumnRenamed("doc_id", "d")
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("whole", F.lit(False)).alias("whole"))
