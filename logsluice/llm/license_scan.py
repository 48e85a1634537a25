"""Licence scans by sentence-rule recognition.

A text is cut into sentences (at . ! ? before white space, but not in "v. 2.0", and at blank lines, commented ones too); a sentence of several lines that is
not known as a whole counts by its lines. Sentences are normalised: lower case, letters and digits alone, one space between. Those in SENTENCES become
their identifiers. The identifiers of a document, in order, are matched against RULES, the more specific first; a rule
that matches takes its identifiers away, so that a shorter rule does not count them again. What is left over shows as unmatched.

All within the row, by built-in functions: no shuffle and no Python on the executors. Texts without any word that
all known sentences need are not cut at all.

Cases: null or empty text has no sentence and no licence; a null doc_id is a document like others; very long texts are read whole,
within their row; other columns, whatever their names, are not looked at; equal rows get equal results; an empty table gives no rows; a
licence that occurs twice is listed once, its sentences are counted each time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import columns

# Sentences of well-known licences and their identifiers, in plain text.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0.": "apache2_ref",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache2_grant",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache2_full",
    "you may not use this file except in compliance with the License.": "apache2_comply",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache2_url",
    "Apache License Version 2.0, January 2004": "apache2_title",
    "Released under the MIT License.": "mit_ref",
    "This project is licensed under the MIT License.": "mit_ref",
    "The MIT License (MIT)": "mit_title",
    "MIT License": "mit_title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit_grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit_notice",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3_ref",
    "GNU General Public License Version 3, 29 June 2007": "gpl3_title",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3_or_later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl2_or_later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gnu_no_warranty",
    "See the GNU General Public License for more details.": "gpl_details",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl3_ref",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl3_ref",
    "Licensed under CC BY-NC 4.0.": "cc_by_nc4_ref",
    "Licensed under CC BY 4.0.": "cc_by4_ref",
    "Licensed under CC BY-SA 4.0.": "cc_by_sa4_ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc_by4_ref",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc_by_sa4_ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc_by_nc4_ref",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0_ref",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd_grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd_source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd_binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd_endorse",
    "Released under the BSD 3-Clause License.": "bsd3_ref",
    "Released under the BSD 2-Clause License.": "bsd2_ref",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2_ref",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc_grant",
    "This is free and unencumbered software released into the public domain.": "unlicense_ref",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache2_as_is",
    "See the License for the specific language governing permissions and limitations under the License.": "apache2_see",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache2_terms",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.": "apache2_copyright_grant",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit_as_is",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit_liability",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "bsd_as_is",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.": "bsd_liability",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.": "gpl3_only",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "gpl2_only",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl2_only",
    "GNU General Public License Version 2, June 1991": "gpl2_title",
    "You should have received a copy of the GNU General Public License along with this program.": "gpl_copy",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl21_or_later",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl3_or_later",
    "GNU Lesser General Public License Version 3, 29 June 2007": "lgpl3_title",
    "GNU Lesser General Public License Version 2.1, February 1999": "lgpl21_title",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl3_or_later",
    "GNU Affero General Public License Version 3, 19 November 2007": "agpl3_title",
    "Mozilla Public License Version 2.0": "mpl2_title",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "zero_bsd_grant",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense_grant",
    "Creative Commons Legal Code CC0 1.0 Universal": "cc0_title",
}
# Licences by the sequence of identifiers that shows them; earlier rules go first.
RULES = [
    ("apache2_title apache2_terms apache2_copyright_grant", "Apache-2.0"),
    ("apache2_full apache2_url apache2_as_is apache2_see", "Apache-2.0"),
    ("apache2_grant apache2_comply apache2_url apache2_as_is apache2_see", "Apache-2.0"),
    ("apache2_grant apache2_comply apache2_url", "Apache-2.0"),
    ("apache2_full apache2_url", "Apache-2.0"),
    ("apache2_full", "Apache-2.0"),
    ("apache2_title", "Apache-2.0"),
    ("apache2_ref", "Apache-2.0"),
    ("mit_title mit_grant mit_notice mit_as_is mit_liability", "MIT"),
    ("mit_grant mit_notice mit_as_is mit_liability", "MIT"),
    ("mit_title mit_grant mit_notice", "MIT"),
    ("mit_grant mit_notice", "MIT"),
    ("mit_title", "MIT"),
    ("mit_ref", "MIT"),
    ("bsd_grant bsd_source bsd_binary bsd_endorse bsd_as_is bsd_liability", "BSD-3-Clause"),
    ("bsd_grant bsd_source bsd_binary bsd_as_is bsd_liability", "BSD-2-Clause"),
    ("bsd_grant bsd_source bsd_binary bsd_endorse", "BSD-3-Clause"),
    ("bsd_grant bsd_source bsd_binary", "BSD-2-Clause"),
    ("bsd3_ref", "BSD-3-Clause"),
    ("bsd2_ref", "BSD-2-Clause"),
    ("gpl3_or_later gnu_no_warranty gpl_details gpl_copy", "GPL-3.0-or-later"),
    ("gpl2_or_later gnu_no_warranty gpl_details gpl_copy", "GPL-2.0-or-later"),
    ("gpl3_only gnu_no_warranty gpl_details gpl_copy", "GPL-3.0-only"),
    ("gpl2_only gnu_no_warranty gpl_details gpl_copy", "GPL-2.0-only"),
    ("gpl3_only gnu_no_warranty gpl_details", "GPL-3.0-only"),
    ("gpl2_only gnu_no_warranty gpl_details", "GPL-2.0-only"),
    ("gpl3_or_later gnu_no_warranty gpl_details", "GPL-3.0-or-later"),
    ("gpl3_or_later", "GPL-3.0-or-later"),
    ("gpl2_or_later gnu_no_warranty gpl_details", "GPL-2.0-or-later"),
    ("gpl2_or_later", "GPL-2.0-or-later"),
    ("gpl3_only", "GPL-3.0-only"),
    ("gpl2_only", "GPL-2.0-only"),
    ("gpl3_title", "GPL-3.0-only"),
    ("gpl2_title", "GPL-2.0-only"),
    ("lgpl21_or_later", "LGPL-2.1-or-later"),
    ("lgpl3_or_later", "LGPL-3.0-or-later"),
    ("agpl3_or_later", "AGPL-3.0-or-later"),
    ("lgpl21_title", "LGPL-2.1-only"),
    ("lgpl3_title", "LGPL-3.0-only"),
    ("agpl3_title", "AGPL-3.0-only"),
    ("gpl3_ref", "GPL-3.0-only"),
    ("lgpl3_ref", "LGPL-3.0-only"),
    ("agpl3_ref", "AGPL-3.0-only"),
    ("cc_by_nc4_ref", "CC-BY-NC-4.0"),
    ("cc_by_sa4_ref", "CC-BY-SA-4.0"),
    ("cc_by4_ref", "CC-BY-4.0"),
    ("cc0_ref", "CC0-1.0"),
    ("mpl2_ref", "MPL-2.0"),
    ("mpl2_title", "MPL-2.0"),
    ("isc_grant", "ISC"),
    ("zero_bsd_grant", "0BSD"),
    ("unlicense_ref unlicense_grant", "Unlicense"),
    ("cc0_title", "CC0-1.0"),
    ("unlicense_ref", "Unlicense"),
]
#: Where a sentence ends: a mark before white space, or a line with nothing but white space and the marks of a comment.
CUT = r"[.!?][ \t\r\n]+|\n[ \t\r#*/;%!-]*\n"
#: The same, but not after the "v." of a version, as in "v. 2.0". No other known sentence is touched: none begins with a digit or ends in "v".
CUT_WHOLE = r"(?:[!?]|(?<!\b[vV])\.|(?<=\b[vV])\.(?![^a-zA-Z0-9]*[0-9]))[ \t\r\n]+|\n[ \t\r#*/;%!-]*\n"
#: One of these is in every known sentence, whatever its case (checked on import).
NEEDED = ["licens", "permission", "redistribut", "copyright", "endorse", "free software", "public domain", "warrant", "liable", "terms and conditions", "free to copy", "legal code"]


#: Any of NEEDED in a text as it stands: the words of one may be a line, or a comment's mark, apart.
ASKED = "(?i)" + "|".join(n.replace(" ", "[^a-zA-Z0-9]+") for n in NEEDED)


def normal(sentence: str) -> str:
    """The same as normalised(), for the table above."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


KNOWN = {normal(s): i for s, i in SENTENCES.items()}
if any(not any(n in s.lower() for n in NEEDED) for s in SENTENCES):
    raise ValueError("a sentence lacks every needed word")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def found(sentence: Column) -> Column:
        whole = F.element_at(known, normalised(sentence))
        lines = F.transform(F.split(sentence, "\n", -1), lambda s: F.element_at(known, normalised(s)))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    return F.array_compact(F.flatten(F.transform(F.split(text, CUT_WHOLE, -1), found)))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, sentence_ids (array, in order), licenses (array, in the order of RULES), unmatched (identifiers that no rule took)."""
    df = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    none = F.array().cast("array<string>")
    asked = F.coalesce(F.col("text").rlike(ASKED), F.lit(False))
    df = df.select("doc_id", F.when(asked, identifiers(F.col("text"))).otherwise(none).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids.split())).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"), none.alias("found"))

    def apply(a: Column, r: Column) -> Column:
        # A gap stays where a rule took something, so that its neighbours don't become a sequence.
        there = F.contains(a["left"], r["ids"])
        return F.when(there, F.struct(F.replace(a["left"], r["ids"], F.lit("|")).alias("left"), F.array_union(a["found"], F.array(r["name"])).alias("found"))).otherwise(a)

    df = df.withColumn("result", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)))
    left = F.regexp_extract_all(F.coalesce(F.col("result.left"), F.lit("")), F.lit("<([^>]+)>"), F.lit(1))
    return df.select("doc_id", "sentence_ids", F.coalesce("result.found", none).alias("licenses"), left.alias("unmatched"))
