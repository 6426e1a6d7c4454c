"""Licence recognition by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, one spelling of equivalent
words, copyright lines dropped, punctuation and white space as single spaces.
The form's SHA-256 is joined to the digests of known licences, so texts match
whole or not at all.  The same is done for single lines, which finds notices in
longer documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import distinct_names, stored

#: (pattern, replacement) in order; both engines' regular expressions read them alike
RULES = (
    (r"\r\n?", "\n"),
    (r"(?:^|\n)[ \t]*(?:#|//|\*|;|--)+", "\n"),
    (r"(?:^|\n)[ \t]*(?:[0-9]+|[a-z])[.)][ \t]", "\n"),
    (r"©|\(c\)", " copyright "),
    # a notice names a year or a holder; a wrapped sentence that goes on with "copyright" is text
    (r"(?:^|\n)[ \t]*(?:all rights reserved|copyright[ \t]+(?:copyright|[0-9]{4}|by[ \t]|[\[<{]))[^\n]*", "\n"),
    (r"licence", "license"),
    (r"sub[ -]license", "sublicense"),
    (r"non[ -]commercial", "noncommercial"),
    (r"cc[ -]by[ -]nc", "cc by nc"),
    (r"&", " and "),
    (r"https?://|www\.", " "),
    (r"merchantibility", "merchantability"),
    (r"organisation", "organization"),
    (r"acknowledgement", "acknowledgment"),
    (r"whilst", "while"),
    (r"[^\pL\pN\n]+", " "),
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: fixed values: (name, whole text or notice line)
KNOWN = (
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _BSD),
    ("BSD-2-Clause", _BSD2 + _BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _BSD3 + _BSD),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is in the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: fixed values: SHA-256 of the canonical form of long licence texts, as operating systems ship them;
#: those with (terms) end with "END OF TERMS AND CONDITIONS"
DIGESTS = (
    ("Apache-2.0", "4331e8194dfa7064e290e377058f3c565064a301aed24e90596a660decf37d38"),
    ("Apache-2.0", "b76001c0162d0eeb87e002fa9115046c8b857a04a818065b73e0c9b75dc299bb"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa"),
    ("GFDL-1.2", "d4883b7193e3fabc42d4906f2a4320b471c7b1ae9ab4062b7c4b41094873dad7"),
    ("GFDL-1.3", "6b9c7a1825a4ff73cd7519240a29edaf5d4e08bde19a89ae3eddf1bde7eb2439"),
    ("GPL-1.0", "d6fc65bff94ef3dffff59ba8ea4469e2f0319934b25554e9d1daee434cfb8eb4"),
    ("GPL-1.0", "e0680dcd6d44a494ffd1b994b55600070b9bc6e43dde99f464055b361169aa4c"),
    ("GPL-2.0", "f2d0892ab74678a6808b5995e4ee498fe14fbcab60225cef4559959e0ab3c218"),
    ("GPL-2.0", "c96bbd300040e473c5c8c1406c85b75af765d5f4035156ef4962ce0c62ac5faa"),
    ("GPL-3.0", "bd734c2f929e3b18625e2b15b6cd69d762f5e87fe7650bb0fa8ded2d41e99310"),
    ("GPL-3.0", "4671d5b2b1066ae8112f48b114054efb01163ffef85367f8994fbc430d73ecd9"),
    ("LGPL-2.0", "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2"),
    ("LGPL-2.0", "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e"),
    ("LGPL-2.1", "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98"),
    ("LGPL-2.1", "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "694bcbe90b47e3c1141f88bbacccdd4fae04fdc715b9a2641a84cf62ca8b0136"),
    ("MPL-2.0", "d6c2a40e54604ed08da4d6b5c22dbdcc73745ec8fd160faa06357ea3790e6f34"),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks: all rules in one pass over the text, for it and its lines alike."""
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def canonical(text: Column) -> Column:
    return _whole(canonical_lines(text))


def _whole(form: Column) -> Column:
    return F.btrim(F.regexp_replace(form, r"[ \n]+", " "))


def _digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def digest(text: Column) -> Column:
    """The canonical form's digest, null where the form is empty."""
    return _digest(canonical(text))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, digest) of the built-in texts."""
    df = spark.createDataFrame(list(KNOWN), "licence string, text string")
    return df.select("licence", digest(F.col("text")).alias("digest")).union(spark.createDataFrame(list(DIGESTS), "licence string, digest string")).distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every text.

    ``known`` has (licence, digest); by default the built-in ones.  Returns a row
    per input row: ``id_col``, licence (of the whole text, or null; the smallest
    name if a digest has several), notices (licences of single lines, sorted, each
    once).  Null, empty and unlike texts have none.  Repeated rows agree; an
    empty table gives an empty result; other columns are ignored.
    """
    known = known if known is not None else known_licences(docs.sparkSession)
    known = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    text = F.col("text")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    form = F.col("form")
    lines = F.array_distinct(F.filter(F.transform(F.split(form, r"\n"), lambda x: _digest(F.btrim(x))), lambda x: x.isNotNull()))
    src = src.select(F.monotonically_increasing_id().alias("rid"), "id", canonical_lines(text).alias("form"))
    rows = stored(src.select("rid", "id", _digest(_whole(form)).alias("whole"), lines.alias("lines")), "digests")
    whole = rows.select("rid", F.col("whole").alias("digest")).filter("digest is not null").join(known, "digest").select("rid", "licence")
    single = rows.select("rid", F.explode("lines").alias("digest")).filter("digest is not null").join(known, "digest").groupBy("rid").agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    out = rows.select("rid", "id").join(whole, "rid", "left").join(single, "rid", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(F.col("id").alias(distinct_names([id_col], ["licence", "notices"])[0]), "licence", F.coalesce("notices", none).alias("notices"))


#: the built-in notices as words, written by hand for the SQL
_NOTICES = (
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("MPL-2.0", "licensed under the mozilla public license version 2 0"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC0-1.0", "this work is in the public domain"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
)


def oracle() -> str:
    """DuckDB SQL of the registered query, by a way of its own: words of the lines that are no notice, respelled as words."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(c: str) -> str:
        lines = rf"string_split(regexp_replace(lower({c}), '\r\n?', chr(10), 'g'), chr(10))"
        bare = rf"list_transform({lines}, lambda x: regexp_replace(regexp_replace(x, '^[ \t]*(#|//|\*|;|--)+', ''), '^[ \t]*([0-9]+|[a-z])[.)][ \t]', ''))"
        notice = r"'^[ \t]*(all rights reserved|(copyright[ \t]+|(©|\(c\))[ \t]*)(copyright|[0-9]{4}|by[ \t]|[\[<{])|(copyright|©|\(c\))[ \t]*(©|\(c\)))'"
        kept = f"array_to_string(list_filter({bare}, lambda x: NOT regexp_matches(x, {notice})), ' ')"
        out = rf"replace(replace(replace(regexp_replace({kept}, 'https?://|www\.', ' ', 'g'), '©', ' copyright '), '(c)', ' copyright '), '&', ' and ')"
        out = rf"array_to_string(regexp_extract_all({out}, '[\p{{L}}\p{{N}}]+'), ' ')"
        for old, new in (("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("whilst", "while")):
            out = f"replace({out}, '{old}', '{new}')"
        return out

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN if len(t) > 200)
    notices = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in _NOTICES)
    digests = ", ".join(f"({quote(n)}, {quote(d)})" for n, d in DIGESTS)
    return rf"""
WITH known AS (
  SELECT min(n) AS licence, digest FROM (
    SELECT n, sha256({form('t')}) AS digest FROM (VALUES {values}) v(n, t)
    UNION ALL SELECT n, sha256(t) FROM (VALUES {notices}) v(n, t)
    UNION ALL SELECT n, d FROM (VALUES {digests}) v(n, d)) GROUP BY digest),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
whole AS (SELECT rid, licence FROM (SELECT rid, {form('text')} AS f FROM docs) JOIN known ON sha256(f) = digest WHERE f <> ''),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
single AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT rid, {form('line')} AS f FROM lines) JOIN known ON sha256(f) = digest WHERE f <> '' GROUP BY rid)
SELECT doc_id, licence, coalesce(notices, '') AS notices FROM docs LEFT JOIN whole USING (rid) LEFT JOIN single USING (rid)
"""
