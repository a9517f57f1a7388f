"""Licence scan: whole texts, brought to a canonical form, looked up by digest among known licences.

The canonical form is lower case; lines that only state a copyright ("Copyright (c) 2020 ...", "(c) 2020 ...") or "all
rights reserved" are dropped; equivalent spellings become one; whatever is not a letter or digit becomes one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("https", "http"),
)

_SPACED = [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in EQUIVALENT]
#: Rest of a line that only states a copyright. A mark or year shows that the line isn't of a licence's body ("copyright
#: notice", "(c) You must retain"), or its end does; the words before a later year have no digits ("adopted on 20 December 1996").
_STATED = (
    r"(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©)?[ \t,:]*(?:[0-9]{4}|<year>|\[year\]|\[yyyy\]|\{yyyy\}|<)[^\n]*",
    r"copyright[ \t,:]*(?:\(c\)|©)[^\n]*",
    r"©[^\n]*",
    r"(?:\(c\)[ \t]*)?copyright[ \t,:]+(?:[^\s0-9]+[ \t]+){0,8}[0-9]{4}\b[^\n]*",
    r"\(c\)[ \t]+(?:[^\s0-9]+[ \t]+){1,6}[0-9]{4}[ \t.]*",
    r"(?:\(c\)[ \t]*)?copyright[ \t,:][^\n]*\ball rights reserved\.?[ \t]*",
    r"(?:\(c\)[ \t]*)?copyright[ \t,:]+(?:[^\s]+[ \t]+){1,7}(?:inc|corp|corporation|ltd|llc|gmbh|foundation)\.?[ \t]*",
    r"copyright[ \t,:]+(?:by[ \t]+)?the[ \t]+(?:[^\s]+[ \t]+){1,6}(?:authors|contributors|developers|project|team)\.?[ \t]*",
)
COPYRIGHT = r"(?m)^[ \t*#/;-]*(?:" + "|".join(_STATED) + ")$"
RIGHTS = r"(?m)^[ \t*#/;-]*all rights reserved\.?[ \t]*$"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null stays null."""
    out = F.lower(text)
    for pattern in (COPYRIGHT, RIGHTS):
        out = F.regexp_replace(out, pattern, "")
    # Two spaces between words while spellings are replaced: neighbours don't share one.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, MARKS, "  ")), F.lit(" "))
    for old, new in _SPACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, texts: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of licence texts; by default of KNOWN."""
    rows = spark.createDataFrame(list(KNOWN if texts is None else texts), "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id) per row of docs; license_id is null unless the whole text is a known licence.

    If several known ids have one digest, the smallest is given, so rows never multiply. A null text has a null digest and
    no licence; a text without letters or digits has the digest of the empty text, which no licence has. Repeated rows and
    null ids are kept as they are. Other columns are not read. Only digests are joined; the planner broadcasts the known
    ones if they are small and otherwise splits hot digests.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col).cast("string")), 256).alias("digest"))
    names = known.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    empty = F.sha2(F.lit(""), 256)
    return own.join(names.where(F.col("digest") != empty), "digest", "left").select("doc_id", "digest", "license_id")


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Public licence texts; one-line notices stand for themselves.
LICENSES = {
    "MIT": f"MIT License\n\nCopyright (c) <year> <copyright holders>\n\n{_MIT}",
    "MIT-body": _MIT,
    "BSD-2-Clause": f"Copyright (c) <year> <owner>\n\n{_BSD_HEAD}{_BSD_TAIL}",
    "BSD-3-Clause": f"Copyright (c) <year> <owner>\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}",
    "ISC": f"Copyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}",
    "0BSD": f"Copyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_TAIL}",
    "Zlib": "Copyright (c) <year> <owner>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}
#: Titles that short licences are shipped under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "MIT", "License: MIT", "(The MIT License)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', 'The BSD 2-Clause "Simplified" License', "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD-2-Clause", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "The 3-Clause BSD License", "BSD-3-Clause", "BSD License", "The BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)", "Zlib"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0)"),
}
#: Full texts in the folder `licenses`.
TEXTS = ("Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
LICENSES |= {x: files("millrace.llm").joinpath("licenses", f"{x}.txt").read_text("utf-8") for x in TEXTS}


def variants(name: str, text: str) -> list[str]:
    """A text as it is shipped: under its usual titles, without numbers before its clauses, without what follows its terms."""
    bodies = [text]
    if name == "MIT":
        bodies = [_MIT]
    elif name == "CC0-1.0":
        bodies.append(text[text.index("CREATIVE COMMONS CORPORATION") :])
    elif name == "BSL-1.0":
        bodies.append(text.partition("\n")[2])
    elif name == "ISC":
        bodies.append(text.replace("and/or distribute", "and distribute"))
    elif name.startswith("BSD-"):
        bodies.append(re.sub(r"(?m)^[0-9]\. ", "* ", text))
    elif "END OF TERMS AND CONDITIONS" in text:
        head = text.partition("END OF TERMS AND CONDITIONS")[0]
        bodies += [head, f"{head}END OF TERMS AND CONDITIONS"]
    if name == "Unlicense":
        bodies.append(text.partition("For more information")[0])
    return [text, *(f"{title}\n\n{body}" for title in ("", *TITLES.get(name, ())) for body in bodies if title or name != "MIT")]


#: (id, text) of every form; an id stands once for each of its forms.
KNOWN = [(name, form) for name, text in LICENSES.items() for form in dict.fromkeys(variants(name, text))]


def canonical_sql(column: str) -> str:
    """The canonical form in DuckDB's SQL."""
    out = f"lower({column})"
    for pattern in (COPYRIGHT, RIGHTS):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{MARKS}', '  ', 'g'), ' ') || ' '"
    for old, new in _SPACED:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(replace({out}, '  ', ' '), ' ')"
