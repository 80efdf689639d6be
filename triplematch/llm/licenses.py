"""Licence scan by canonical digest lookup. Column functions and one hash join."""

from __future__ import annotations

import functools
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.llm.common import id_text

# Licence id -> names under which notices cite it. Every notice below is made from these by a rule.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT", "Expat License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
}
NOTICES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
           "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}",
           "This software is licensed under the {}", "SPDX-License-Identifier: {}"]

# Whole licence texts short enough to stand here.
MIT_TEXT = (
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.")
ISC_TEXT = (
    "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
# Whole texts: files of this folder, named by licence id (a further wording: id, "_", number).
TEXTS = Path(__file__).with_name("license_texts")
# Further headings of short texts; those of NAMES are used too, with and without "The" and "(id)".
HEADINGS = {"MIT": ["MIT/Expat License", "Expat (MIT) License"],
            "BSD-2-Clause": ["2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License"],
            "BSD-3-Clause": ["3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"],
            "ISC": []}
# The lines of the standard headers that name one licence and version, as they are usually wrapped.
_GPL = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by "
        "the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
_CC = "http://creativecommons.org/licenses/{}/4.0/"
HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\");",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License.",
                   "(the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "http://www.apache.org/licenses/LICENSE-2.0", "http://www.apache.org/licenses/LICENSE-2.0.html",
                   "http://www.apache.org/licenses/LICENSE-2.0.txt"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "License, v. 2.0. If a copy of the MPL was not distributed with this",
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.", "You can obtain one at http://mozilla.org/MPL/2.0/.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["terms of the Eclipse Public License 2.0 which is available at", "https://www.eclipse.org/legal/epl-2.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    **{lic: [_GPL.format(work, a, name, b, version) for work in ("program", "library", "software") for a in ";:" for b in ";,"]
       for lic, name, version in (
           ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
           ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
           ("AGPL-3.0", "Affero General Public License", "3"))},
    **{lic: [f"This work is licensed under {a} {name}.{more}" for a in ("a", "the")
             for more in ("", f" To view a copy of this license, visit {_CC.format(part)}")] + [_CC.format(part)]
       for lic, name, part in (
           ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "by"),
           ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "by-sa"),
           ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "by-nc"))},
    "CC0-1.0": ["http://creativecommons.org/publicdomain/zero/1.0/"],
}
# Addresses that copies of the GNU texts carry.
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
             "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
             "675 Mass Ave, Cambridge, MA 02139, USA", "31 Milk Street #960789 Boston, MA 02196 USA", "<https://fsf.org/>", ""]
# Equivalent spellings: each is replaced by the second form, as a whole word of the canonical text.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
             ("organisation", "organization"), ("authorised", "authorized"), ("noncommercial", "non commercial"),
             ("sharealike", "share alike"), ("copyright owner", "copyright holder"), ("v2", "version 2"),
             ("v3", "version 3"), ("spdx license identifier", "license id")]


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text): notices made by the rule, MIT and ISC. A few hundred rows, fixed; the SQL oracle knows these."""
    rows = [(lic, n.format(name)) for lic, names in NAMES.items() for name in names for n in NOTICES]
    return rows + [("MIT", MIT_TEXT), ("ISC", ISC_TEXT)]


def _parts(text: str, end: str) -> list[str]:
    """The text, and the text up to and with the line that holds ``end``."""
    found = re.search(rf"^.*{end}.*$", text, re.M)
    return [text, text[:found.end()]] if found else [text]


def _wordings(lic: str, text: str) -> list[str]:
    """The usual forms of a whole text: headings, appendices, addresses, numbered or plain clauses."""
    if lic in HEADINGS:
        body = text[re.search(r"^(Permission|Redistribution)", text, re.M).start():]
        bodies = [body, re.sub(r"^\s*[0-9][.)] ", "* ", body, flags=re.M)]
        if lic == "BSD-3-Clause":
            bodies = [re.sub(r"Neither the name of the (copyright holder|University)", f"Neither the name of {who}", b)
                      for b in bodies for who in ("the copyright holder", "the University", "the organization", "the author",
                                                  "the project", "the company", "Google Inc.", "Google LLC")]
            bodies += [re.sub("nor the names of its\\s+contributors\\s+may", "nor the names of\nits contributors may", b).replace(
                "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY THE COPYRIGHT HOLDER AND CONTRIBUTORS") for b in bodies]
        if lic == "ISC":
            bodies.append(body.replace("and/or distribute", "and distribute"))
        names = [*NAMES[lic], *HEADINGS[lic]]
        heads = ["", *names, *(f"The {n}" for n in names), *(f"{n} ({lic})" for n in names), *(f"The {n} ({lic})" for n in names)]
        return [f"{h}\n\n{b}" for b in bodies for h in heads]
    texts = _parts(text, "END OF TERMS AND CONDITIONS")
    texts += [t[:t.rindex("END OF TERMS AND CONDITIONS")] for t in texts[1:]]
    if "GPL" in lic:
        street = r"51\s+Franklin\s+Street,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"
        texts += [re.sub(street, a, t) for t in texts for a in ADDRESSES]
        texts += [t.replace("Lesser General", "Library General") for t in texts if lic == "GPL-2.0"]
    if lic.startswith("CC"):
        starts = [m.start() for m in re.finditer(r"^(CC0 1\.0 Universal|Statement of Purpose|Creative Commons Attribution.*)$", text, re.M)]
        ends = [len(text), *(m.start() for m in re.finditer(r"^=+\s+Creative Commons (is not a party|may be)", text, re.M))]
        texts = [text[a:b] for a in (0, *starts) for b in ends]
    if lic == "MPL-2.0":
        texts += [text[:m.start()] for m in re.finditer(r"^Exhibit [AB] - ", text, re.M)]
    return texts


@functools.cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence id, text): every whole text of the data folder in its usual forms, and the standard header lines."""
    files = [(f.stem.split("_")[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    rows = [(lic, t) for lic, text in [*files, ("MIT", MIT_TEXT), ("ISC", ISC_TEXT)] for t in _wordings(lic, text)]
    rows += [(lic, line) for lic, lines in HEADERS.items() for line in lines]
    rows += [(lic, re.sub("https?://", scheme, t)) for lic, t in rows if "://" in t for scheme in ("http://", "https://")]
    return tuple(dict.fromkeys(rows))


@functools.cache
def _statement() -> str:
    """The lines that a canonical text leaves out: statements of a copyright, with or without a year, and "all rights
    reserved". A line that starts with "copyright" and goes on as a licence text does there ("copyright notice") stays."""
    prose = {w for f in TEXTS.glob("*.txt") for w in re.findall(r"copyright[^\w]+(\w+)", f.read_text(encoding="utf-8").lower())}
    prose = "|".join(sorted(w for w in prose | {"holder", "holders", "notice"} if w.isascii() and w.isalpha()
                            and w not in ("c", "yyyy", "year", "copyright")))
    return (rf"^(copyright|c) .*[0-9]{{4}}|^copyright (c|yyyy|year|by)( |$)|^copyright (?!({prose})( |$))"
            "|^all rights reserved$")


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text: lower case, only letters and digits with single blanks between them,
    equivalent spellings unified, lines that state a copyright or hold nothing left out."""
    t = F.regexp_replace(F.replace(F.lower(text), F.lit("\u00a9"), F.lit(" copyright ")), r"[^\p{L}\p{N}\n]+", " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r" *\n *", " \n "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(_statement()))


def digest_table(spark: SparkSession) -> DataFrame:
    """(digest, license): the canonical digests of the known texts and notices; a fixed table, so it may be broadcast."""
    ids, texts = zip(*known_texts(), *whole_texts())
    known = spark.createDataFrame(pa.table({"license": ids, "text": texts}))
    return (known.select(F.md5(F.concat_ws(" ", canonical_lines(F.col("text")))).alias("digest"), "license")
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, document_license, notices, n_notices.

    The canonical form of the entire text is digested and looked up among the digests of known licence texts:
    ``document_license`` is the licence that the document as a whole is, else null. Each line is a text of its
    own as well: ``notices`` lists the distinct licences (sorted, joined by commas, '' if none) of the lines that
    are a known licence text or notice, ``n_notices`` how many lines are. The known table is fixed (about two
    thousand digests), so it is broadcast and no text is shuffled; per document only hits are aggregated.

    Null and empty texts have no licence. Rows without a doc_id are left out; rows that repeat a doc_id count
    together: their hits add up in one row. Empty input: no rows.
    """
    rows = id_text(docs).select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    known = F.broadcast(digest_table(docs.sparkSession))
    units = rows.select("doc_id", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.md5(F.concat_ws(" ", "lines")).alias("digest"))),
        F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.md5(x).alias("digest"))))).alias("u"))
    hits = units.select("doc_id", "u.whole", "u.digest").join(known, "digest", "left")
    return hits.groupBy("doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("document_license"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_notices"))


def _sql_lines(col: str) -> str:
    t = rf"regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    t = rf"' ' || regexp_replace({t}, ' *\n *', ' ' || chr(10) || ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return (f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' "
            "AND NOT regexp_matches(x, '^(copyright|c) .*[0-9]{4}|^all rights reserved$'))")


def oracle() -> str:
    values = ", ".join("('%s', '%s')" % (a, b.replace("'", "''").replace("\n", "' || chr(10) || '"))
                       for a, b in known_texts())
    return f"""
WITH known(license, text) AS (VALUES {values}),
     k AS (SELECT array_to_string({_sql_lines('text')}, ' ') AS canon, min(license) AS license FROM known GROUP BY 1),
     d AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents WHERE doc_id IS NOT NULL),
     l AS (SELECT doc_id, unnest(lines) AS line FROM d),
     n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n_notices
           FROM l JOIN k ON l.line = k.canon GROUP BY 1)
SELECT d.doc_id, k.license AS document_license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON array_to_string(d.lines, ' ') = k.canon LEFT JOIN n ON d.doc_id = n.doc_id
"""
