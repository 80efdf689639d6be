"""Whole licence texts, their usual headings, standard header lines and copyright lines without a year."""

import textwrap

from triplematch.llm import licenses

NOTICES_ONLY = {"AGPL-3.0", "EPL-2.0", "CC-BY-NC-4.0"}      # as the README says


def whole(lic):
    return (licenses.TEXTS / f"{lic}.txt").read_text(encoding="utf-8")


def found(spark, make_docs, texts):
    got = {r.doc_id: r for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    return [got[i] for i in range(len(texts))]


def test_one_whole_document_per_licence(spark, make_docs):
    ids = sorted(set(licenses.NAMES) - NOTICES_ONLY - {"MIT", "ISC"})
    texts = [whole(lic) for lic in ids] + [licenses.MIT_TEXT, licenses.ISC_TEXT]
    ids += ["MIT", "ISC"]
    indented = ["\r\n".join("// " + line for line in t.split("\n")) for t in texts]
    assert [r.document_license for r in found(spark, make_docs, texts)] == ids
    assert [r.document_license for r in found(spark, make_docs, indented)] == ids
    assert {f.stem.split("_")[0] for f in licenses.TEXTS.glob("*.txt")} | {"MIT", "ISC"} == set(licenses.NAMES) - NOTICES_ONLY
    # one word more is another text
    assert {r.document_license for r in found(spark, make_docs, [t + "\nalso" for t in texts])} == {None}


def test_headings_and_copyright_lines(spark, make_docs):
    body = licenses.MIT_TEXT.split("\n\n", 1)[1]
    rewrapped = "\n\n".join(textwrap.fill(p, 60) for p in body.split("\n\n"))
    bsd = whole("BSD-3-Clause").split("reserved.", 1)[1]
    apache = whole("Apache-2.0")
    texts = ["The MIT License (MIT)\n\nCopyright (c) <holder>\n\n" + body, body, "MIT License\n\nCopyright Jane Doe\n\n" + rewrapped,
             "Copyright © The Authors. All rights reserved.\n" + body, "© Jane Doe\n\n" + body,
             "Copyright (c) 2020, A\nCopyright (c) B\nAll rights reserved.\n" + bsd,
             "The 3-Clause BSD License\n" + bsd.replace("the name of the copyright holder", "the name of Google Inc."),
             apache[:apache.index("APPENDIX")], apache.replace("[yyyy] [name of copyright owner]", "2020 Jane Doe"),
             whole("GPL-2.0").replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
                                      "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")]
    got = [r.document_license for r in found(spark, make_docs, texts)]
    assert got == ["MIT"] * 5 + ["BSD-3-Clause"] * 2 + ["Apache-2.0"] * 2 + ["GPL-2.0"]


def test_standard_header_lines(spark, make_docs):
    texts = ["# Copyright (c) A\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n"
             "# you may not use this file except in compliance with the License.\nimport os",
             "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. */\nint x;",
             "the copyright notice of the License is here"]
    got = [(r.document_license, r.notices, r.n_notices) for r in found(spark, make_docs, texts)]
    assert got == [(None, "Apache-2.0", 1), (None, "MPL-2.0", 1), (None, "", 0)]
