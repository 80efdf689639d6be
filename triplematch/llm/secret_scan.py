"""Secret scans: an assignment-aware lexer reads name-literal pairs, propagates constants and scores the literals."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import id_text

KINDS = ("assign", "access", "hex", "named")   # the first three are the base rules; "named" is the lexer's own
THRESHOLD = 0.4

# Parts of names that mark a secret, with their weight, and parts that mark something about one.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8,
             "apikey": 0.9, "accesskey": 0.9, "secretkey": 1.0, "privatekey": 1.0, "authkey": 0.9, "signingkey": 0.9,
             "encryptionkey": 0.9, "masterkey": 0.9, "credential": 0.8, "credentials": 0.8, "authorization": 0.8,
             "bearer": 0.8, "auth": 0.6, "signature": 0.5, "salt": 0.5, "key": 0.45, "pin": 0.4, "cookie": 0.4}
HARMLESS = {"path", "file", "dir", "url", "uri", "host", "name", "user", "type", "length", "len", "size", "count", "hint",
            "label", "field", "column", "prompt", "policy", "expiry", "expires", "timeout", "ttl", "public", "regex",
            "min", "max", "limit", "algorithm", "version"}
PLACEHOLDERS = (b"changeme", b"example", b"placeholder", b"your", b"xxxx", b"****", b"dummy", b"redacted", b"null",
                b"none", b"undefined", b"true", b"false", b"insert", b"todo", b"sample", b"....")
#: Words that may stand between a header's name and its credential.
SCHEMES = (b"bearer", b"basic", b"token", b"digest")

# Base rules. The letters of "assign" stand in either case, so it runs over a lower-cased copy (ASCII only, same offsets).
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")           # = the runs of [0-9a-f]+ that have 16 characters or more

# The lexer: one alternative per syntax. A name has 128 characters at most; every repetition is possessive or bounded,
# so the scan is linear in the text.
_QUOTED = rb"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
_PAIR = re.compile(rb"""
    (?<![A-Za-z0-9_$.])(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]{0,127}+)
    (?:["']\]?)?+                                                    # end of a quoted key or a subscript
    (?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.<>\[\]]{0,63}+(?=[ \t]{0,64}=))?+    # a type
    [ \t]*+(?:=>|:=|<-|=(?![=>~])|:(?![:/=]))[ \t]*+
    (?:(?P<quoted>%(q)s(?:[ \t]*+\+?+[ \t]*+%(q)s)*+)                # joined pieces are one literal
     |(?P<scheme>(?i:bearer|basic|token|digest))[ ]++(?P<cred>[^\s"'`,;<>(){}\[\]]++)
     |\$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_.]{0,127}+)\}?
     |(?P<bare>[^\s"'`,;&<>(){}\[\]]++))
  | --(?P<flag>[A-Za-z][A-Za-z0-9\-]{0,63}+)[ ]++(?P<flagvalue>[^\s"'`\-][^\s"'`]*+)
  | <(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]{0,127}+)>(?P<content>[^<>\s]++)</
  | ://[^\s:@/"']{1,128}+:(?P<userinfo>[^\s:@/"']++)@
""" % {b"q": _QUOTED}, re.X)
_PIECE = re.compile(_QUOTED)
_NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.]{0,127}+\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SIGNS = (b":", b"=", b"--", b"</", b"<-")


def sensitivity(name: str) -> float:
    """How much a target name speaks for a secret, 0 to 1: its heaviest part or pair of parts, less what softens it."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    best = max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)
    return max(0.0, best - 0.5 * any(p in HARMLESS for p in parts)) if best else 0.0


def literal_score(value: bytes, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: its information content, none for placeholders and short ones."""
    low = value.lower()
    if len(value) < 8 or any(p in low for p in PLACEHOLDERS) or low[:1] in b"$<{%":
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    score = min(1.0, bits / 48)
    if not any(48 <= c <= 57 for c in value):          # no digit: rather a word, above all when it stands bare
        score *= 0.6 if quoted else 0.3
    if b" " in value:                                  # a sentence
        score *= 0.4
    return score


def pairs(raw: bytes) -> Iterator[tuple[str, int, int, float]]:
    """(target name, literal's start, end, score) of a text's name-literal pairs, in reading order.

    Constants are propagated in reading order: a name that was given a literal stands for that literal from then on,
    so ``k = "..."; password = k`` scores the literal of ``k`` under ``password`` too. The last value given counts.
    """
    if not any(s in raw for s in _SIGNS):
        return
    known: dict[bytes, tuple[int, int, bool]] = {}
    for m in _PAIR.finditer(raw):
        kind = m.lastgroup
        quoted = kind == "quoted"
        name = m["name"] or m["flag"] or m["tag"] or b"password"
        if quoted:
            pieces = list(_PIECE.finditer(raw, *m.span(kind)))
            at = (pieces[0].start() + 1, pieces[-1].end() - 1, True)
            value = b"".join(p[0][1:-1] for p in pieces)
        else:
            value, at = m[kind], (*m.span(kind), False)
        if kind in ("ref", "bare") and _NAME.match(value):
            at = known.get(value, None if kind == "ref" else at)
            if at is None:
                known.pop(name, None)
                continue
            if value in known:
                value, quoted = raw[at[0]:at[1]], at[2]
        if m["name"]:
            known[name] = at
        weight = sensitivity(name.decode())
        if weight:
            yield name.decode(), at[0], at[1], weight * literal_score(value, quoted)


def findings(raw: bytes, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, target name, score) by start, then kind; offsets in bytes, ends exclusive.

    Base rules: every match stays. A literal of the lexer that scores ``threshold`` or more and lies in no base span is
    added once, as ``named``, under the name that scores it highest. Base spans within a scored literal take its name.
    """
    low = raw.lower()
    base: dict[str, list[tuple[int, int]]] = {
        "assign": [m.span() for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 12],
        "access": [m.span() for m in _ACCESS.finditer(raw) if len(m[0]) >= 18],
        "hex": [m.span() for m in _HEX.finditer(raw)]}
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, a, z, s in pairs(raw):
        if s > best.get((a, z), (-1.0, ""))[0]:
            best[a, z] = (s, name)
    target: dict[tuple[int, int], tuple[float, str]] = {}

    def holder(spans: list[tuple[int, int]], a: int, z: int) -> tuple[int, int] | None:
        i = bisect_right(spans, (a, math.inf)) - 1
        return spans[i] if i >= 0 and spans[i][1] >= z else None

    out = []
    literals = sorted(best)
    for (a, z), (s, name) in best.items():
        inside = [h for spans in base.values() if (h := holder(spans, a, z))]
        for h in inside:
            if s > target.get(h, (-1.0, ""))[0]:
                target[h] = (s, name)
        if not inside and s >= threshold:
            out.append(("named", a, z, name, s))
    for kind, spans in base.items():
        for a, z in spans:
            h = holder(literals, a, z)
            s, name = max(target.get((a, z), (0.0, "")), best[h] if h else (0.0, ""))
            out.append((kind, a, z, name or None, s))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def _code_points(raw: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each byte offset; one pass over the text."""
    if raw.isascii():
        return {i: i for i in at}
    head = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, done, n = {}, 0, 0
    for i in sorted(set(at)):
        n += int(np.count_nonzero(head[done:i]))
        out[i], done = n, i
    return out


FINDINGS = "doc_id long, findings array<struct<kind: string, start: long, end: long, name: string, score: double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()),
                             ("score", pa.float64())]))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and its findings (kind, start, end in code points, target name, score), one row per input row with an id.

    Whole texts are read. A null or empty text has no findings; rows that repeat an id are scanned each; rows without
    an id are left out; extra columns change nothing. Constants hold within one document. Row-local, no shuffle; the
    memory of a row is a small multiple of its text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1):
                raw = raw.as_py() or b""
                rows = findings(raw, threshold)
                at = _code_points(raw, [i for f in rows for i in f[1:3]]) if rows else {}
                found.append([{"kind": k, "start": at[a], "end": at[z], "name": n, "score": s} for k, a, z, n, s in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["doc_id", "findings"])

    return id_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, FINDINGS)


def listed(found: Column) -> Column:
    """kind:start:end of findings, comma-joined in their order."""
    return F.concat_ws(",", F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans and the list of all spans, from :func:`scan`'s rows."""
    base = F.filter("findings", lambda f: f["kind"] != "named")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return scanned.select("doc_id", *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"),
                          listed(F.col("findings")).alias("spans"), counts[3])
