"""DuckDB SQL fragments used by the oracle queries (independent, brute-force formulations).

The oracles compute the full word-by-word matrices directly (no distinct-word shortcut), so they
check the Spark plans rather than repeat them.

DuckDB's ``levenshtein`` counts bytes while Python and Spark count code points. The texts carry a
few accented letters, so the oracle maps each of them to an ASCII capital (capitals cannot occur
after ``lower``) before measuring; then bytes and code points coincide.
"""

from __future__ import annotations

from triplematch.functions import fixed

# --- fixed values: accented lower-case letters and their one-byte stand-ins (oracle only) ---
ACCENTED = "àâäçèéêëîïôöùûüÿñáíóúßœæ"
STAND_INS = "ABCDEFGHIJKLMNOPQRSTUVWX"

_M, _LOW = fixed.PUNISH_M, fixed.PUNISH_LOW


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def fold(text: str) -> str:
    return f"translate(lower({text}), '{ACCENTED}', '{STAND_INS}')"


def words(text: str) -> str:
    """Lower-cased whitespace words (str.split after lower), accents folded for levenshtein."""
    return f"list_filter(string_split_regex({fold(text)}, '\\s+'), lambda w_: w_ <> '')"


def plain_words(text: str) -> str:
    """Whitespace words without lower-casing or folding."""
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w_: w_ <> '')"


def sim(x: str, y: str) -> str:
    m = f"greatest(length({x}), length({y}))"
    d = f"(CAST({m} - levenshtein({x}, {y}) AS DOUBLE) / {m})"
    return f"((1.0 / (1.0 + exp(-6.0 * {d})) - 0.5) * 2.0)"


def t1(a: str, b: str, tag: str = "") -> str:
    """T1 over two word-list expressions; NULL when either list is empty."""
    x, y = f"x{tag}_", f"y{tag}_"
    k = f"least(len({a}), len({b}))"
    row = f"list_transform({a}, lambda {x}: list_max(list_transform({b}, lambda {y}: {sim(x, y)})))"
    col = f"list_transform({b}, lambda {y}: greatest(0.0, list_max(list_transform({a}, lambda {x}: {sim(x, y)}))))"
    la = f"list_avg(list_slice(list_sort({row}, 'DESC'), 1, {k}))"
    lb = f"list_avg(list_slice(list_sort({col}, 'DESC'), 1, {k}))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN ({la} + {lb}) / 2.0 END)"


def punish(s: str) -> str:
    return (f"(CASE WHEN {s} > {_M!r} THEN ({s} * {dbl(_M - _LOW)} + {dbl((_LOW - 1) * _M)}) / {dbl(_M - 1)} "
            f"ELSE {s} END)")
