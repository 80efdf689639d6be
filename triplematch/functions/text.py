"""Text and token Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplematch.functions import fixed

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Spark inlines projected expressions into lambda bodies, where they would be re-evaluated for
    every element. Binding through a one-element ``transform`` keeps the work linear.
    """
    return F.transform(F.array(_c(value)), body)[0]


def whitespace_words(text: ColumnOrName) -> Column:
    """``str.split()``: split on runs of Unicode whitespace, no empty tokens."""
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != F.lit(""))


def lower_words(text: ColumnOrName) -> Column:
    """Lower-cased whitespace words, the tokenisation of the triple scorer."""
    return whitespace_words(F.lower(_c(text)))


def space_words(text: ColumnOrName) -> Column:
    """split on runs of the space character only (other whitespace stays inside words)."""
    return F.split(_c(text), " +")


def trim_word(word: ColumnOrName) -> Column:
    """the white space around a word goes, its case stays."""
    return F.trim(_c(word), F.lit(fixed.WHITE_SPACE))


def collapse_spaces(text: ColumnOrName) -> Column:
    """F18 ``preproc``: single spaces between the non-empty space-separated words."""
    return F.array_join(F.filter(F.split(_c(text), " "), lambda w: w != F.lit("")), " ")


def join_elements(elements: ColumnOrName) -> Column:
    """Space-join the elements of one triple (F9 ``bow`` over an array)."""
    return F.array_join(_c(elements), " ")


def triple_words(triple: ColumnOrName) -> Column:
    """Words of one triple as the scorer sees them: joined, lower-cased, whitespace split."""
    return lower_words(F.array_join(_c(triple), " "))


def pseudo_triples(triples: ColumnOrName, text: ColumnOrName) -> Column:
    """When no triple was found, one pseudo-triple holding every word of the text."""
    t = _c(triples)
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, t).otherwise(
        F.array(whitespace_words(F.trim(_c(text))))
    )


def binary_triple(pred: ColumnOrName, args: ColumnOrName) -> Column:
    """Predicate followed by its first two arguments."""
    return F.concat(F.array(_c(pred)), F.slice(_c(args), 1, 2))


def to_binary(pred: ColumnOrName, args: ColumnOrName) -> Column:
    """P5 ``toBinary``: only extractions with exactly two arguments, otherwise empty."""
    a = _c(args)
    return F.when(F.size(a) == 2, F.concat(F.array(_c(pred)), a)).otherwise(F.array().cast("array<string>"))


def all_args_indexed(arg_indices: ColumnOrName) -> Column:
    """P9 ``isContiguous``: every argument carries at least one token index."""
    return F.forall(_c(arg_indices), lambda ix: F.size(ix) > 0)


def ptb_escape(text: ColumnOrName) -> Column:
    out = _c(text)
    for raw, esc in fixed.PTB_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def ptb_unescape(text: ColumnOrName) -> Column:
    out = _c(text)
    for raw, esc in fixed.PTB_ESCAPES:
        out = F.replace(out, F.lit(esc), F.lit(raw))
    return out


def remove_punct(text: ColumnOrName) -> Column:
    """Delete every ASCII punctuation character."""
    return F.regexp_replace(_c(text), fixed.ASCII_PUNCT_CLASS, "")


def sentence_key(sent: ColumnOrName) -> Column:
    """the matching key of a sentence -- spaces removed, PTB unescaped, punctuation removed."""
    return remove_punct(ptb_unescape(F.replace(_c(sent), F.lit(" "), F.lit(""))))


def bow(pred: ColumnOrName, args: ColumnOrName) -> Column:
    """predicate and arguments joined by single spaces."""
    return F.array_join(F.concat(F.array(_c(pred)), _c(args)), " ")


def remove_stopwords(words: ColumnOrName) -> Column:
    """M6: drop English stop words and single ASCII punctuation marks, compared lower-case."""
    # an IN over literals becomes a hash-set lookup (InSet) in the optimizer: O(1) per word
    return F.filter(_c(words), lambda w: ~F.lower(w).isin(*fixed.STOPWORDS_AND_PUNCT))


def element_text(elem: ColumnOrName, kind: str = "string") -> Column:
    """F8: the text of an extraction's element: a string as it is, a ``tuple`` (``struct<text, indices>``) as its trimmed
    text, an ``argument`` (``struct<words, indices>``) as its words joined by single spaces."""
    e = _c(elem)
    if kind == "string":
        return e
    if kind == "tuple":
        return trim_word(e["text"])
    if kind == "argument":
        return F.array_join(e["words"], " ")
    raise ValueError(f"unknown kind of element {kind!r}")


def normalize_element(elem: ColumnOrName) -> Column:
    """``_`` alone means empty; otherwise underscores become spaces."""
    e = _c(elem)
    return F.when(e == "_", F.lit("")).otherwise(F.replace(e, F.lit("_"), F.lit(" ")))


def escape_tabs(text: ColumnOrName) -> Column:
    """a literal tab becomes the two characters backslash-t."""
    return F.replace(_c(text), F.lit("\t"), F.lit("\\t"))


def base_verb(surface_pred: ColumnOrName) -> Column:
    """last space-separated word of the surface predicate."""
    return F.element_at(F.split(_c(surface_pred), " "), -1)


def consolidate_label(label: ColumnOrName) -> Column:
    """``O-anything`` becomes ``O``; other labels are unchanged."""
    lab = _c(label)
    return F.when(lab.startswith("O"), F.split(lab, "-")[0]).otherwise(lab)


def spaced_chars(text: ColumnOrName) -> Column:
    """F24 legacy relation text: the characters of a string separated by spaces."""
    return F.array_join(F.split(_c(text), ""), " ")


def pad_to(arr: ColumnOrName, n: int, pad=0) -> Column:
    """Pad with ``pad`` or truncate to exactly ``n`` elements."""
    a = _c(arr)
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), F.lit(n))), 1, n)


def chunks(arr: ColumnOrName, size: int) -> Column:
    """Consecutive pieces of ``size`` elements, the last one short."""
    a = _c(arr)
    return let(a, lambda v: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(size)),
        lambda start: F.slice(v, start, size),
    ))
