"""Unicode scalars that stay in the JVM.

Spark has no NFC/NFD function, but it ships ICU4J for its collations; its static
methods take and give plain strings and are reached through ``java_method``, which
must not get nulls.  All functions here give null for null and evaluate their
argument once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMALIZER = "com.ibm.icu.text.Normalizer"
_CHARACTER = "com.ibm.icu.lang.UCharacter"


def _icu(cls: str, method: str, c: Column, flag: bool) -> Column:
    return F.call_function("java_method", F.lit(cls), F.lit(method), c, F.lit(flag))


def _compose(c: Column) -> Column:
    return _icu(_NORMALIZER, "compose", c, False)


def _decompose(c: Column) -> Column:
    return _icu(_NORMALIZER, "decompose", c, False)


def _fold(c: Column) -> Column:
    return _icu(_CHARACTER, "foldCase", c, True)


def _safely(c: Column | str, chain: Callable[[Column], Column]) -> Column:
    """``chain`` over a value that is not null, null otherwise; the value is computed once.

    A named column is cheap to test beside the call.  Any other expression is tagged
    with a digit, which every chain here leaves in front: 0 stands for null.  The calls
    stay outside of lambdas, as Spark moves them below aggregates and joins.
    """
    if isinstance(c, str):
        return F.when(F.col(c).isNotNull(), chain(F.coalesce(F.col(c), F.lit(""))))
    tagged = chain(F.coalesce(F.concat(F.lit("1"), c), F.lit("0")))
    value = F.get(F.filter(F.array(tagged), lambda x: x.startswith("1")), F.lit(0))
    return F.substring(value, 2, 2**31 - 1)


def nfc(c: Column | str) -> Column:
    return _safely(c, _compose)


def nfd(c: Column | str) -> Column:
    return _safely(c, _decompose)


def casefold(c: Column | str) -> Column:
    """Full case folding (final sigma folds to sigma, sharp s to ss)."""
    return _safely(c, _fold)


def caseless(c: Column | str) -> Column:
    """Canonical caseless form: decomposed, folded, decomposed again."""
    return _safely(c, lambda x: _decompose(_fold(_decompose(x))))


def letters_digits_key(c: Column | str) -> Column:
    """What is left, decomposed, when only letters with their marks and digits are kept and case is ignored.

    Letters are compared one by one: final sigma is sigma, but an iota below a letter is not one
    beside it, and sharp s is not ss, as full case folding would have it.
    """
    return _safely(c, lambda x: F.regexp_replace(F.translate(F.lower(_decompose(x)), "ς", "σ"), r"[^\p{L}\p{M}\p{N}]+", ""))


def strip_marks(c: Column | str) -> Column:
    """Drop every nonspacing mark and recompose."""
    return _safely(c, lambda x: _compose(F.regexp_replace(_decompose(x), r"\p{Mn}+", "")))


def strip_pitch_marks(c: Column | str, recompose: bool = True) -> Column:
    """Drop exactly the grave, acute, circumflex and perispomeni marks."""
    marks = "[̀́̂͂]"

    def chain(x: Column) -> Column:
        bare = F.regexp_replace(_decompose(x), marks, "")
        return _compose(bare) if recompose else bare

    return _safely(c, chain)


def trim_blank(c: Column | str) -> Column:
    """Trim blanks of any kind, not only the ASCII space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")
