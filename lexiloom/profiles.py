"""Language profiles: what tokenising, converting and explaining need to know of a language.

A profile is data plus Column-valued callables, so user extensions stay in the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S


@dataclass(frozen=True)
class LanguageProfile:
    name: str
    to_ipa: Callable[[Column, str], Column]
    inventory: tuple[str, ...]
    vowels: tuple[str, ...]
    dialects: tuple[str, ...] = ("default",)
    tokenizer: Callable[[Column], Column] | None = None
    skeleton_shifts: tuple[Callable[[Column], Column], ...] = ()
    phone_matcher: Callable[[str, str], bool] | None = None
    always_contexts: tuple[str, ...] = ()
    matrix: dict = field(default_factory=dict)

    def tokens(self, ipa: Column | str) -> Column:
        c = F.col(ipa) if isinstance(ipa, str) else ipa
        return self.tokenizer(c) if self.tokenizer else S.tokenize(c, list(self.inventory))


_PROFILES: dict[str, LanguageProfile] = {}


def register(profile: LanguageProfile, replace: bool = False) -> LanguageProfile:
    if profile.name in _PROFILES and not replace:
        raise ValueError(f"profile {profile.name!r} is registered already")
    _PROFILES[profile.name] = profile
    return profile


def get(name: str) -> LanguageProfile:
    try:
        return _PROFILES[name]
    except KeyError:
        raise ValueError(f"no profile {name!r}; there are {sorted(_PROFILES)}") from None


def names() -> list[str]:
    return sorted(_PROFILES)


GREEK = register(
    LanguageProfile(
        "ancient_greek",
        lambda c, dialect: S.to_ipa(c, dialect),
        tuple(S.PHONES),
        tuple(S.VOWELS),
        ("attic", "koine"),
        skeleton_shifts=(S.shift_consonants, S.shift_ss),
    )
)

#: Demonstration profile over lower-case ASCII words: digraphs, then letters.
ASCII_DIGRAPHS = ("th", "sh", "ch", "ph")
ASCII = register(
    LanguageProfile(
        "ascii",
        lambda c, dialect: F.lower(c),
        (*ASCII_DIGRAPHS, *"abcdefghijklmnopqrstuvwxyz"),
        tuple("aeiou"),
        tokenizer=lambda c: S.digraph_tokens(c, ASCII_DIGRAPHS),
    )
)
