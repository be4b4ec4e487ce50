"""Native text and phone scalars: normalisation keys, tokenisers, script conversion, query parsing.

Everything is a Column expression; nothing here leaves the JVM.  Null gives null unless
a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.unicode import nfc, nfd, strip_marks, strip_pitch_marks, trim_blank

# Greek letters and the phones they stand for.
LETTER_PHONES = {
    "α": "a", "β": "b", "γ": "ɡ", "δ": "d", "ε": "e", "ζ": "zd", "η": "ɛː", "θ": "tʰ", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "ks",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "pʰ", "χ": "kʰ", "ψ": "ps", "ω": "ɔː", "ϝ": "w",
}
DIPHTHONG_PHONES = {"αι": "ai", "ει": "eː", "οι": "oi", "αυ": "au", "ευ": "eu", "ηυ": "ɛːy", "ου": "oː"}
# Phones that occur only in given phone texts, and the vowels.
EXTRA_PHONES = ["f", "aː", "ð", "h", "u", "yː", "x", "ɣ", "θ"]
VOWELS = ["a", "ai", "au", "aː", "e", "eu", "eː", "i", "o", "oi", "oː", "u", "y", "yː", "ɔː", "ɛː", "ɛːy"]
PHONES = sorted({*LETTER_PHONES.values(), *DIPHTHONG_PHONES.values(), *EXTRA_PHONES}, key=lambda p: (-len(p), p))
#: Vowels whose length the script does not mark.
LENGTH_FREE = ["a", "i", "y", "u"]
# The later variety's consonant shifts.
SHIFT_EVERYWHERE = {"pʰ": "f", "tʰ": "θ", "kʰ": "x"}
SHIFT_BETWEEN_VOWELS = {"ɡ": "ɣ", "d": "ð"}
# Letters in Latin transliteration.
LETTER_LATIN = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "ē", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "ō", "ϝ": "w",
}
DIPHTHONG_LATIN = {"αι": "ai", "ει": "ei", "οι": "oi", "υι": "yi", "αυ": "au", "ευ": "eu", "ηυ": "ēu", "ου": "ou"}
# Beta Code letters and marks.
BETA_LETTERS = ("abgdezhqiklmncoprstufxywv", "αβγδεζηθικλμνξοπρστυφχψωϝ")
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "+": "̈", "|": "ͅ"}
#: Markers that make a query a wildcard query (hyphens, dashes, ellipsis, asterisk).
WILDCARDS = "-‐‑‒–—―−﹣－*"
SHORT_QUERY = 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# --- tokenisers -----------------------------------------------------------------


def tokenize(text: Column | str, inventory: list[str] | None = PHONES, marks: bool = True) -> Column:
    """Longest-match phones: blanks are skipped, marks stay with their token, unknown characters are tokens.

    Accent marks are dropped first.  An empty or null inventory gives one token per base character.
    """
    body = "|".join(re.escape(p) for p in sorted(inventory or [], key=lambda p: (-len(p), p)))
    one = f"(?:{body}|\\S)" if body else "\\S"
    text = strip_pitch_marks(text) if marks else _col(text)
    return F.regexp_extract_all(text, F.lit(f"({one}\\p{{Mn}}*)"), 1)


def digraph_tokens(word: Column | str, digraphs: tuple[str, ...] = ("th", "sh", "ch", "ph")) -> Column:
    """The ASCII profile's tokeniser: digraphs first, then letters; anything else is skipped."""
    return F.regexp_extract_all(_col(word), F.lit("(" + "|".join(digraphs) + "|[a-z])"), 1)


def skeleton(tokens: Column | str, vowels: list[str] = VOWELS) -> Column:
    """The tokens that are no vowels, in order, repeats kept."""
    return F.filter(_col(tokens), lambda t: ~t.isin(vowels))


def kmers(tokens: Column | str, k: int) -> Column:
    """Space-joined windows of ``k`` tokens; none if there are fewer."""
    if k <= 0:
        raise ValueError("k must be positive")
    none = F.expr("cast(array() as array<string>)")

    def windows(a: Column) -> Column:
        return F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: F.array_join(F.slice(a, i, F.lit(k)), " "))).otherwise(none)

    return _bind(_col(tokens), windows)  # else the tokens would be computed again for every window


def entry_kmers(tokens: Column | str, k: int, vowels: list[str] = VOWELS, shifts: tuple = ()) -> Column:
    """Distinct k-mers of the skeleton and of the skeletons after each dialect shift."""
    a = _col(tokens)
    parts = [kmers(skeleton(s(a), vowels), k) for s in (lambda x: x, *shifts)]
    return F.array_distinct(F.concat(*parts))


# --- script conversion ----------------------------------------------------------

_ACCENT = "´"


def _marked(text: Column) -> Column:
    """Letters of the decomposed text with what matters of their marks spelt out.

    ``|`` parts a diphthong, ``H`` is rough breathing, ``A`` a long alpha, ``´`` an accent.
    """
    s = F.lower(nfd(text))
    s = F.regexp_replace(s, r"(\p{L})(?=\p{Mn}*̈)", "|$1")
    s = F.regexp_replace(s, r"(?<![αεη][̀-̈́͆-ͯ]{0,6})(υ)(?=\p{Mn}*̔)|([\p{L}&&[^υ]])(?=\p{Mn}*̔)", "H$1$2")
    s = F.regexp_replace(s, r"α(?=\p{Mn}*[̄͂])", "A")
    s = F.regexp_replace(s, r"([\p{L}&&[^H]])(?=\p{Mn}*[̀́̂͂])", f"$1{_ACCENT}")
    return F.regexp_replace(F.replace(s, F.lit("ͅ"), F.lit("ι")), r"\p{Mn}+", "")


def _accented(phone: str) -> str:
    return unicodedata.normalize("NFC", phone[0] + "́" + phone[1:])


def greek_phones(text: Column | str) -> Column:
    """Phones of Greek text: diphthongs first, rough breathing as h, accents kept, unknown characters dropped."""
    plain = LETTER_PHONES | DIPHTHONG_PHONES | {"A": "aː", "H": "h"}
    table = plain | {k + _ACCENT: _accented(p) for k, p in plain.items()}
    a = _ACCENT
    letters = "".join(LETTER_PHONES)
    pattern = f"([αεο]{a}?ι{a}?|[αεηο]{a}?υ{a}?|H|[A{letters}]{a}?)"
    tokens = F.regexp_extract_all(_marked(_col(text)), F.lit(pattern), 1)
    phones = _literal_map(table)
    # an accent on either letter of a diphthong is the diphthong's
    key = F.transform(tokens, lambda t: F.concat(F.replace(t, F.lit(a), F.lit("")), F.when(t.contains(a), a).otherwise("")))
    return F.transform(key, lambda t: F.element_at(phones, t))


def shift_consonants(tokens: Column | str) -> Column:
    """The later variety: aspirates become fricatives, ɡ and d do between vowels."""
    a = _col(tokens)
    every, between = _literal_map(SHIFT_EVERYWHERE), _literal_map(SHIFT_BETWEEN_VOWELS)
    bare = F.transform(a, lambda t: F.regexp_replace(F.translate(t, "áéíóúàèìòùâêîôûýỳŷ", "aeiouaeiouaeiouyyy"), "[̀́̂͂]", ""))

    def one(t: Column, i: Column) -> Column:
        before, after = F.get(bare, i - 1), F.get(bare, i + 1)
        inside = (i > 0) & before.isin(VOWELS) & after.isin(VOWELS)
        return F.coalesce(F.element_at(every, t), F.when(inside, F.element_at(between, t)), t)

    return F.transform(a, one)


def shift_ss(tokens: Column | str) -> Column:
    """s s becomes t t, pair by pair from the left."""
    joined = F.concat(F.lit(" "), F.array_join(_col(tokens), " "), F.lit(" "))
    return F.split(F.trim(F.regexp_replace(joined, " s s(?= )", " t t")), " ")


def to_ipa(text: Column | str, dialect: str = "attic") -> Column:
    """Compact phone text; dialects other than attic and koine raise."""
    if dialect not in ("attic", "koine"):
        raise NotImplementedError(f"dialect {dialect!r} is not supported")
    phones = greek_phones(text)
    return F.array_join(shift_consonants(phones) if dialect == "koine" else phones, "")


def transliterate(greek: Column | str) -> Column:
    """Lower-case Latin: diphthongs first, γ before a velar is n, rough ρ is rh, other rough breathing h."""
    rough, apart = "\x01", "\x02"
    s = F.lower(nfd(greek))
    s = F.regexp_replace(s, r"([^\p{M}])(?=\p{M}*̔)", f"$1{rough}")
    s = F.regexp_replace(s, r"([^\p{M}\x01])(?=\x01?\p{M}*̈)", f"$1{apart}")
    s = F.regexp_replace(F.replace(s, F.lit("ͅ"), F.lit("ι")), r"\p{M}+", "")
    pattern = rf"(?s)(ρ{rough}|γ[γκχξ]|[αεου]{rough}?ι(?!{apart}){rough}?(?!{apart})|[αεηο]{rough}?υ(?!{apart}){rough}?(?!{apart})|[^{apart}]{apart}?{rough}?)"
    tokens = F.regexp_extract_all(s, F.lit(pattern), 1)
    table = dict(LETTER_LATIN)
    table.update({k + rough: "h" + v for k, v in LETTER_LATIN.items()})
    table["ρ" + rough] = "rh"
    table.update({"γ" + x: "n" + LETTER_LATIN[x] for x in "γκχξ"})
    for k, v in DIPHTHONG_LATIN.items():
        table[k] = v
        table.update({x: "h" + v for x in (k[0] + rough + k[1], k + rough, k[0] + rough + k[1] + rough)})
    latin = _literal_map(table)

    def one(t: Column) -> Column:
        t = F.replace(t, F.lit(apart), F.lit(""))
        other = F.concat(F.when(t.contains(rough), "h").otherwise(""), F.replace(t, F.lit(rough), F.lit("")))
        return F.coalesce(F.element_at(latin, t), other)

    return F.array_join(F.transform(tokens, one), "")


#: A capital marker that no Beta Code letter follows.
DANGLING = r"\*(?![)(/\\=+|]*[a-ik-zA-IK-Z])"


def beta_to_unicode(text: Column | str) -> Column:
    """Beta Code to composed Greek: capitals after ``*``, marks after letters, final sigma; a dangling ``*`` raises."""
    marks = r")(/\\=+|"
    s = _col(text)
    dangling = s.rlike(DANGLING)
    s = F.regexp_replace(s, rf"\*([{marks}]*)([a-ik-zA-IK-Z])", "\x01$2$1")
    latin, greek = BETA_LETTERS
    s = F.translate(s, latin + latin.upper(), greek * 2)
    for c in greek:
        s = F.replace(s, F.lit("\x01" + c), F.lit(c.upper()))
    for beta, mark in BETA_MARKS.items():
        s = F.regexp_replace(s, rf"(?<=[α-ωϝΑ-ΩϜ][{marks}̀-ͅ]{{0,7}}){re.escape(beta)}", mark)
    s = F.regexp_replace(s, r"""σ(\p{M}*)(?=\z|[ \t\n\r,.;:!?·;()\[\]{}"'-])""", "ς$1")
    return F.when(dangling, F.raise_error(F.lit("'*' must be followed by a Beta Code letter"))).otherwise(nfc(s))


# --- keys -----------------------------------------------------------------------


def ipa_key(ipa: Column | str) -> Column:
    """Lookup key of a phone text: trimmed, accents dropped, composed."""
    return strip_pitch_marks(F.trim(_col(ipa)))


def base_key(form: Column | str) -> Column:
    """No marks, lower case, lunate sigma folded, sigma final only at the end."""
    s = F.lower(F.translate(strip_marks(form), "ϲϹ", "σΣ"))
    return F.regexp_replace(F.replace(s, F.lit("ς"), F.lit("σ")), r"σ\z", "ς")


# Classes of the spelling alternations, digraphs in the order they fold.
FOLD_DIGRAPHS = (("ει", "I"), ("οι", "I"), ("υι", "I"), ("ῃ", "I"), ("ου", "U"), ("αυ", "A"), ("ευ", "E"), ("ηυ", "E"), ("αι", "E"))
FOLD_LETTERS = ("ηιυεοωακγχπβφτδθσςζμνλρ", "IIIEOOAKKKPPPTTTSSSMNLR")


def collapse(key: Column | str) -> Column:
    """Fold a base key by the alternation classes; doubles made on the way become single."""
    s = F.replace(F.replace(_col(key), F.lit("ξ"), F.lit("κσ")), F.lit("ψ"), F.lit("πσ"))
    s = F.regexp_replace(s, "[μνγ](?=[βγδζθκλμνξπρσςτφχψ])", "N")
    for a, b in FOLD_DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(s, *FOLD_LETTERS), r"(?s)(.)\1+", "$1")


def collapse_key(form: Column | str) -> Column:
    return collapse(base_key(form))


def query_variants(form: Column | str) -> Column:
    """Sorted collapse keys of the query's alternants: movable ν and ς, written-out iota, γν / γιν."""
    base = base_key(form)
    end = F.substring(base, -1, 1)
    cut = F.when(end.isin("ν", "ς"), F.left(base, F.length(base) - 1)).when(end.isin(*"αεηιουω") | (base == ""), F.concat(base, F.lit("ν")))
    one = F.array_compact(F.array(base, cut))
    bare = F.transform(F.filter(one, lambda v: v.rlike("[ωηα]ι$")), lambda v: F.left(v, F.length(v) - 1))
    two = F.concat(one, bare)
    gn = F.transform(F.filter(two, lambda v: v.contains("γν")), lambda v: F.replace(v, F.lit("γν"), F.lit("γιν")))
    gin = F.transform(F.filter(two, lambda v: v.contains("γιν")), lambda v: F.replace(v, F.lit("γιν"), F.lit("γν")))
    return F.array_sort(F.array_distinct(F.transform(F.concat(two, gn, gin), collapse)))


def frequency_key(s: Column | str) -> Column:
    return F.replace(F.lower(F.regexp_replace(nfd(s), r"\p{Mn}+", "")), F.lit("ς"), F.lit("σ"))


def lemma_strict(s: Column | str) -> Column:
    return nfc(F.trim(_col(s)))


def lemma_lenient(s: Column | str) -> Column:
    """Also without homograph digits, accents, breathings, length marks, final sigma and case."""
    bare = F.regexp_replace(nfd(F.regexp_replace(F.trim(_col(s)), r"\d+$", "")), "[̀́͂̈̓̔]", "")
    return F.lower(F.replace(nfc(bare), F.lit("ς"), F.lit("σ")))


# Editorial marks dropped from a transcribed form, the dot below and a private-use mark among them.
EDITORIAL = "\u0323∼∽∤⸢⸣⸤⸥⊢⊣⋰⋱〚〛⟦⟧⸌⸍⸮?!()[]⎴⎵⸜⸝⦑⦒⧼…⁽⁾-~\ue1c0"
LATIN_FOR_GREEK = ("ocABEZHIKMNOPTXY", "οϲΑΒΕΖΗΙΚΜΝΟΡΤΧΥ")


def clean_markup(form: Column | str) -> Column:
    """Inline notes, editorial marks and brackets removed, what they enclose kept; Latin look-alikes repaired, composed."""
    s = F.regexp_replace(_col(form), r"\|[^|]*\|", "")
    s = F.translate(s, EDITORIAL + "<>{}❨❩", "")
    return nfc(trim_blank(F.translate(s, *LATIN_FOR_GREEK)))


def residue(cleaned: Column | str) -> Column:
    """Characters a cleaned form should not hold."""
    return F.array_distinct(F.regexp_extract_all(_col(cleaned), F.lit(r"([^̀-ͯͰ-Ͽἀ-῿ʼ’'])"), 1))


def markup_class(original: Column | str, regular: Column | str) -> Column:
    """abbrev, clean or variant."""
    return (
        F.when(_col(original).rlike("[❨❩]"), "abbrev")
        .when(clean_markup(original) == clean_markup(regular), "clean")
        .otherwise("variant")
    )


def is_capitalised(lemma: Column | str) -> Column:
    return F.coalesce(nfc(lemma).rlike(r"^\P{L}*\p{Lu}"), F.lit(False))


def section_key(section: Column | str) -> Column:
    """Decimal sections without trailing zeros; other texts as they are; blank raises."""
    s = F.trim(_col(section).cast("string"))
    number = s.rlike(r"^[+-]?\d+(\.\d+)?$")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    return F.when((s == "") | (F.lower(s) == "nan"), F.raise_error(F.lit("empty section"))).when(number, F.regexp_replace(plain, r"\.$", "")).otherwise(s)


def cited_sections(reference: Column | str) -> Column:
    """Sections cited singly (``§ 10.1``); ranges are left out."""
    return F.array_distinct(F.regexp_extract_all(_col(reference), F.lit(r"§\s*(\d+(?:\.\d+)*)(?![\d.]*\s*[-–—]\s*\d)(?![\d])"), 1))


def centuries(first_year: Column | str, last_year: Column | str, default: tuple[int, int] = (-3, 8)) -> Column:
    """Signed centuries of a range of years; there is no year 0 and no century 0; no dates give the default window."""
    a, b = _col(first_year).cast("int"), _col(last_year).cast("int")
    a, b = F.coalesce(a, b), F.coalesce(b, a)

    def century(y: Column) -> Column:
        return F.when(y > 0, F.floor((y - 1) / 100) + 1).otherwise(F.ceil((y + 1) / 100) - 1).cast("int")

    lo, hi = F.least(century(a), century(b)), F.greatest(century(a), century(b))
    window = F.sequence(F.coalesce(lo, F.lit(default[0])), F.coalesce(hi, F.lit(default[1])))
    return F.filter(window, lambda c: c != 0)


def log_digest(text: Column | str) -> Column:
    """What logs may show of a query: its length and twelve hex digits of its hash."""
    c = _col(text)
    return F.concat(F.lit("len="), F.length(c).cast("string"), F.lit(" sha256="), F.substring(F.sha2(c, 256), 1, 12))


# --- queries --------------------------------------------------------------------

#: Pattern of a wildcard marker.
MARKER = _MARK = "[" + re.escape(WILDCARDS) + "]"


def query_mode(query: Column | str) -> Column:
    """Partial-form, Short-query or Full-form."""
    q = _col(query)
    letters = F.regexp_replace(nfc(q), r"[\s._]", "")
    return F.when(q.rlike(_MARK), "Partial-form").when(F.length(letters) <= SHORT_QUERY, "Short-query").otherwise("Full-form")


def wildcard_parts(query: Column | str) -> Column:
    """STRUCT<shape, left, right>, null without a marker; two markers or no fragment raise."""
    q = F.trim(_col(query))
    n = F.length(q) - F.length(F.regexp_replace(q, _MARK, ""))
    left, right = F.trim(F.regexp_extract(q, f"^(.*?){_MARK}", 1)), F.trim(F.regexp_extract(q, f"{_MARK}(.*)$", 1))
    shape = (
        F.when(n > 1, F.raise_error(F.lit("a query takes one wildcard marker")))
        .when((left != "") & (right != ""), "infix").when(left != "", "prefix").when(right != "", "suffix")
        .otherwise(F.raise_error(F.lit("a wildcard query needs a fragment")))
    )
    return F.when(n > 0, F.struct(shape.alias("shape"), left.alias("left"), right.alias("right")))


def search_text(query: Column | str) -> Column:
    """The query without its wildcard marker."""
    return F.regexp_replace(F.trim(_col(query)), _MARK, "")


def leading_overlap(fragment: Column | str, tokens: Column | str) -> Column:
    """Length of the run of equal tokens from the left edge."""
    a, b = _col(fragment), _col(tokens)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, F.lit(False))
    return F.when(first_off > 0, first_off - 1).otherwise(F.size(same)).cast("int")


def trailing_overlap(fragment: Column | str, tokens: Column | str) -> Column:
    return leading_overlap(F.reverse(_col(fragment)), F.reverse(_col(tokens)))


def fragment_matches(fragment: Column | str, tokens: Column | str) -> Column:
    """ARRAY<STRUCT<start, overlap>> of every start with some overlap."""
    f, t = _col(fragment), _col(tokens)
    at = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))),
        lambda i: F.struct(i.alias("start"), leading_overlap(f, F.slice(t, i + 1, F.least(F.size(f), F.size(t) - i))).alias("overlap")),
    )
    # an overlap shorter than the slice compares the fragment's rest with nothing
    return F.filter(at, lambda m: m["overlap"] > 0)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edges(matches: Column, fragment: Column, left: bool) -> Column:
    """Per overlap the earliest end (left fragment) or latest start (right one): all that ordering needs."""

    def best(v: Column) -> Column:
        same = F.filter(matches, lambda m: m["overlap"] == v)
        place = F.array_min(F.transform(same, lambda m: m["start"] + m["overlap"])) if left else F.array_max(F.transform(same, lambda m: m["start"]))
        return F.struct(v.alias("overlap"), place.alias("place"))

    sizes = F.when(F.size(fragment) > 0, F.sequence(F.lit(1), F.greatest(F.size(fragment), F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(F.transform(sizes, best), lambda x: x["place"].isNotNull())


def wildcard_match(shape: Column, left: Column, right: Column, tokens: Column) -> Column:
    """STRUCT<full, frag, overlap>: edges for prefix and suffix, the best ordered pair for infix.

    Work is linear in the tokens: of equal overlaps only the outermost place counts.
    """

    def info(full: Column, frag: Column, overlap: Column) -> Column:
        return F.struct(full.alias("full"), frag.cast("int").alias("frag"), overlap.cast("int").alias("overlap"))

    none = info(F.lit(False), F.lit(0), F.lit(0))

    def single(edges: Column) -> Column:
        return info(F.lit(False), F.lit(1), F.array_max(F.transform(edges, lambda m: m["overlap"])))

    def ordered(x: Column) -> Column:
        ls, rs = x["ls"], x["rs"]

        def pair(a: Column, b: Column) -> Column:
            return info((a["overlap"] == F.size(left)) & (b["overlap"] == F.size(right)), F.lit(2), a["overlap"] + b["overlap"])

        pairs = F.flatten(F.transform(ls, lambda a: F.transform(F.filter(rs, lambda b: b["place"] >= a["place"]), lambda b: pair(a, b))))
        return (
            F.when((F.size(ls) > 0) & (F.size(rs) > 0), F.coalesce(F.array_max(pairs), none))
            .when(F.size(ls) > 0, single(ls)).when(F.size(rs) > 0, single(rs)).otherwise(none)
        )

    edges = F.struct(
        _bind(fragment_matches(left, tokens), lambda m: _edges(m, left, True)).alias("ls"), _bind(fragment_matches(right, tokens), lambda m: _edges(m, right, False)).alias("rs")
    )
    pre, suf = leading_overlap(left, tokens), trailing_overlap(right, tokens)
    return (
        F.when(shape == "prefix", info((pre == F.size(left)) & (F.size(left) > 0), (pre > 0).cast("int"), pre))
        .when(shape == "suffix", info((suf == F.size(right)) & (F.size(right) > 0), (suf > 0).cast("int"), suf))
        .otherwise(_bind(edges, ordered))
    )


def phones_match(actual: Column, expected: Column) -> Column:
    """Equal, or an unmarked length-free vowel against its long counterpart."""
    return (actual == expected) | (actual.isin(LENGTH_FREE) & (F.concat(actual, F.lit("ː")) == expected))


def token_sequences_match(actual: Column, expected: Column) -> Column:
    return (F.size(actual) == F.size(expected)) & F.forall(F.zip_with(actual, expected, phones_match), lambda ok: ok)
