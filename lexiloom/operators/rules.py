"""Named sound-change rules that explain an alignment.

Rules are few and go to every task; matching is a cursor over the alignment's columns
and runs in Arrow batches on what survived ranking.  At each column of a mismatch run all
rules are tried strictly, then all tolerantly, narrow and long ones first; a column no
rule explains is reported as an observed difference.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S

# Context labels that hold everywhere, nasals, and the phones of the "after e, i, or r" contexts.
ALWAYS = frozenset({"", "all environments"})
NASALS = frozenset({"m", "n", "ŋ"})
AFTER = frozenset({"e", "i", "r"})
OBSERVED = "OBS-"

APPLICATION = "array<struct<rule_id:string,name:string,input:string,output:string,position:int,dialects:array<string>>>"


def tokens_of(text: str | None, inventory: Sequence[str]) -> tuple[str, ...]:
    """Longest-match phones of a rule's side (the Python twin of ``scalars.tokenize``)."""
    body = "|".join(re.escape(p) for p in sorted(inventory, key=lambda p: (-len(p), p)))
    return tuple(re.findall(f"(?:{body}|\\S)[̀-ͯ]*" if body else "\\S[̀-ͯ]*", text or ""))


@dataclass(frozen=True)
class Rule:
    """A rule ready for matching."""

    id: str
    name: str
    input: tuple[str, ...]
    output: tuple[str, ...]
    context: str | None = None
    dialects: tuple[str, ...] = ()
    insertion: bool = False
    constraints: dict | None = None
    order: int = 0
    tail: tuple[str, ...] | None = None


@dataclass
class RuleSet:
    """Rules in matching order, with what matching needs of the language."""

    rules: list[Rule]
    vowels: frozenset[str] = frozenset(S.VOWELS)
    always: frozenset[str] = ALWAYS
    tolerant: Callable[[str, str], bool] | None = None
    length_free: frozenset[str] = frozenset(S.LENGTH_FREE)

    def same(self, actual: str, expected: str, strict: bool) -> bool:
        if actual == expected:
            return True
        if strict:
            return False
        if self.tolerant:
            return self.tolerant(actual, expected)
        return actual in self.length_free and actual + "ː" == expected

    def equal(self, a: Sequence[str], b: Sequence[str], strict: bool) -> bool:
        return len(a) == len(b) and all(self.same(x, y, strict) for x, y in zip(a, b, strict=True))


def compile_rules(raw: list[dict], inventory: Sequence[str] = tuple(S.PHONES), always: Sequence[str] = (), **kw) -> RuleSet:
    """Tokenise and order: contextual first, then longer, then by load order; rules with two empty sides are dropped."""
    free = ALWAYS | {c.strip().lower() for c in always}
    out = []
    for i, r in enumerate(raw):
        a, b = tokens_of(r.get("input"), inventory), tokens_of(r.get("output"), inventory)
        if not a and not b:
            continue
        ctx = r.get("context")
        tail = re.fullmatch(r"_\.\.\.(.+)", ctx.strip()) if isinstance(ctx, str) else None
        out.append(
            Rule(
                str(r.get("id", "unknown-rule")), str(r.get("name_en", r.get("id", ""))), a, b, ctx, tuple(dict.fromkeys(r.get("dialects") or ())),
                bool(r.get("is_insertion") or r.get("allows_empty_input")), r.get("lemma_constraints"), i, tokens_of(tail.group(1), inventory) if tail else None,
            )
        )
    narrow = lambda r: isinstance(r.context, str) and r.context.strip().lower() not in free
    out.sort(key=lambda r: (not narrow(r), -len(r.input) - len(r.output), -len(r.input), -len(r.output), r.order))
    return RuleSet(out, always=free, **kw)


@dataclass
class _Word:
    """One alignment, with the number of lemma and query tokens before each column."""

    columns: list[tuple]
    q: list[str] = field(init=False)
    l: list[str] = field(init=False)  # noqa: E741
    q_at: list[int] = field(init=False)
    l_at: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.q, self.l, self.q_at, self.l_at = [], [], [], []
        for a, b in self.columns:
            if a is None and b is None:
                raise ValueError("an alignment column holds two gaps")
            self.q_at.append(len(self.q))
            self.l_at.append(len(self.l))
            if a is not None:
                self.q.append(a)
            if b is not None:
                self.l.append(b)
        self.q_at.append(len(self.q))
        self.l_at.append(len(self.l))

    def before(self, l0: int, q0: int) -> str | None:
        return self.l[l0 - 1] if l0 else self.q[q0 - 1] if q0 else None

    def after(self, l1: int, q1: int, k: int = 0) -> str | None:
        rest = self.l[l1:] + self.q[q1:]
        return rest[k] if k < len(rest) else None


def context_holds(rules: RuleSet, rule: Rule, w: _Word, l0: int, l1: int, q0: int, q1: int) -> bool:
    """Null holds always, an unknown notation never."""
    if rule.context is None:
        return True
    if not isinstance(rule.context, str):
        return False
    ctx = rule.context.strip().lower()
    if ctx in rules.always:
        return True
    prev, nxt = w.before(l0, q0), w.after(l1, q1)
    if ctx == "_#":
        return nxt is None
    if ctx == "#_v":
        return l0 == 0 and q0 == 0 and nxt in rules.vowels
    if ctx == "v_v":
        return prev in rules.vowels and nxt in rules.vowels
    if ctx == "_nc":
        second = w.after(l1, q1, 1)
        return nxt in NASALS and second is not None and second not in rules.vowels
    if ctx == "after e, i, or r":
        return prev in AFTER
    if ctx == "all environments except after e, i, or r":
        return prev not in AFTER
    if m := re.fullmatch(r"_\{([^}]+)\}", ctx):
        return nxt in {x.strip() for x in m.group(1).split(",") if x.strip()}
    if rule.tail:
        rest, n = tuple(w.l[l1:]), len(rule.tail)
        return any(rest[i : i + n] == rule.tail for i in range(len(rest) - n + 1))
    return False


def _crossing(columns: list[tuple]) -> bool:
    return any(a is None for a, _ in columns) and any(b is None for _, b in columns)


def _suffix_at(rules: RuleSet, rule: Rule, w: _Word, c: int, end: int, strict: bool) -> int | None:
    """Lemma position where a word-final rule starts, if it covers the rest of the run [c, end)."""
    if not isinstance(rule.context, str) or rule.context.strip().lower() != "_#":
        return None
    l0, q0 = len(w.l) - len(rule.input), len(w.q) - len(rule.output)
    if l0 < 0 or q0 < 0 or l0 > w.l_at[c] or q0 > w.q_at[c]:
        return None
    if not (rules.equal(w.l[l0:], rule.input, strict) and rules.equal(w.q[q0:], rule.output, strict)):
        return None
    # the shared part before the run and after it must be the same on both sides of the rule
    if rule.input[: w.l_at[c] - l0] != rule.output[: w.q_at[c] - q0] or rule.input[w.l_at[end] - l0 :] != rule.output[w.q_at[end] - q0 :]:
        return None
    return None if _crossing(w.columns[c:end]) else l0


def _normal_at(rules: RuleSet, rule: Rule, w: _Word, c: int, end: int, strict: bool) -> int | None:
    """The column after the rule's span from ``c``, if the rule matches there within the run."""
    i = o = 0
    stop = c
    while stop < end and (i < len(rule.input) or o < len(rule.output)):
        a, b = w.columns[stop]
        if b is not None:
            if i >= len(rule.input) or not rules.same(b, rule.input[i], strict):
                return None
            i += 1
        if a is not None:
            if o >= len(rule.output) or not rules.same(a, rule.output[o], strict):
                return None
            o += 1
        stop += 1
    if i < len(rule.input) or o < len(rule.output) or _crossing(w.columns[c:stop]):
        return None
    if not rule.input and not (rule.insertion and any(b is None for _, b in w.columns[c:stop])):
        return None
    if not rule.output and not any(a is None for a, _ in w.columns[c:stop]):
        return None
    ok = context_holds(rules, rule, w, w.l_at[c], w.l_at[c] + len(rule.input), w.q_at[c], w.q_at[c] + len(rule.output))
    return stop if ok else None


def _constraints_hold(rule: Rule, lemma: dict | None) -> bool:
    if rule.constraints is None:
        return True
    if not isinstance(rule.constraints, dict) or lemma is None:
        return False
    return all(lemma.get(k) in v if isinstance(v, list) else lemma.get(k) == v for k, v in rule.constraints.items())


def explain(columns: list[tuple], rules: RuleSet, lemma: dict | None = None) -> list[dict]:
    """The rule applications along an alignment, observed differences included."""
    w, out, c = _Word(columns), [], 0
    usable = [r for r in rules.rules if _constraints_hold(r, lemma)]
    while c < len(columns):
        if columns[c][0] is not None and columns[c][0] == columns[c][1]:
            c += 1
            continue
        end = c
        while end < len(columns) and (columns[end][0] is None or columns[end][0] != columns[end][1]):
            end += 1
        while c < end:
            c = _step(w, usable, rules, c, end, out)
    return out


def _step(w: _Word, usable: list[Rule], rules: RuleSet, c: int, end: int, out: list[dict]) -> int:
    for strict in (True, False):
        for r in usable:
            start = _suffix_at(rules, r, w, c, end, strict)
            stop = end if start is not None else _normal_at(rules, r, w, c, end, strict)
            if stop is not None:
                at = start if start is not None else w.l_at[c]
                out.append({"rule_id": r.id, "name": r.name, "input": "".join(r.input), "output": "".join(r.output), "position": at, "dialects": list(r.dialects)})
                return stop
    a, b = w.columns[c]
    kind = "SUB" if a is not None and b is not None else "DEL" if b is not None else "INS"
    out.append({"rule_id": OBSERVED + kind, "name": "observed", "input": b or "", "output": a or "", "position": w.l_at[c], "dialects": []})
    return c + 1


def explain_udf(rules: RuleSet, metadata: tuple[str, ...] = ()):
    """(alignment, STRUCT of lemma metadata) -> applications.

    Equal alignments of a batch are explained once, unless a rule looks at the metadata.
    """
    asked = any(r.constraints is not None for r in rules.rules)

    @F.pandas_udf(APPLICATION)
    def run(alignment: pd.Series, lemma: pd.DataFrame) -> pd.Series:
        meta = lemma.to_dict("records") if asked else [None] * len(alignment)
        known: dict = {}
        out = []
        for a, m in zip(alignment, meta, strict=True):
            key = tuple((x["q"], x["l"]) for x in (a if a is not None else []))
            got = explain(list(key), rules, m) if asked or key not in known else known[key]
            known[key] = got
            out.append(got)
        return pd.Series(out)

    return run


# --- rendering: native ----------------------------------------------------------


def applied_rules(applications: Column) -> Column:
    """Ids of named rules, without observed differences."""
    return F.filter(F.transform(applications, lambda a: a["rule_id"]), lambda i: ~i.startswith(OBSERVED))


def markers(alignment: Column, applications: Column) -> Column:
    """| equal, : in a rule's span, . mismatch, blank at a gap."""
    before = F.transform(F.sequence(F.lit(1), F.size(alignment)), lambda i: F.size(F.filter(F.slice(alignment, F.lit(1), i), lambda c: c["l"].isNotNull())) - 1)

    def ruled(pos: Column) -> Column:
        return F.exists(
            applications,
            lambda a: (a["position"] >= 0) & ~a["rule_id"].startswith(OBSERVED) & (pos >= a["position"]) & (pos < a["position"] + F.size(S.tokenize(a["input"], marks=False))),
        )

    one = F.zip_with(
        alignment,
        before,
        lambda c, pos: F.when(c["q"].isNotNull() & c["l"].isNotNull() & ruled(pos), ":")
        .when(c["q"] == c["l"], "|")
        .when(c["q"].isNull() | c["l"].isNull(), " ")
        .otherwise("."),
    )
    return F.when(F.size(alignment) > 0, one).otherwise(F.expr("cast(array() as array<string>)"))


def visualization(alignment: Column, marks: Column) -> Column:
    """Three fixed-width lines: query, markers, lemma."""
    gap = F.lit("-")
    width = F.transform(alignment, lambda c: F.greatest(F.length(F.coalesce(c["q"], gap)), F.length(F.coalesce(c["l"], gap))))

    def line(label: str, cells: Column) -> Column:
        return F.rtrim(F.concat(F.lit(label), F.array_join(F.zip_with(cells, width, lambda x, n: F.rpad(x, n, " ")), " ")))

    q = F.transform(alignment, lambda c: F.coalesce(c["q"], gap))
    l = F.transform(alignment, lambda c: F.coalesce(c["l"], gap))  # noqa: E741
    return F.concat_ws("\n", line("query: ", q), line("       ", marks), line("lemma: ", l))


def dialect_attribution(dialect: Column, applications: Column) -> Column:
    shown = F.coalesce(F.nullif(F.trim(dialect), F.lit("")), F.lit("unknown"))
    found = F.array_distinct(F.flatten(F.transform(applications, lambda a: a["dialects"])))
    base = F.concat(F.lit("lemma dialect: "), shown)
    return F.when(F.size(found) > 0, F.concat(base, F.lit("; query-compatible dialects: "), F.array_join(found, ", "))).otherwise(base)


def observed_steps(applications: Column) -> Column:
    return F.size(F.filter(applications, lambda a: a["rule_id"].startswith(OBSERVED)))
