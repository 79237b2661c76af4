"""The Porter2 stemmer for English, as expressions that Spark and SQL evaluate alike.

Each step is a list of cases on a word's ending, the longest first. The rules are stated once and written in the words of Spark's SQL or of
another engine, which checks it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with a stem of their own, and words that stay as they are.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
#: These stay once a plural's s has gone.
KEPT_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# The suffixes of steps 2 to 4 and what takes their place.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), "")
VOWEL, SHORT = "[aeiouy]", "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"

Word = str  # SQL text
Step = Callable[[Word, Word, Word], tuple[Word, Word, Word]]


class _Sql:
    """SQL text, in DuckDB's words."""

    ENDS, MATCHES, GROUP, ALL = "ends_with", "regexp_matches", "\\", ", 'g'"

    def ends(self, w: str, s: str) -> str:
        return f"{self.ENDS}({w}, '{s}')"

    def matches(self, w: str, p: str) -> str:
        return f"{self.MATCHES}({w}, '{p}')"

    def size(self, w: str) -> str:
        return f"length({w})"

    def cut(self, w: str, n: int) -> str:
        return f"substr({w}, 1, length({w}) - {n})"

    def plus(self, w: str, s: str) -> str:
        return f"concat({w}, '{s}')"

    def replaced(self, w: str, p: str, new: str) -> str:
        return f"regexp_replace({w}, '{p}', '{new.replace('@', self.GROUP)}'{self.ALL})"

    def taken(self, w: str, p: str) -> str:
        return f"length(regexp_extract({w}, '{p}', 0))"

    def after(self, w: str, n: str) -> str:
        return f"substr({w}, {n} + 1)"

    def both(self, a: str, b: str) -> str:
        return f"({a} and {b})"

    def at_least(self, a: str | int, b: str | int) -> str:
        return f"({a} >= {b})"

    def minus(self, a: str, n: int) -> str:
        return f"({a} - {n})"

    def sum(self, a: str, b: str) -> str:
        return f"({a} + {b})"

    def case(self, cases: list[tuple[str, str]], other: str) -> str:
        return "(case " + " ".join(f"when {a} then {b}" for a, b in cases) + f" else {other} end)"

    def known(self, w: str, table: dict[str, str], other: str) -> str:
        return f"(case {w} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + f" else {other} end)"

    def let(self, state: str, step: Step) -> str:
        w, a, b = step("x.w", "x.a", "x.b")
        return f"list_transform({state}, lambda x: {{'w': {w}, 'a': ({a})::bigint, 'b': ({b})::bigint}})"

    def start(self, w: str) -> str:
        return f"[{{'w': {w}, 'a': 0::bigint, 'b': 0::bigint}}]"

    def result(self, state: str) -> str:
        return f"{state}[1].w"


class _Spark(_Sql):
    ENDS, MATCHES, GROUP, ALL = "endswith", "regexp_like", "$", ""

    def known(self, w: str, table: dict[str, str], other: str) -> str:
        return f"coalesce(element_at(map({', '.join(f"'{x}'" for pair in table.items() for x in pair)}), {w}), {other})"

    def let(self, state: str, step: Step) -> str:
        w, a, b = step("x.w", "x.a", "x.b")
        return f"transform({state}, x -> named_struct('w', {w}, 'a', {a}, 'b', {b}))"

    def start(self, w: str) -> str:
        return f"array(named_struct('w', {w}, 'a', 0, 'b', 0))"

    def result(self, state: str) -> str:
        return f"{state}[0].w"


def _endings(e, w: Word, table: dict[str, str], r1: Word, needs: dict[str, tuple[Word, str]]) -> Word:
    """The longest ending decides: it is replaced if it lies behind ``r1``, or for those in ``needs`` behind another place and after a pattern."""
    cases = []
    for suffix in sorted(table, key=lambda s: -len(s)):
        place, before = needs.get(suffix, (r1, ""))
        ok = e.at_least(e.minus(e.size(w), len(suffix)), place)
        if before:
            ok = e.both(ok, e.matches(w, f"{before}{suffix}$"))
        cases.append((e.ends(w, suffix), e.case([(ok, e.plus(e.cut(w, len(suffix)), table[suffix]))], w)))
    return e.case(cases, w)


def _regions(e, w: Word, a: Word, b: Word) -> tuple[Word, Word, Word]:
    """Where R1 begins: behind the first consonant after a vowel."""
    found = e.taken(w, "^(gener|commun|arsen)")
    plain = e.taken(w, f"^.*?{VOWEL}[^aeiouy]")
    return w, e.case([(e.at_least(found, 1), found), (e.at_least(plain, 1), plain)], e.size(w)), b


def _second_region(e, w: Word, a: Word, b: Word) -> tuple[Word, Word, Word]:
    found = e.taken(e.after(w, a), f"^.*?{VOWEL}[^aeiouy]")
    return w, a, e.case([(e.at_least(found, 1), e.sum(a, found))], e.size(w))


def _plurals(e, w, a, b):
    ie = e.case([(e.at_least(e.size(w), 5), e.cut(w, 2))], e.cut(w, 1))
    s = e.case([(e.matches(w, f"{VOWEL}.+s$"), e.cut(w, 1))], w)
    return e.case([(e.ends(w, "sses"), e.cut(w, 2)), (e.ends(w, "ied"), ie), (e.ends(w, "ies"), ie), (e.ends(w, "us"), w), (e.ends(w, "ss"), w), (e.ends(w, "s"), s)], w)


def _participles(e, w, a, b):
    """A word that has lost its ending is marked by ``#``."""
    cases = []
    for suffix in ("ingly", "eedly", "edly", "eed", "ing", "ed"):
        n = len(suffix)
        if suffix.startswith("eed"):
            new = e.case([(e.at_least(e.minus(e.size(w), n), a), e.plus(e.cut(w, n), "ee"))], w)
        else:
            new = e.case([(e.matches(w, f"{VOWEL}.*{suffix}$"), e.plus(e.cut(w, n), "#"))], w)
        cases.append((e.ends(w, suffix), new))
    return e.case(cases, w)


def _mended(e, w, a, b):
    t = e.cut(w, 1)
    short = e.both(e.at_least(a, e.size(t)), e.matches(t, SHORT))
    fixed = e.case([(e.matches(t, "(at|bl|iz)$"), e.plus(t, "e")), (e.matches(t, "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), e.cut(t, 1)), (short, e.plus(t, "e"))], t)
    return e.case([(e.ends(w, "#"), fixed)], w)


def _final(e, w, a, b):
    t, at = e.cut(w, 1), e.minus(e.size(w), 1)
    last_e = e.case([(e.at_least(at, b), t), (e.both(e.at_least(at, a), e.matches(t, SHORT)), w), (e.at_least(at, a), t)], w)
    return e.case([(e.ends(w, "e"), last_e), (e.both(e.ends(w, "ll"), e.at_least(at, b)), t)], w)


def _stem(e, word: Word) -> Word:
    only = lambda step: lambda w, a, b: (step(e, w, a, b), a, b)
    steps = [
        lambda w, a, b: (e.replaced(e.replaced(w, "^y", "Y"), f"({VOWEL})y", "@1Y"), a, b),  # y between vowels, or first, is a consonant
        lambda w, a, b: _regions(e, w, a, b),
        lambda w, a, b: _second_region(e, w, a, b),
        only(_plurals), only(_participles), only(_mended),
        only(lambda e, w, a, b: e.case([(e.matches(w, "^.+[^aeiouy][yY]$"), e.plus(e.cut(w, 1), "i"))], w)),
        only(lambda e, w, a, b: _endings(e, w, STEP2, a, {"ogi": (a, "l"), "li": (a, "[cdeghkmnrt]")})),
        only(lambda e, w, a, b: _endings(e, w, STEP3, a, {"ative": (b, "")})),
        only(lambda e, w, a, b: _endings(e, w, STEP4, b, {"ion": (b, "[st]")})),
        only(_final),
        lambda w, a, b: (e.replaced(w, "Y", "y"), a, b),
    ]
    stemmed = e.result(reduce(e.let, steps, e.start(word)))
    own = SPECIAL | {w: w for w in (*KEPT, *KEPT_SINGULAR)} | {w + "s": w for w in KEPT_SINGULAR}
    return e.known(word, own, e.case([(e.at_least(2, e.size(word)), word)], stemmed))


def stem_expr(word: str) -> str:
    """The stem of a lower-case word in Spark's SQL, meant for the distinct vocabulary."""
    return _stem(_Spark(), word)


def stem(column: str) -> Column:
    """The stems of a column, by its name."""
    return F.expr(stem_expr(column))


def stem_sql(word: str) -> str:
    """The same in DuckDB's SQL."""
    return _stem(_Sql(), word)
