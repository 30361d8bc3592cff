"""Forms of an organisation's name, as one struct expression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.text import let


@dataclass(frozen=True)
class Words:
    """Dictionaries of a name cleaner; all are small and belong to the user."""

    safe: dict[str, str] = field(default_factory=lambda: SAFE)
    contextual: dict[str, list[str]] = field(default_factory=lambda: CONTEXTUAL)
    protected: dict[str, str] = field(default_factory=lambda: PROTECTED)
    titles: tuple[str, ...] = ("dr", "mr", "mrs", "ms", "prof")
    generic: tuple[str, ...] = ("hospital", "clinic", "nursing", "home", "centre", "medical", "the", "and", "of", "private", "limited", "company", "llp")
    distinguishing: tuple[str, ...] = ("east", "west", "north", "south", "eastern", "western", "northern", "southern", "new", "old", "branch", "unit")
    places: tuple[str, ...] = ()


# Abbreviations that are always spelt out.
SAFE = {
    "hosp": "hospital", "hospt": "hospital", "hospl": "hospital", "hsptl": "hospital", "pvt": "private", "ltd": "limited", "co": "company",
    "corp": "corporation", "inc": "incorporated", "govt": "government", "gov": "government", "univ": "university", "mfg": "manufacturing",
    "mgmt": "management", "assn": "association", "ctr": "centre", "cntr": "centre", "center": "centre", "nsg": "nursing", "svcs": "services",
    "engg": "engineering", "bros": "brothers", "intl": "international", "natl": "national", "labs": "laboratories", "pharma": "pharma",
}
# Abbreviations with several meanings, which only make variants.
CONTEXTUAL = {
    "dr": ["doctor", "drive"], "st": ["saint", "street"], "med": ["medical", "medicine"], "inst": ["institute", "institution"],
    "ind": ["industries", "industrial"], "gen": ["general"], "dist": ["district", "distributor"], "assoc": ["associates", "association"],
    "sci": ["science", "sciences"], "res": ["research"], "mem": ["memorial"], "ch": ["charitable", "children"], "spl": ["speciality", "special"],
    "ent": ["enterprises"],
}
# Phrases replaced before marks are dropped.
PROTECTED = {
    "co-operative": "cooperative", "co-op": "cooperative", "co operative": "cooperative", "m/s": "", "m/s.": "", "(p) ltd": "private limited",
    "(p)ltd": "private limited", "p. ltd": "private limited", "pvt.ltd": "private limited", "pvt. ltd": "private limited",
}


def _lookup(table: dict, key: Column) -> Column:
    made = [F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in table.values()]
    # a map is searched entry by entry, a set of keys is not
    return F.when(key.isin(list(table)), F.try_element_at(F.create_map(*[x for k, v in zip(table, made) for x in (F.lit(k), v)]), key))


def name_forms(c: Column, words: Words = Words()) -> Column:
    """struct(normalized, core, tokens, sig, acronym, variants): null and empty names give empty forms.

    Dotted and spaced initials become one word, safe abbreviations are spelt
    out; the core has no titles in front and no known place behind.
    """
    phrased = let(F.lower(T.squeeze(c)), lambda x: phrases(x, words))
    return let(spelt(let(let(phrased, T.squeeze), lambda x: T.plain(T.given(x))), words), lambda n: forms_of(n, words))


def phrases(x: Column, words: Words = Words()) -> Column:
    """Lower-cased squeezed names with protected phrases replaced and dotted initials joined."""
    out = x
    for phrase in sorted(words.protected, key=len, reverse=True):
        pattern = "".join(r"\s*" if ch == " " else "\\" + ch if not ch.isalnum() else ch for ch in phrase)
        out = F.regexp_replace(out, rf"(?U)(?<!\w){pattern}(?!\w)", f" {words.protected[phrase]} ")
    # most names hold the letters of no phrase, and each phrase is a search of its own; a phrase put in may make another
    some = reduce(or_, (x.contains(max(phrase.split(" "), key=len)) for phrase in words.protected)) if words.protected else F.lit(False)
    return F.regexp_replace(F.when(some, out).otherwise(x), r"\.(?<=(?<!\p{L})\p{L}\.)\s?(?=\p{L}(?!\p{L}))", "")


def spelt(n: Column, words: Words = Words()) -> Column:
    """Normal names with safe abbreviations spelt out and spaced initials joined."""
    full = F.transform(F.split(n, " "), lambda t: F.coalesce(_lookup(words.safe, t), t))
    return F.regexp_replace(F.array_join(full, " "), r" (?<=(?<!\p{L})\p{L} )(?=\p{L}(?!\p{L}))", "")


def forms_of(normalized: Column, words: Words = Words()) -> Column:
    """``name_forms`` of a name that ``spelt`` gave."""
    return let(F.filter(F.split(normalized, " "), lambda t: t != ""), lambda tokens: let(_core(tokens, words), lambda core: let(
        F.filter(core, lambda t: ~t.isin(list(words.generic))), lambda sig: _forms(normalized, core, sig, words))))


def _core(tokens: Column, words: Words) -> Column:
    first = F.array_min(F.transform(tokens, lambda t, i: F.when(~t.isin(list(words.titles)), i).otherwise(F.size(tokens) - 1)))
    rest = F.slice(tokens, F.coalesce(first, F.lit(0)) + 1, F.size(tokens))
    if not words.places:
        return rest
    longest = max(len(p.split()) for p in words.places)
    tail = lambda c, n: F.array_join(F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n)), " ")
    cut = lambda c: F.coalesce(*[F.when((F.size(c) > n) & tail(c, n).isin(list(words.places)), F.lit(n)) for n in range(longest, 0, -1)], F.lit(0))
    return let(rest, lambda c: F.slice(c, F.lit(1), F.size(c) - cut(c)))


def _forms(normalized: Column, core: Column, sig: Column, words: Words) -> Column:
    acronym = F.when((F.size(sig) >= 2) & ~F.exists(sig, lambda t: ~t.rlike(r"^\p{L}")), F.array_join(F.transform(sig, lambda t: F.left(t, F.lit(1))), "")).otherwise("")
    swaps = F.flatten(F.transform(core, lambda t, i: F.transform(
        F.coalesce(_lookup(words.contextual, t), F.array().cast("array<string>")),
        lambda e: F.array_join(F.transform(core, lambda u, j: F.when(i == j, e).otherwise(u)), " "))))
    return F.struct(
        normalized.alias("normalized"), F.array_join(core, " ").alias("core"), core.alias("tokens"), sig.alias("sig"),
        acronym.alias("acronym"), F.slice(swaps, F.lit(1), F.lit(4)).alias("variants"),
    )
