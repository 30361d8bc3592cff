"""Raw records to clean ones, with every doubt as a flag beside them.

One projection gives the clean columns and the list of flags; flags and their
worst severity follow from it without another pass over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import places as P
from tidemark.functions import text as T
from tidemark.functions import validate as V

# Mail hosts that anybody may use.
GENERIC_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.in", "yahoo.co.in", "ymail.com", "hotmail.com", "outlook.com", "live.com",
    "rediffmail.com", "aol.com", "icloud.com", "protonmail.com", "msn.com", "nic.in", "gov.in",
]
# Identifiers that only one organisation can have.
UNIQUE_IDS = ["gst", "cin", "udyam", "pan"]
SEVERITIES = ["info", "warning", "error"]
#: Points of evidence.
STRENGTH = {"city": 15, "state": 5, "district": 5, "address": 15, "pin": 10, "phone": 15, "website": 10}
#: Issues in the order of a record's flags.
ISSUES = (
    "not_an_entity_line", "missing_name", "invalid_name", "suspicious_name", "unknown_state", "invalid_city", "invalid_pincode", "city_state_mismatch", "pincode_state_mismatch",
    "city_name_conflict", "invalid_phone", "placeholder_phone", "invalid_email", "invalid_website", "invalid_registration_id",
)
FLAG = "struct<issue_type:string,severity:string,field:string,value:string>"
FIELDS = ["name", "city", "state", "district", "pincode", "address", "phone", "email", "website", "registration_id", "category"]


def type_hint(normalized: Column, keywords: dict[str, list[str]]) -> Column:
    """First kind one of whose keywords starts a word of the name, else empty."""
    padded = F.concat(F.lit(" "), normalized)
    return F.coalesce(*[F.when(padded.contains(f" {k}"), kind) for kind, words in keywords.items() for k in words], F.lit("")) if keywords else F.lit("")


def place_hint(forms: Column, normalized: Column, places: tuple[str, ...], synonyms: dict[str, str]) -> Column:
    """The known place that a name ends in behind other words, else empty: the longest."""
    if not places:
        return F.lit("")
    return hint_of(F.split(normalized, " "), places, synonyms)


def hint_of(words: Column, places: tuple[str, ...], synonyms: dict[str, str]) -> Column:
    """``place_hint`` of a normal name's words."""
    if not places:
        return F.lit("")
    longest = max(len(p.split()) for p in places)
    tail = lambda n: F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")
    named = lambda n: F.coalesce(P.lookup(synonyms, tail(n)), tail(n))
    return F.coalesce(*[F.when((F.size(words) > n) & named(n).isin(list(places)), named(n)) for n in range(longest, 0, -1)], F.lit(""))


def strength(have: dict[str, Column], emails: Column, registration: Column) -> Column:
    """0 to 100: how much a record says about its entity."""
    own = F.exists(emails, lambda e: ~F.substring_index(e, "@", -1).isin(GENERIC_DOMAINS))
    score = sum((F.when(ok, STRENGTH[k]).otherwise(0) for k, ok in have.items()), F.lit(0))
    score = score + F.when(F.size(emails) > 0, F.when(own, 10).otherwise(5)).otherwise(0)
    score = score + F.when(registration["kind"].isNotNull(), F.when(registration["kind"].isin(UNIQUE_IDS), 15).otherwise(5)).otherwise(0)
    return F.least(F.lit(100), score)


#: Parts that filters on clean columns must not be moved below: said in raw columns, these are hundreds of searches long.
_HELD = {"name_normalized", "forms", "place_hint", "problem", "city", "state", "district_norm", "pin", "pin_in_address", "phones", "mails", "website_norm", "reg", "address_norm"}


class _Parts:
    """Columns made from raw records, each when it is first asked for, once, and in a projection behind those of the parts it needs."""

    def __init__(self, raw: DataFrame, gazetteer: P.Gazetteer, words: N.Words | None, id_col: str):
        col = lambda n: (F.col(f"original_{n}") if f"original_{n}" in raw.columns else F.lit(None)).cast("string")
        role = F.col("text_role") if "text_role" in raw.columns else F.lit(None).cast("string")
        year = F.substring(F.col("modified").cast("string"), 1, 4).try_cast("int") if "modified" in raw.columns else F.lit(None).cast("int")
        self.raw = raw.select(F.col(id_col).alias("record_id"), *[col(n).alias(f"o_{n}") for n in FIELDS], role.alias("role"), year.alias("source_year"))
        self.recipes = _recipes(gazetteer, words or N.Words(places=gazetteer.places()))
        self.levels = dict.fromkeys(self.raw.columns, 0)
        self.stages: list[dict[str, Column]] = []
        self._deepest = 0

    def __call__(self, name: str) -> Column:
        if name not in self.levels:
            outer, self._deepest = self._deepest, 0
            made = self.recipes[name](self)
            level, self._deepest = self._deepest + 1, outer
            self.stages += [{} for _ in range(level - len(self.stages))]
            # Spark moves no filter below a row number, and drops it with the part
            self.stages[level - 1][name] = F.when(F.monotonically_increasing_id() >= 0, made) if name in _HELD else made
            self.levels[name] = level
        self._deepest = max(self._deepest, self.levels[name])
        return F.col(name)

    def frame(self) -> DataFrame:
        """Raw records with the parts that were asked for."""
        step = self.raw
        for stage in self.stages:
            step = step.withColumns(stage)
        return step


def _recipes(g: P.Gazetteer, words: N.Words) -> dict:
    """How a part is made of others: ``o_`` columns as given, ``q_`` squeezed, ``g_`` without null-like values, ``l_`` in lower case, ``n_`` in normal form."""
    made = {}
    for n in FIELDS:
        made[f"q_{n}"] = lambda p, n=n: T.squeeze_odd(p(f"o_{n}"))
        made[f"g_{n}"] = lambda p, n=n: T.given(p(f"q_{n}"))
        made[f"n_{n}"] = lambda p, n=n: T.plain_odd(p(f"l_{n}"))
        made[f"l_{n}"] = lambda p, n=n: F.lower(p(f"g_{n}"))
    return made | {
        "name_phrased": lambda p: N.phrases(p("l_name"), words), "name_squeezed": lambda p: T.squeeze_odd(p("name_phrased")), "name_given": lambda p: T.given(p("name_squeezed")),
        "name_plain": lambda p: T.plain_odd(p("name_given")), "name_normalized": lambda p: N.spelt(p("name_plain"), words), "forms": lambda p: N.forms_of(p("name_normalized"), words),
        "name_words": lambda p: F.split(p("name_normalized"), " "), "place_hint": lambda p: hint_of(p("name_words"), g.places(), g.synonyms),
        "problem": lambda p: V.problem_of(p("q_name"), p("n_name")),
        "city_first": lambda p: g.synonym(p("n_city")), "city_alone": lambda p: g.before_state(p("city_first")), "city": lambda p: g.synonym(p("city_alone")),
        "bad_city": lambda p: (p("city") != "") & (p("city").rlike("^[0-9]+$") | (F.length(p("city")) < 2)), "city_norm": lambda p: F.when(p("bad_city"), "").otherwise(p("city")),
        "state": lambda p: g.state_of(p("n_state")), "district_alone": lambda p: g.undistrict(p("n_district")), "district_norm": lambda p: g.synonym(p("district_alone")),
        "pin": lambda p: T.pincode(F.when(F.regexp_replace(p("g_pincode"), "[^0-9]", "").rlike("^[1-9][0-9]{5}$"), p("g_pincode"))), "pin_in_address": lambda p: T.pincode(p("o_address")),
        "pincode": lambda p: F.when(p("pin") != "", p("pin")).otherwise(p("pin_in_address")),
        "state_in_city": lambda p: g.state_of_city(p("city_norm")), "state_in_pin": lambda p: g.state_of_pin(p("pincode")),
        "phones": lambda p: T.phone_parts(p("o_phone")), "mails": lambda p: T.email_parts_of(p("g_email")),
        "phones_all": lambda p: F.array_distinct(F.transform(F.filter(p("phones"), lambda x: x["kind"] == "valid"), lambda x: x["number"])),
        "emails_all": lambda p: F.array_distinct(F.transform(F.filter(p("mails"), lambda x: x["valid"]), lambda x: x["address"])),
        "website_norm": lambda p: V.website_of(p("g_website")), "reg": lambda p: F.try_element_at(V.registrations(p("o_registration_id")), F.lit(1)),
        "address_norm": lambda p: P.address_of(p("n_address")), "category_norm": lambda p: p("n_category"),
    }


def _checks(states: list[str]) -> dict:
    """Issue -> (severity, field, wrong, value): whether a record has it, and the value at fault; without a value, ``wrong`` lists those at fault."""
    nothing = lambda p: p("problem") == "missing_name"
    line = lambda p: nothing(p) & p("role").isNotNull() & ~p("role").isin("", "entity")
    of_kind = lambda kind: lambda p: F.transform(F.filter(p("phones"), lambda x: x["kind"] == kind), lambda x: x["raw"])
    return {
        "not_an_entity_line": ("info", "name", line, lambda p: F.lit("")), "missing_name": ("error", "name", lambda p: nothing(p) & ~line(p), lambda p: p("g_name")),
        "invalid_name": ("error", "name", lambda p: p("problem") == "invalid_name", lambda p: p("g_name")),
        "suspicious_name": ("warning", "name", lambda p: p("problem") == "suspicious_name", lambda p: F.left(p("g_name"), F.lit(120))),
        "unknown_state": ("warning", "state", lambda p: (p("state") != "") & ~p("state").isin(states), lambda p: p("o_state")),
        "invalid_city": ("warning", "city", lambda p: p("bad_city"), lambda p: p("o_city")),
        "invalid_pincode": ("warning", "pincode", lambda p: (F.coalesce(p("o_pincode"), F.lit("")) != "") & (p("pin") == ""), lambda p: p("o_pincode")),
        "city_state_mismatch": ("warning", "state", lambda p: p("state_in_city").isNotNull() & (p("state") != "") & (p("state_in_city") != p("state")), lambda p: F.concat_ws(" / ", p("o_city"), p("o_state"))),
        "pincode_state_mismatch": ("warning", "pincode", lambda p: p("state_in_pin").isNotNull() & (p("pincode") != "") & (p("state") != "") & (p("state_in_pin") != p("state")), lambda p: p("pincode")),
        "city_name_conflict": ("warning", "city", lambda p: (p("city_norm") != "") & (p("place_hint") != "") & (p("place_hint") != p("city_norm")), lambda p: F.concat_ws(" vs ", p("place_hint"), p("city_norm"))),
        "invalid_phone": ("warning", "phone", of_kind("invalid"), None), "placeholder_phone": ("warning", "phone", of_kind("placeholder"), None),
        "invalid_email": ("warning", "email", lambda p: F.transform(F.filter(p("mails"), lambda x: ~x["valid"]), lambda x: x["raw"]), None),
        "invalid_website": ("warning", "website", lambda p: (p("g_website") != "") & (p("website_norm") == ""), lambda p: p("g_website")),
        "invalid_registration_id": ("warning", "registration_id", lambda p: (p("g_registration_id") != "") & p("reg").isNull(), lambda p: p("g_registration_id")),
    }


def _flags(p: _Parts, issue: str, severity: str, field: str, wrong, value) -> Column:
    """Flags of one issue, with nulls where there is none."""
    flag = lambda v: F.struct(F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), v.cast("string").alias("value"))
    return F.array(F.when(wrong(p), flag(value(p)))) if value else F.transform(wrong(p), flag)


def clean(raw: DataFrame, gazetteer: P.Gazetteer = P.Gazetteer(), words: N.Words | None = None, keywords: dict[str, list[str]] | None = None, id_col: str = "record_id") -> DataFrame:
    """Clean columns of raw records (``original_*`` texts; missing ones are empty) with ``flags`` and what follows from them.

    ``text_role`` (if there) says that a line without a name is no entity line.
    ``is_resolvable``: there is a normal name and nothing wrong with it.
    """
    p, checks = _Parts(raw, gazetteer, words, id_col), _checks(list(gazetteer.states))
    flags = F.array_compact(F.concat(*[_flags(p, k, *checks[k]) for k in ISSUES]))
    unnamed = F.coalesce(checks["missing_name"][2](p) | checks["invalid_name"][2](p), F.lit(False))
    resolvable = (p("name_normalized") != "") & ~unnamed
    for name in ("forms", "district_norm", "address_norm", "category_norm", "phones_all", "emails_all"):
        p(name)
    step = p.frame().withColumn("flags", flags)
    rank = F.array_max(F.transform("flags", lambda f: F.array_position(F.array(*map(F.lit, SEVERITIES)), f["severity"])))
    have = {
        "city": (F.col("city_norm") != "") | (F.col("place_hint") != ""), "state": F.col("state") != "", "district": F.col("district_norm") != "", "address": F.length("address_norm") >= 8,
        "pin": F.col("pincode") != "", "phone": F.size("phones_all") > 0, "website": F.col("website_norm") != "",
    }
    first = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit(""))
    return step.select(
        "record_id", "name_normalized", F.col("forms.core").alias("name_core"), V.title_case(F.col("name_normalized")).alias("name_display"), "place_hint",
        F.col("forms.variants").alias("name_variants"), F.col("forms.acronym").alias("acronym_key"), "city_norm", P.display(F.col("city_norm")).alias("city_display"),
        "district_norm", P.display(F.col("district_norm")).alias("district_display"), F.col("state").alias("state_norm"), P.display(F.col("state")).alias("state_display"), "pincode", "address_norm",
        first("phones_all").alias("phone_norm"), "phones_all", first("emails_all").alias("email_norm"), "emails_all", "website_norm",
        F.substring_index("website_norm", "/", 1).alias("website_domain"), F.coalesce("reg.value", F.lit("")).alias("registration_id_norm"), F.coalesce("reg.kind", F.lit("")).alias("registration_type"),
        "category_norm", type_hint(F.col("name_normalized"), keywords or {}).alias("entity_type_hint"), "source_year", strength(have, F.col("emails_all"), F.col("reg")).alias("evidence_strength"),
        F.coalesce(F.try_element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int")), F.lit("ok")).alias("quality_severity"),
        F.transform("flags", lambda f: f["issue_type"]).alias("quality_flags"),
        # not said by the flags: all that makes them would go along
        resolvable.alias("is_resolvable"), "flags",
    )


def issues(cleaned: DataFrame) -> DataFrame:
    """(record_id, issue_type, severity, field, value): one row per flag."""
    # outer: for an inner one Spark infers filters on the flags, which it moves below the projections, expressions of expressions
    return cleaned.select("record_id", F.inline_outer("flags")).where("issue_type is not null")


def issues_of(raw: DataFrame, *kinds: str, gazetteer: P.Gazetteer = P.Gazetteer(), words: N.Words | None = None, id_col: str = "record_id") -> DataFrame:
    """The issues of ``kinds`` (of ``ISSUES``) in raw records, as ``issues`` gives them; nothing else is computed."""
    p, checks = _Parts(raw, gazetteer, words, id_col), _checks(list(gazetteer.states))
    made = F.concat(*[_flags(p, k, *checks[k]) for k in kinds])
    return p.frame().select("record_id", F.inline_outer(made)).where("issue_type is not null")


def records_with(raw: DataFrame, *kinds: str, gazetteer: P.Gazetteer = P.Gazetteer(), words: N.Words | None = None, id_col: str = "record_id") -> DataFrame:
    """(record_id, issue_type, severity): one row per raw record and kind of issue it has, however many values are at fault; only what tells is computed."""
    p, checks = _Parts(raw, gazetteer, words, id_col), _checks(list(gazetteer.states))

    def found(kind: str) -> Column:
        severity, _, wrong, value = checks[kind]
        return F.when(wrong(p) if value else F.size(wrong(p)) > 0, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity")))

    made = F.array(*map(found, kinds))
    return p.frame().select("record_id", F.inline_outer(made)).where("issue_type is not null")


def entity_issues(folded: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, issue_type, severity, field, value): entities with several values in a column that should have one."""
    wide = F.array_compact(F.array(*[F.when(F.col(f"{c}_values") > 1, F.struct(F.lit("entity_conflict").alias("issue_type"), F.lit("warning").alias("severity"), F.lit(c).alias("field"), F.col(f"{c}_values").cast("string").alias("value"))) for c in columns]))
    return folded.select(key, F.inline(wide))


def _duplicates(cleaned: DataFrame, seq: str, checkpoint) -> tuple[DataFrame, DataFrame]:
    """Records under their kinds and keys, and the groups of several with their primary.

    Equal name and phone, equal name and identifier, and equal in all that
    counts; groups are numbered through the three kinds in the order of their
    keys.  The primary says most, and of equals came first.
    """
    kinds = (
        ("exact_name_phone", "DP", " | ", ["name_normalized", "phone_norm"], F.col("phone_norm") != ""),
        ("exact_name_registration", "DR", " | ", ["name_normalized", "registration_id_norm"], F.col("registration_id_norm") != ""),
        ("identical_record", "DI", "|", ["name_normalized", "city_norm", "state_norm", "address_norm", "phone_norm", "email_norm", "registration_id_norm"], F.col("name_normalized") != ""),
    )
    # records that cannot be resolved get no kind; a filter would be moved below all projections
    made = F.array_compact(F.array(*[F.when(F.col("is_resolvable") & ok, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("dup_type"), F.lit(prefix).alias("prefix"), F.concat_ws(gap, *cols).alias("dup_key"))) for n, (kind, prefix, gap, cols, ok) in enumerate(kinds)]))
    # written: groups, the ranges that number them and the join would each clean all records again
    rows = checkpoint(cleaned.select("record_id", F.col(seq).alias("_seq"), "evidence_strength", F.inline(made)), "rows")
    groups = rows.groupBy("n", "dup_type", "prefix", "dup_key").agg(F.count("*").alias("size"), F.max_by("record_id", F.struct("evidence_strength", (-F.col("_seq")).alias("s"))).alias("_first")).where("size > 1")
    return rows, groups


def numbered_groups(cleaned: DataFrame, seq: str, checkpoint, width: int = 6) -> DataFrame:
    """(group_id, dup_type, dup_key, record_id, is_primary) of equal records; groups are dealt to ranges of (kind, key), so no task numbers all of them."""
    from tidemark.operators.offers import numbered

    rows, groups = _duplicates(cleaned, seq, checkpoint)
    order = F.concat(F.col("n").cast("string"), F.lit("\u0001"), F.col("dup_key"))
    named = numbered(groups.withColumn("_order", order), "_order", "", checkpoint, width).drop("entity_id")
    g = named.select(F.col("n").alias("_n"), F.col("dup_key").alias("_k"), "_first", F.concat_ws("-", "prefix", "no").alias("group_id"))
    return rows.join(g, (rows["n"] == g["_n"]) & (rows["dup_key"] == g["_k"])).select(
        "group_id", "dup_type", "dup_key", "record_id", F.col("record_id").eqNullSafe(F.col("_first")).alias("is_primary"))
