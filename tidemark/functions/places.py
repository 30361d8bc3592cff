"""Places: states, cities and postal zones as evidence; nothing here fills in what a record does not say."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import validate as V

# States with other spellings and their codes.
STATES = {
    "rajasthan": ["rj", "raj"], "haryana": ["hr"], "delhi": ["dl", "new delhi", "nct of delhi"], "gujarat": ["gj"], "maharashtra": ["mh"],
    "uttar pradesh": ["up"], "madhya pradesh": ["mp"], "punjab": ["pb"], "chandigarh": ["ch"], "karnataka": ["ka"], "tamil nadu": ["tn"],
    "west bengal": ["wb"], "telangana": ["ts", "tg"], "kerala": ["kl"], "bihar": ["br"], "uttarakhand": ["uk", "uttaranchal"],
    "himachal pradesh": ["hp"], "andhra pradesh": ["ap"], "odisha": ["or", "orissa"], "assam": ["as"], "jharkhand": ["jh"], "goa": ["ga"],
}
# Other names of cities.
CITY_SYNONYMS = {
    "gurgaon": "gurugram", "bombay": "mumbai", "bangalore": "bengaluru", "calcutta": "kolkata", "madras": "chennai", "poona": "pune",
    "allahabad": "prayagraj", "new delhi": "delhi", "jaipur city": "jaipur", "jodhpur city": "jodhpur", "kota city": "kota",
    "sriganganagar": "sri ganganagar", "ganganagar": "sri ganganagar", "s madhopur": "sawai madhopur", "sawaimadhopur": "sawai madhopur",
    "bhilwada": "bhilwara", "chittaurgarh": "chittorgarh", "jhunjhunun": "jhunjhunu", "banswada": "banswara", "trivandrum": "thiruvananthapuram",
    "cochin": "kochi",
}
# Well-known cities by state.
CITIES = {
    "rajasthan": ["jaipur", "jodhpur", "kota", "ajmer", "udaipur", "bikaner", "alwar", "bhilwara", "sri ganganagar", "sawai madhopur"],
    "haryana": ["gurugram", "faridabad", "ambala", "panipat", "rohtak"], "delhi": ["delhi"], "gujarat": ["ahmedabad", "surat", "vadodara"],
    "maharashtra": ["mumbai", "pune", "nagpur"], "uttar pradesh": ["lucknow", "kanpur", "agra", "prayagraj"], "karnataka": ["bengaluru", "mysuru"],
    "tamil nadu": ["chennai", "coimbatore"], "west bengal": ["kolkata"], "telangana": ["hyderabad"], "kerala": ["kochi", "thiruvananthapuram"],
}
# States by the first two digits of a postal code.
PIN_STATES = {"11": "delhi", "12": "haryana", "13": "haryana", "30": "rajasthan", "31": "rajasthan", "32": "rajasthan", "33": "rajasthan", "34": "rajasthan"}
# Short words of addresses.
ADDRESS_WORDS = {
    "rd": "road", "nr": "near", "opp": "opposite", "blk": "block", "bldg": "building", "hsg": "housing", "stn": "station", "hwy": "highway",
    "ext": "extension", "apts": "apartments", "flr": "floor", "sq": "square", "cir": "circle",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """``table[key]``, or null; tables are dictionaries of the user's, small enough for a plan."""
    if not table:
        return F.lit(None).cast("string")
    # a map is searched entry by entry, a set of keys is not
    return F.when(key.isin(list(table)), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key))


@dataclass(frozen=True)
class Gazetteer:
    states: dict[str, list[str]] = field(default_factory=lambda: STATES)
    synonyms: dict[str, str] = field(default_factory=lambda: CITY_SYNONYMS)
    cities: dict[str, list[str]] = field(default_factory=lambda: CITIES)
    pins: dict[str, str] = field(default_factory=lambda: PIN_STATES)
    extra: tuple[str, ...] = ()

    def aliases(self) -> dict[str, str]:
        """Every spelling of a state and the state; a state's own name counts first."""
        out = {s: s for s in self.states}
        for s, names in self.states.items():
            for n in names:
                out.setdefault(n, s)
        return out

    def city_states(self) -> dict[str, str]:
        return {c: s for s, cities in self.cities.items() for c in cities}

    def places(self) -> tuple[str, ...]:
        """Every place that a name may end in."""
        return tuple(sorted({*self.city_states(), *self.aliases(), *self.extra}))

    def primed(self, names: Iterable[str]) -> Gazetteer:
        """With more places, as they occur in the data: normal names of three letters or more that are no numbers."""
        return replace(self, extra=tuple(sorted({*self.extra, *(n for n in names if len(n) >= 3 and not n.isdigit())})))

    def state(self, c: Column) -> Column:
        return self.state_of(T.normal(c))

    def state_of(self, n: Column) -> Column:
        """``state`` of a normal form."""
        return F.coalesce(lookup(self.aliases(), n), n)

    def synonym(self, n: Column) -> Column:
        """The city that a normal form is another name of, else itself."""
        return F.coalesce(lookup(self.synonyms, n), n)

    def before_state(self, n: Column) -> Column:
        """A normal form without a state's name or alias of over three letters behind."""
        long = sorted((a for a in self.aliases() if len(a) > 3), key=lambda a: (-len(a), a))
        return F.regexp_replace(n, "(?<=..) (?:" + "|".join(map(re.escape, long)) + ")$", "") if long else n

    def city(self, c: Column) -> Column:
        """A synonym's city; a state's name or alias of over three letters behind a city goes."""
        return self.synonym(self.before_state(self.synonym(T.normal(c))))

    def district(self, c: Column) -> Column:
        return self.synonym(self.undistrict(T.normal(c)))

    def undistrict(self, n: Column) -> Column:
        """A normal form without the word district behind."""
        return F.regexp_replace(n, r"\s+(district|dist)$", "")

    def state_of_city(self, city: Column) -> Column:
        return lookup(self.city_states(), city)

    def state_of_pin(self, pin: Column) -> Column:
        return lookup(self.pins, F.left(pin, F.lit(2)))


def observed_places(records: DataFrame, *columns: str, most: int = 20_000) -> list[str]:
    """Distinct normal places of ``columns``, the most frequent ``most``: what a gazetteer is primed with on the driver."""
    stacked = records.select(F.explode(F.array(*[T.normal(F.col(c)) for c in columns])).alias("place")).where("place <> ''")
    return [r["place"] for r in stacked.groupBy("place").count().orderBy(F.desc("count"), "place").limit(most).collect()]


def address(c: Column, words: dict[str, str] | None = None) -> Column:
    """Normal form with short words spelt out."""
    return address_of(T.normal(c), words)


def address_of(n: Column, words: dict[str, str] | None = None) -> Column:
    """``address`` of a normal form."""
    table = ADDRESS_WORDS if words is None else words
    return F.array_join(F.transform(F.split(n, " "), lambda t: F.coalesce(lookup(table, t), t)), " ")


def display(c: Column) -> Column:
    """A normal place as people write it."""
    return V.title_case(c)
