"""Vehicle names, identifiers and descriptions for record linkage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum, compact, flag, squash

# fixed values: makes that are written in more than one way
MAKE_ALIASES = {
    "MERCEDES": ["MERCEDES-BENZ"], "MERCEDESBENZ": ["MERCEDES-BENZ"], "VW": ["VOLKSWAGEN"], "CHEVY": ["CHEVROLET"],
    "RAM": ["RAM", "DODGE"], "DODGE": ["DODGE", "RAM"], "LANDROVER": ["LAND ROVER"], "ROLLSROYCE": ["ROLLS-ROYCE"],
}

# fixed values: what a description says about body and drive
FEATURES = {
    "awd": r"\b(AWD|ALL[ -]WHEEL)\b", "4wd": r"\b(4WD|4X4|FOUR[ -]WHEEL)\b", "fwd": r"\b(FWD|FRONT[ -]WHEEL)\b", "rwd": r"\b(RWD|REAR[ -]WHEEL|4X2|2WD)\b",
    "sedan": r"\b(SEDAN|4[ -]?DR|4 DOOR)\b", "coupe": r"\b(COUPE|2[ -]?DR|2 DOOR)\b", "hatchback": r"\b(HATCHBACK|5[ -]?HB|3[ -]?HB|HB)\b", "wagon": r"\b(WAGON|SW)\b", "convertible": r"\bCONVERTIBLE\b",
    "suv": r"\b(SUV|SPORT UTILITY)\b", "van": r"\b(VAN|MINIVAN)\b", "pickup": r"\b(PU|PICKUP|TRUCK)\b", "crew_cab": r"\b(CREW|SUPERCREW|CREWMAX|QUAD)\b", "extended_cab": r"\b(EXTENDED|SUPERCAB|SUPER CAB|ACCESS|DOUBLE) ?CAB\b|\bSUPERCAB\b", "regular_cab": r"\bREGULAR CAB\b",
    "hybrid": r"\b(HYBRID|HEV|PHEV)\b", "electric": r"\b(BEV|ELECTRIC|EV)\b", "diesel": r"\bDIESEL\b", "early": r"\bEARLY (RELEASE|PRODUCTION)\b", "later": r"\bLATER (RELEASE|PRODUCTION)\b", "side_bags": r"\bSAB\b", "no_side_bags": r"\b(W/O|NO) SAB\b",
}
GROUPS = {"drive": ["awd", "4wd", "fwd", "rwd"], "body": ["sedan", "coupe", "hatchback", "wagon", "convertible", "suv", "van", "pickup"], "cab": ["crew_cab", "extended_cab", "regular_cab"], "release": ["early", "later"]}


def make_aliases(make: Column) -> Column:
    """The make itself, then its other names, without repeats."""
    table = F.create_map(*[x for k, v in MAKE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(F.array(squash(F.upper(make))), F.coalesce(table[alnum(make)], F.array().cast("array<string>"))))


def model_aliases(model: Column) -> Column:
    """The model, and without trailing body or cab words, and its first word."""
    m = squash(F.upper(model))
    short = F.trim(F.regexp_replace(m, r"\b(SUPERCREW|SUPERCAB|CREW CAB|QUAD CAB|REGULAR CAB|SEDAN|COUPE|HYBRID|WAGON)\b.*$", ""))
    return F.array_distinct(F.filter(F.array(m, short, F.regexp_replace(short, r"^([A-Z])[ -](\d)", "$1$2")), lambda x: x.isNotNull() & (x != "")))


def vin_valid(vin: Column) -> Column:
    """17 characters of the VIN alphabet, none masked."""
    v = F.upper(F.trim(vin))
    return F.coalesce(v.rlike("^[A-HJ-NPR-Z0-9]{17}$") & ~v.contains("XXX"), F.lit(False))


def features(description: Column) -> Column:
    """The names of the features a description mentions."""
    d = F.upper(F.coalesce(description, F.lit("")))
    return compact(*[flag(name, d.rlike(pattern)) for name, pattern in FEATURES.items()])


def contradictions(a: Column, b: Column) -> Column:
    """Groups in which two feature sets both say something and share nothing."""
    out = []
    for group, names in GROUPS.items():
        own = F.array(*map(F.lit, names))
        x, y = F.array_intersect(a, own), F.array_intersect(b, own)
        out.append(flag(group, (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)))
    return compact(*out)


def token_score(rules: list[tuple[str, int]], description: Column) -> Column:
    """The sum of the weights of the distinct tokens that a description contains."""
    d = F.upper(F.coalesce(description, F.lit("")))
    rules = list(dict.fromkeys((t.upper(), w) for t, w in rules))
    out = F.lit(0)
    for token, weight in rules:
        out = out + F.when(d.contains(token), weight).otherwise(0)
    return out


def model_name_score(db: Column, api: Column, make: Column) -> Column:
    """How well a model's name in one list fits the name in another; 0 if it does not."""
    a, b = alnum(db), alnum(api)
    bare = F.regexp_replace(b, F.concat(F.lit("^"), alnum(make)), F.lit(""))
    x, y = (F.array_distinct(F.filter(F.split(F.upper(c), "[^A-Z0-9]+"), lambda w: F.length(w) > 1)) for c in (db, api))
    common = F.size(F.array_intersect(x, y))
    return (
        F.when((a == "") | (b == ""), 0)
        .when((a == b) | (a == bare), 100)
        .when(a.startswith(b) & (F.length(b) >= 4), 86)
        .when((b.startswith(a) & (F.length(a) >= 4)) | (bare.startswith(a) & (F.length(a) >= 2)), 76)
        .when((common > 0) & (common == F.size(x)), 70)
        .when((common > 0) & (common == F.size(y)), 76)
        .otherwise(0)
    )
