"""How well a rating's description fits a vehicle: rules that turn what is known of the vehicle into weighted tokens, matched with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum, squash

# fixed values: what is known (a field that holds a word; "=": is the word; "#": holds it when only letters and digits are left; "-": without blanks), any of which makes
# the rule hold, and the tokens that then count if the description holds them, with their weights
BODY_RULES = [
    (["body:FOUR DOOR SEDAN", "body:4 DOOR SEDAN"], [("4 DR", 10), ("4-DR", 10), ("SEDAN", 4)]),
    (["body:TWO DOOR", "body:2 DOOR"], [("2 DR", 12), ("2-DR", 12), ("COUPE", 6)]),
    (["body:FIVE DOOR", "body:HATCH"], [("5 HB", 12), ("HATCH", 7), ("HB", 4)]),
    (["body:THREE DOOR"], [("3 HB", 12), ("3-DR", 12), ("3 DR", 12)]),
    (["body:STATION WAGON"], [("SW", 12), ("WAGON", 10)]),
    (["body:MINIVAN"], [("VAN", 8), ("MINIVAN", 12)]),
    (["body:UTILITY", "body:SUV"], [("SUV", 12), ("UTILITY", 6)]),
    (["body:EXTENDED CAB"], [("PU/EC", 15), ("SUPERCAB", 15), ("SUPER CAB", 15), ("EXTENDED", 10)]),
    (["body:4 DOOR PICKUP", "body:FOUR DOOR PICKUP"], [("PU/CC", 13), ("CREW", 11), ("SUPER CREW", 15), ("DOUBLE CAB", 15)]),
    (["body:PICKUP", "body=TRUCK"], [("PU", 3)]),
    (["body:CONVERTIBLE"], [("CONVERTIBLE", 15), (" C ", 8)]),
    (["model#SUPERCREW", "model:SUPER CREW"], [("SUPER CREW", 25), ("SUPERCREW", 25), ("PU/CC", 12)]),
    (["model#SUPERCAB", "model:SUPER CAB"], [("SUPERCAB", 25), ("SUPER CAB", 25), ("PU/EC", 12)]),
    (["model:DOUBLE CAB"], [("DOUBLE CAB", 25)]),
    (["model:REGULAR CAB"], [("REGULAR CAB", 25), ("PU/RC", 15)]),
    (["body_class:PICKUP"], [("PU", 4)]),
    (["body_class:SPORT UTILITY", "body_class:SUV"], [("SUV", 7)]),
    (["body_class:HATCH"], [("HB", 6), ("HATCH", 8)]),
    (["body_class:WAGON"], [("SW", 9), ("WAGON", 8)]),
    (["body_class:COUPE"], [("2 DR", 6), ("COUPE", 8)]),
    (["body_class:SEDAN"], [("4 DR", 6), ("SEDAN", 5)]),
    (["cab:CREW"], [("PU/CC", 14), ("CREW", 12), ("SUPER CREW", 12), ("CREWMAX", 12)]),
    (["cab:EXTRA", "cab:SUPER", "cab:QUAD", "cab:DOUBLE", "cab:KING", "cab:EXTENDED"], [("PU/EC", 14), ("EXTENDED", 10), ("SUPER CAB", 10), ("SUPERCAB", 10)]),
    (["cab:REGULAR"], [("PU/RC", 14), ("REGULAR CAB", 12)]),
    (["series:DOUBLE CAB"], [("DOUBLE CAB", 20), ("PU/EC", 10)]),
    (["series:QUAD CAB"], [("QUAD CAB", 20), ("PU/EC", 10)]),
    (["series:EXTRA CAB", "series:EXTENDED CAB"], [("EXTENDED", 18), ("PU/EC", 10)]),
    (["series:SUPERCREW", "series:SUPER CREW"], [("SUPER CREW", 20), ("PU/CC", 10)]),
    (["series:WAGON"], [("WAGON", 10), ("SW", 8)]),
    (["series:HATCH"], [("HATCH", 10), ("HB", 8)]),
    (["trim:DOUBLE CAB"], [("DOUBLE CAB", 20), ("PU/EC", 10)]),
    (["trim:QUAD CAB"], [("QUAD CAB", 20), ("PU/EC", 10)]),
    (["trim:EXTRA CAB", "trim:EXTENDED CAB"], [("EXTENDED", 18), ("PU/EC", 10)]),
    (["trim:SUPERCREW", "trim:SUPER CREW"], [("SUPER CREW", 20), ("PU/CC", 10)]),
    (["trim:WAGON"], [("WAGON", 10), ("SW", 8)]),
    (["trim:HATCH"], [("HATCH", 10), ("HB", 8)]),
    (["doors=4"], [("4 DR", 8), ("4-DR", 8)]),
    (["doors=2"], [("2 DR", 8), ("2-DR", 8)]),
    (["electrification:ELECTRIC", "fuel=ELECTRIC"], [("ELECTRIC", 16), ("EV", 10)]),
    (["electrification:HYBRID", "second_fuel:ELECTRIC"], [("HYBRID", 14), ("HEV", 12), ("PHEV", 12)]),
]
DRIVE_RULES = [
    (["drive:AWD", "drive:4WD", "drive:4-WHEEL", "drive:4X4"], [("AWD", 25), ("4WD", 25), ("4X4", 25)]),
    (["drive:4X2", "drive:4 X 2", "drive-4X2"], [("4X2", 20), ("FWD", 18), ("RWD", 18)]),
    (["drive:FWD", "drive:FRONT"], [("FWD", 25)]),
    (["drive:RWD", "drive:REAR"], [("RWD", 25)]),
]
# fixed values: what the body says, what the description must not say then, and the reason
AGAINST = [(["body:FOUR DOOR SEDAN", "body:4 DOOR SEDAN"], ["2-DR", "2 DR", "COUPE"], "neg:2dr-vs-4dr"), (["body:TWO DOOR", "body:2 DOOR"], ["4-DR", "4 DR", "SEDAN"], "neg:4dr-vs-2dr")]
PENALTY, MODEL_TEXT, DIRECT, DECODED = 18, 4, 2, 3

FIELDS = ("body", "model", "body_class", "cab", "series", "trim", "doors", "electrification", "fuel", "second_fuel", "drive")


def _upper(c: Column) -> Column:
    return F.coalesce(squash(F.upper(c)), F.lit(""))


def _holds(alternatives: list[str], clean: dict[str, Column], bare: dict[str, Column]) -> Column:
    forms = {":": lambda f, w: clean[f].contains(w), "=": lambda f, w: clean[f] == w, "#": lambda f, w: bare[f].contains(w), "-": lambda f, w: F.replace(clean[f], F.lit(" "), F.lit("")).contains(w)}
    out = F.lit(False)
    for a in alternatives:
        at = min(a.find(c) for c in forms if c in a)
        out = out | forms[a[at]](a[:at], a[at + 1 :])
    return out


def _hits(name: str, rules: list[tuple[list[str], list[tuple[str, int]]]], clean: dict[str, Column], bare: dict[str, Column], said: Column) -> Column:
    """The distinct (token, weight) of the rules that hold which the description has, in the rules' order, as weights and reasons."""
    cells = [F.when(_holds(when, clean, bare) & said.contains(t), F.struct(F.lit(w).alias("n"), F.lit(f"{name}:{t.strip()}+{w}").alias("why"), F.lit(t).alias("token"))) for when, tokens in rules for t, w in tokens]
    return F.transform(F.array_distinct(F.array_compact(F.array(*cells))), lambda x: F.struct(x["n"].alias("n"), x["why"].alias("why")))


def _all(clean: dict[str, Column], bare: dict[str, Column], said: Column, said_bare: Column) -> Column:
    """All that counts, as weights and reasons; clean and said: upper case and squashed; bare: letters and digits only."""
    parts = [_hits("body", BODY_RULES, clean, bare, said), _hits("drive", DRIVE_RULES, clean, bare, said)]
    none = F.array().cast("array<struct<n:int,why:string>>")
    one = lambda when, n, why: F.when(when, F.array(F.struct(F.lit(n).alias("n"), F.lit(why).alias("why")))).otherwise(none)
    for when, words, why in AGAINST:
        denied = F.lit(False)
        for w in words:
            denied = denied | said.contains(w)
        parts.append(one(_holds(when, clean, bare) & denied, -PENALTY, why))
    parts.append(one((bare["model"] != "") & said_bare.contains(bare["model"]), MODEL_TEXT, f"model_text+{MODEL_TEXT}"))
    return F.concat(*parts)


def _total(all_: Column, method: Column | None) -> Column:
    total = F.aggregate(all_, F.lit(0), lambda a, x: a + x["n"])
    if method is not None:
        total = total + F.when(method == "direct", DIRECT).when(method.startswith("vpic"), DECODED).otherwise(0)
    return total


def score(known: dict[str, Column], description: Column, method: Column | None = None) -> tuple[Column, Column]:
    """(score, reasons) of a description for a vehicle of which `known` says what is known (FIELDS; what is left out is empty).

    method: how the candidate was found; `direct` and what begins with `vpic` add a little.  Reasons stand in the order of the rules."""
    clean = {f: _upper(known[f]) if f in known else F.lit("") for f in FIELDS}
    said = _upper(description)
    all_ = _all(clean, {"model": alnum(clean["model"])}, said, alnum(said))
    return _total(all_, method), F.transform(all_, lambda x: x["why"])


def scored(df: DataFrame, known: dict[str, Column], description: Column, method: Column | None = None) -> DataFrame:
    """Adds score and reasons of `score`: normal forms, hits and sums by projections of their own, so that each is worked out once a row and not at every use."""
    forms = df.select("*", *[_upper(c).alias(f"_is_{f}") for f, c in known.items()], _upper(description).alias("_said"))
    clean = {f: F.col(f"_is_{f}") if f in known else F.lit("") for f in FIELDS}
    bare = forms.select("*", alnum(clean["model"]).alias("_bare"), alnum(F.col("_said")).alias("_said_bare"))
    hits = bare.select(*df.columns, _all(clean, {"model": F.col("_bare")}, F.col("_said"), F.col("_said_bare")).alias("_all"))
    return hits.select(*df.columns, _total(F.col("_all"), method).alias("score"), F.transform("_all", lambda x: x["why"]).alias("reasons"))
