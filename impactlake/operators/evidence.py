"""What test reports say of a vehicle against the candidates of its subject: features of both, agreement, contradictions by group, and a choice if one candidate leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash

# fixed values: feature and what shows it in a text of upper-case letters, digits and single blanks ("^": with a blank set before the text; "#": without blanks)
FEATURES = [
    ("AWD", [" AWD", "4WD", "4 WHEEL", "4X4"]),
    ("FWD", ["^ FWD", "FRONT WHEEL"]),
    ("RWD", ["^ RWD", "REAR WHEEL"]),
    ("4X2", ["4X2", "4 X 2"]),
    ("CREW_CAB", ["PU CC", "CREW"]),
    ("QUAD_CAB", ["QUAD CAB"]),
    ("DOUBLE_CAB", ["DOUBLE CAB"]),
    ("EXTENDED_CAB", ["PU EC", "EXTENDED", "SUPER CAB", "SUPERCAB"]),
    ("REGULAR_CAB", ["PU RC", "REGULAR CAB"]),
    ("SUV", ["SUV"]),
    ("4DR", ["4 DR", "4DR"]),
    ("2DR", ["2 DR", "2DR"]),
    ("3HB", ["3 HB", "#3DR"]),
    ("5HB", ["5 HB", "#5DR", "5 DOOR"]),
    ("WAGON", ["WAGON", "^ SW"]),
    ("HATCH", ["HATCH", "^ HB"]),
    ("CONVERTIBLE", ["CONVERTIBLE"]),
    ("COUPE", ["COUPE"]),
    ("HYBRID", ["HYBRID", "HEV"]),
    ("ELECTRIC", ["ELECTRIC", "^ EV"]),
    ("SAB", ["^ W SAB", "SIDE AIR"]),
    ("EARLY_RELEASE", ["EARLY RELEASE"]),
    ("LATER_RELEASE", ["LATER RELEASE"]),
    ("LATEST_RELEASE", ["LATEST RELEASE"]),
]
# fixed values: features that exclude one another
GROUPS = [["AWD", "FWD", "RWD", "4X2"], ["CREW_CAB", "EXTENDED_CAB", "REGULAR_CAB", "QUAD_CAB", "DOUBLE_CAB"], ["2DR", "3HB", "4DR", "5HB", "WAGON", "CONVERTIBLE", "COUPE"], ["HYBRID", "ELECTRIC"], ["EARLY_RELEASE", "LATER_RELEASE", "LATEST_RELEASE"]]
# fixed values: lines that are about the test and not the vehicle, unless they name a year
NOISE = ["DRIVER", "PASSENGER", "CAMERA", "VELOCITY", "PROCEDURE", "WARNING LAMP"]
# fixed values: words of lines that name a vehicle
KEYWORDS = ["AWD", "FWD", "RWD", "4X4", "4X2", "4WD", "2WD", "CREW CAB", "QUAD CAB", "DOUBLE CAB", "EXTENDED CAB", "SUPER CAB", "SUPERCAB", "REGULAR CAB", "SUV", "TRUCK", "SEDAN", "HATCHBACK", "WAGON", "CONVERTIBLE", "COUPE", "HYBRID", "ELECTRIC", "SIDE AIR", "AIRBAG", "AIR BAG"]
CONTRADICTION, SHORTEST, LONGEST, LINES = 3, 8, 180, 220


def plain(text_: Column) -> Column:
    """Upper-case letters and digits, all else single blanks."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text_, F.lit(""))), "[^A-Z0-9]+", " "))


def shows(u: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        side = F.concat(F.lit(" "), u) if m[0] == "^" else F.replace(u, F.lit(" "), F.lit("")) if m[0] == "#" else u
        out = out | side.contains(m.lstrip("^#"))
    return out


def features(text_: Column) -> Column:
    """The features a description shows, as a sorted array."""
    u = plain(text_)
    return F.sort_array(F.array_compact(F.array(*[F.when(shows(u, marks), name) for name, marks in FEATURES])))


def report_features(text_: Column, keywords: list[str] = KEYWORDS, lines: int = LINES) -> Column:
    """Features of the lines of a report that look like a vehicle's name: not too short or long, with one of the keywords, and not about the test itself.

    Of the lines that hold anything the first `lines` are looked at: titles stand there."""
    each = F.filter(F.transform(F.split(F.coalesce(text_, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), squash), lambda x: x != "")
    of_line = lambda x: _vehicle_line(x, keywords)
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(F.slice(each, 1, lines), of_line), features))))


def _vehicle_line(line: Column, keywords: list[str]) -> Column:
    u = plain(line)
    return F.length(u).between(SHORTEST, LONGEST) & shows(u, keywords) & (~shows(u, NOISE) | u.rlike(r"\b(20\d\d|19\d\d)\b"))


def contradictions(a: Column, b: Column) -> Column:
    """In how many groups both say something and nothing in common."""
    out = F.lit(0)
    for g in GROUPS:
        own = F.array(*map(F.lit, g))
        x, y = F.array_intersect(a, own), F.array_intersect(b, own)
        out = out + F.when((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y), 1).otherwise(0)
    return out


def weighed(candidates: DataFrame, reports: DataFrame, subject: str, description: str, found: str = "features") -> DataFrame:
    """Candidates with agreement (shared features), contradictions and evidence_score, by what all reports of the subject show together.

    reports: subject and an array of features, any number a subject; their union is made before the join, so a candidate meets one row.  Subjects without reports have empty features."""
    per = reports.select(subject, F.explode(found).alias("f")).groupBy(subject).agg(F.sort_array(F.collect_set("f")).alias("report_features"))  # at most as many as there are features
    out = candidates.join(per, subject, "left").withColumn("report_features", F.coalesce("report_features", F.array().cast("array<string>"))).withColumn("candidate_features", features(F.col(description)))
    a, b = F.col("report_features"), F.col("candidate_features")
    scored = out.withColumn("agreement", F.size(F.array_intersect(a, b))).withColumn("contradictions", contradictions(a, b))
    return scored.withColumn("evidence_score", F.col("agreement") - CONTRADICTION * F.col("contradictions"))


def chosen(scored: DataFrame, subject: str, candidate: str, order: list[str]) -> DataFrame:
    """Per subject the candidate that leads, if it agrees in something and by more than the next one: selected, top_score, second_score (-999 for none), status."""
    w = Window.partitionBy(subject).orderBy(F.desc("evidence_score"), *order)
    two = scored.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    by = two.groupBy(subject).agg(at(1, candidate).alias("_first"), at(1, "evidence_score").alias("top_score"), F.coalesce(at(2, "evidence_score"), F.lit(-999)).alias("second_score"))
    leads = (F.col("top_score") >= 1) & (F.col("top_score") - F.col("second_score") >= 1)
    return by.select(subject, F.when(leads, F.col("_first")).alias("selected"), "top_score", "second_score", F.when(leads, "REPORT_DISAMBIGUATED").otherwise("REPORT_REVIEW").alias("status"))
