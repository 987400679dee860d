"""Text columns: normal forms, semantic values, parts of URLs.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK, MISSING_MARK = "<NULL>", "<MISSING>"


def squash(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Trimmed, upper-cased, squashed; empty becomes null."""
    return F.nullif(squash(F.upper(c)), F.lit(""))


def alnum(c: Column) -> Column:
    """Upper-case letters and digits only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")


def family_key(c: Column) -> Column:
    """Upper-cased, dashes and blanks as single underscores."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[-\s]+", "_"), "_+", "_"), F.lit("_"))


def display_value(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def code_value(c: Column) -> Column:
    """The normal form of a displayed value: upper case, blank, slash and dash as underscore."""
    return F.translate(normalize_text(c.cast("string")), " /-", "___")


def semantic_value(c: Column, missing: Column | None = None) -> Column:
    """Text for keys, in which null, empty and missing are marked."""
    out = F.coalesce(normalize_text(c.cast("string")), F.lit(NULL_MARK))
    return out if missing is None else F.when(missing, F.lit(MISSING_MARK)).otherwise(out)


def semantic_hash(**parts: Column) -> Column:
    """sha256 of name=value parts in the order given."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{k}="), semantic_value(v)) for k, v in parts.items()]), 256)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def url_path(url: Column) -> Column:
    """The path of a URL, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def filename(url: Column) -> Column:
    return F.nullif(F.substring_index(url_path(url), "/", -1), F.lit(""))


def extension(url: Column) -> Column:
    """With the dot, lower case; null if the name has none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(filename(url), F.lit("")), r"^.+(\.[^.]+)$", 1)), F.lit(""))


def quote(c: Column) -> Column:
    """Percent-encoding of a path or query part, blanks as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def render_url(template: str, query: list[str], values: dict[str, Column]) -> Column:
    """A URL from a template with {names}, and a query string of those names."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), quote(values[name].cast("string"))]
    out.append(F.lit(rest))
    pairs = [F.concat(F.lit(f"{k}="), quote(values[k].cast("string"))) for k in query]
    return F.concat(*out, *([F.lit("?"), F.concat_ws("&", *pairs)] if pairs else []))


def clean_sample(c: Column, most: int = 120) -> Column:
    """A sample value for reports: no scheme, at most so many characters."""
    return F.substring(F.regexp_replace(c, r"^https?://", ""), 1, most)


def compact(*flags: Column) -> Column:
    """An array of the non-null columns, in order."""
    return F.array_compact(F.array(*flags))


def flag(name: str, when: Column) -> Column:
    return F.when(when, F.lit(name))
