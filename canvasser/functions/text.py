"""Column expressions over names, titles, keys, addresses and numbers.

Everything here is built from Spark's own functions, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvasser import schema as M

BLANK = r"(?U)\s+"
# The characters with the Unicode white-space property.
_SPACES = (
    " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels(c: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed map, or ``default`` (null)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _col(c))
    return found if default is None else F.coalesce(found, default)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(_col(c), F.lit(_SPACES))


def squeeze(c: Column | str) -> Column:
    """Trimmed text with each run of white space as one space."""
    return F.trim(F.regexp_replace(_col(c), BLANK, " "))


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c != "", c)


def clean_text(c: Column | str) -> Column:
    """Trimmed text; empty becomes null."""
    return blank_to_null(strip(_col(c).cast("string")))


def normalize_text(c: Column | str) -> Column:
    """Lower case, trimmed, white-space runs as one space; null becomes empty."""
    return F.coalesce(squeeze(F.lower(_col(c).cast("string"))), F.lit(""))


# Decimal number text with an optional exponent; single underscores may part digits.
NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"


def number(c: Column | str) -> Column:
    """The double that decimal text stands for, null for any other text (suffixes, hexadecimal)."""
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def safe_int(c: Column | str) -> Column:
    """Integer part of numeric text, null for anything that is not a number."""
    text = strip(_col(c).cast("string"))
    value = number(text)
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    usable = ~F.lower(text).isin(M.NULL_WORDS) & (F.abs(value) < 9.2e18)
    return F.when(usable, whole).cast("bigint")


def slug(c: Column | str) -> Column:
    dashed = F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def normalize_facility_key(c: Column | str) -> Column:
    """Each part between bars trimmed, lowered and squeezed."""
    # One blank at most is left beside a bar, so the whole key is cleaned at once, part by part.
    text = F.regexp_replace(F.lower(_col(c)), BLANK, " ")
    bar = F.lit("|")
    return F.trim(F.replace(F.replace(text, F.lit(" |"), bar), F.lit("| "), bar))


def facility_key(existing, county, name, city, zipcode, nces) -> Column:
    """An existing key, else county|name|city|zip, else nces|id, else null."""
    columns = (existing, county, name, city, zipcode, nces)
    own, area, title, place, post, number = (F.coalesce(strip(c), F.lit("")) for c in columns)
    return (
        F.when(own != "", own)
        .when((title != "") & (place != ""), F.concat_ws("|", area, title, place, post))
        .when((number != "") & ~F.lower(number).isin(M.NULL_WORDS), F.concat(F.lit("nces|"), number))
    )


def city_school_key(name) -> Column:
    """Key of a school known from the city directory only (the prefix is a fixed value)."""
    return F.concat(F.lit("cps|"), slug(name))


def letter_title(c: Column | str) -> Column:
    """First letter of each run of letters upper, the others lower ("o'brien" -> "O'Brien")."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{Ll}+|[^\p{Ll}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def word_title(c: Column | str) -> Column:
    """First character of each word upper, the others lower."""
    words = F.split(squeeze(F.coalesce(_col(c), F.lit(""))), " ", -1)
    raised = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    )
    return F.array_join(raised, " ")


def normalize_facility_name(c: Column | str) -> Column:
    """Spelled-out, punctuation-free form of a school or city name, for matching."""
    text = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    # Fixed values, applied in this order.
    steps = [
        ("&", " and "),
        (r"st\.", "saint"),
        (r"(?U)\bst\b", "saint"),
        (r"(?U)\bsch\b", "school"),
        (r"(?U)\bjr\b", "junior"),
        (r"(?U)\bsr\b", "senior"),
        (r"(?U),\s*(il|illinois)\b", ""),
        (r"(?U)\billinois\b", ""),
        ("[^a-z0-9]+", " "),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def preferred_website(current, candidate) -> Column:
    """Of two addresses the one to keep: any over none, https over others, then the longer."""
    cur, cand = (F.coalesce(strip(c), F.lit("")) for c in (current, candidate))
    secure = lambda c: c.startswith("https://")
    take = (secure(cand) & ~secure(cur)) | (F.length(cand) > F.length(cur))
    return F.when(take, cand).otherwise(cur)


def normalize_urls(c: Column | str) -> Column:
    """Trimmed, non-blank, distinct elements in first-seen order."""
    trimmed = F.transform(_col(c), lambda u: F.coalesce(strip(u), F.lit("")))
    return F.array_distinct(F.filter(trimmed, lambda u: u != ""))


def build_urls(base: Column | str, paths: Iterable[str]) -> Column:
    root = F.regexp_replace(_col(base), "/+$", "")
    return F.array_distinct(F.array(*[F.concat(root, F.lit(p)) for p in paths]))


def is_valid_email(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def split_name(c: Column | str) -> Column:
    """Struct(first, last): the text before and after the first space."""
    text = F.coalesce(strip(c), F.lit(""))
    at = F.instr(text, " ")
    first = F.when(at > 0, F.substring_index(text, " ", 1)).otherwise(text)
    last = F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise(F.lit(""))
    return F.struct(first.alias("first"), last.alias("last"))


def full_name(first: Column | str, last: Column | str) -> Column:
    return strip(F.concat_ws(" ", _col(first), _col(last)))


def classify_role(title: Column | str) -> Column:
    """Role of a stored job title; anything unknown is a principal."""
    low = F.lower(_col(title))
    chain = None
    for words, role in M.ROLE_TITLE_WORDS:
        hit = low.contains(words[0])
        for word in words[1:]:
            hit = hit | low.contains(word)
        chain = F.when(hit, role) if chain is None else chain.when(hit, role)
    return chain.otherwise("principal")


def resolve_role(text: Column | str) -> Column:
    """Role named in an import file; anything unknown is a counselor."""
    return labels(F.lower(strip(text)), M.ROLE_SYNONYMS, F.lit("counselor"))


def school_type(text: Column | str, words: Iterable[str] = ("middle", "junior")) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(F.lower(_col(text)).contains(word), F.lit(False))
    return F.when(hit, "middle_school").otherwise("high_school")


def format_school_type(c: Column | str) -> Column:
    return F.when(_col(c) == "high_school", "High School").otherwise("Middle School")


def activity_label(c: Column | str) -> Column:
    """Underscores as spaces, each word's first character upper, the rest unchanged."""
    words = F.split(F.regexp_replace(_col(c), "_", " "), " ", -1)
    up = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(up, " ")


def truncate_label(c: Column | str, longest: int, keep: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


def format_event_id(c: Column | str) -> Column:
    return F.concat(F.lit("e_"), _col(c).cast("string"))


def parse_event_id(c: Column | str) -> Column:
    """Leading whole number behind an ``e_`` (or older ``se_``, ``s_``) prefix."""
    return F.regexp_extract(_col(c), r"^(?:[es]e?_)?\s*([+-]?\d+)", 1).try_cast("bigint")


def participants_split(c: Column | str) -> Column:
    """Comma text to an array of trimmed, non-blank ids; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ",", -1), strip)
    return F.filter(parts, lambda p: p != "")


def participants_join(c: Column | str) -> Column:
    return blank_to_null(F.array_join(_col(c), ","))


def has_text(c: Column | str) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def pct_round(part: Column | str, whole: Column | str) -> Column:
    """Percentage rounded half up; 0 for an empty whole."""
    part, whole = _col(part), _col(whole)
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(100.0 * part / F.nullif(whole, F.lit(0)) + 0.5)).cast("bigint")


def one_decimal(part: Column | str, whole: Column | str) -> Column:
    part, whole = _col(part), _col(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / F.nullif(whole, F.lit(0)), 1))
