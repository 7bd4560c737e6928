"""Scalar text functions. A null in gives a null out unless it is said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CLASS_WORDS, COARSE3, KEYWORD_TYPES, KIND_TYPES, PREFIX_TYPES, SUBTYPES, lookup

LETTERS, NUMBER, LOOP = "[A-Z]{1,4}", r"\d{2,4}", r"\d{1,3}"
_LOOP = f"(?:-{LOOP})?"
TAG = LETTERS + "-" + NUMBER + _LOOP + "[A-Z]?"
BOUND_TAG = rf"(?U)\b({TAG})\b"
LOOSE_TAG = rf"(?U)\b({TAG}|" + LETTERS + r"\s+" + NUMBER + _LOOP + r"[A-Z]?)\b"
DASHES = "[-=/—–]"
TOLERANT_TAG = rf"(?U)\b({LETTERS})" + DASHES + rf"({NUMBER})\b"
HEADER_PREFIX = rf"(?U)\b({LETTERS})" + DASHES + r"\d"
STANDING_PREFIX = r"(?U)\b(\w+)(?=" + DASHES + r"[^\n]{0,3}\d)"
_STATED, _FRACTION = r"M\.?W\.?P\.?|DESIGN", r"(?:\.\d+)?"
_GAP = r"[:\s]*[^0-9]{0,15}?"
PRESSURE = rf"(?iU)(?:{_STATED}){_GAP}({NUMBER}{_FRACTION})\s*PSIG"
_DEGREES = r"-?" + LOOP
TEMPERATURE = rf"(?iUd)({_DEGREES}(?:\s*(?:/|TO)\s*{_DEGREES})?)" + r"\s*.?\s*F\b"
ROW_TAG = rf"(?U)^({LETTERS}-{NUMBER})"
_WORDS = "|".join(KEYWORD_TYPES)
DECLARATION = rf"(?iU)\b(?:({_WORDS})\s+({TAG})|({TAG})\s+\(?({_WORDS})\)?)\b"
#: The links that the contract of findings names.
_LINKS = "|".join([r"discharges? (?:in)?to", r"feeds? into", r"connect(?:ed|s)? to", r"flows? (?:from .*? )?to"])
CONNECTION = rf"(?iUd)({TAG})\s*(?:{_LINKS})\s*({TAG})"
FLOAT = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return or_null(F.regexp_extract(text, pattern, group))


def type_of_tag(tag: Column) -> Column:
    """Component type by the letters that a tag starts with; null if they aren't known."""
    head = F.upper(F.get(F.split(stripped(tag), r"(?U)[\s-]", 2), F.lit(0)))
    letters = F.regexp_replace(head, "[0-9]+$", "")
    return lookup(F.when(letters == "", head).otherwise(letters), PREFIX_TYPES)


def coarse6(kind: Column) -> Column:
    """valve, pump, tank, compressor, heat_exchanger, else instrument; unknown stays."""
    same = kind.isin("compressor", "heat_exchanger", "pump", "tank", "unknown")
    return F.when(kind.isNull(), None).when(same, kind).when(kind.contains("valve"), "valve").otherwise("instrument")


def coarse3(kind: Column) -> Column:
    """valve, equipment, else instrument; null for unknown."""
    return F.when(kind.isNull() | (kind == "unknown"), None).when(kind.contains("valve"), "valve").when(kind.isin("compressor", "equipment", "filter", "heat_exchanger", "pump", "tank"), "equipment").otherwise("instrument")


def coarse3_or_unknown(kind: Column) -> Column:
    return F.coalesce(coarse3(kind), F.lit("unknown"))


def type_of_kind(kind: Column) -> Column:
    """Component type by drawn shape; unknown for all but four shapes, null included."""
    return F.coalesce(lookup(kind, KIND_TYPES), F.lit("unknown"))


def type_of_class(name: Column) -> Column:
    """Component type of a detector's class name: a coarse class itself, else by the first known word within it."""
    low = F.lower(name)
    out = F.when(low.isNull(), None).when(low.isin(*COARSE3), low)
    for word, kind in CLASS_WORDS:
        out = out.when(low.contains(word), kind)
    return out.otherwise("unknown")


def geometric_type(kind: Column, override: Column) -> Column:
    return F.coalesce(or_null(override), type_of_kind(kind))


def component_type(tag: Column, kind: Column, override: Column) -> Column:
    """The tag's type, unless geometry knows the component and its coarse class is another: then geometry's."""
    by_tag, by_shape = type_of_tag(or_null(tag)), geometric_type(kind, override)
    differs = ~coarse3(by_tag).eqNullSafe(coarse3(by_shape))
    return F.when(by_tag.isNotNull() & (by_shape != "unknown") & differs, by_shape).otherwise(F.coalesce(by_tag, by_shape))


def tag_confidence(tag: Column, source: Column) -> Column:
    return F.coalesce(source, F.when(F.length(tag) > 0, "ocr_matched").otherwise("unresolved"))


def to_float(text: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    t = F.replace(stripped(text), F.lit(","), F.lit(""))
    return F.when(t.rlike(FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def digits(value: Column) -> Column:
    return or_null(F.regexp_replace(value, r"(?U)\D", ""))


def is_range(value: Column) -> Column:
    """Whether there is a hyphen besides a leading sign."""
    return F.substring(stripped(value), 2, 1 << 30).contains("-")


def normal_tag(tag: Column) -> Column:
    return F.regexp_replace(F.upper(stripped(tag)), r"(?U)\s+", " ")


def plain_separators(text: Column) -> Column:
    """Hyphens for what OCR reads in their place."""
    return F.translate(text, "=/—–", "----")


def loose_tag(reply: Column) -> Column:
    """The tag in a model's reply, hyphenated or with a space; null for UNKNOWN or none."""
    text = F.upper(stripped(reply))
    return F.when(text == "UNKNOWN", None).otherwise(or_null(F.regexp_replace(F.regexp_extract(text, LOOSE_TAG, 1), r"(?U)\s+", " ")))


def classification(reply: Column) -> Column:
    """struct(coarse, subtype) of a model's reply 'coarse[, subtype]'; nulls for what isn't in the vocabulary."""
    parts = F.transform(F.split(reply, ","), lambda p: F.lower(stripped(p)))
    coarse = F.get(parts, F.lit(0))
    coarse = F.when(coarse.isin(*COARSE3), coarse)
    sub = F.regexp_replace(F.replace(F.get(parts, F.lit(1)), F.lit(" "), F.lit("_")), "[^a-z_]", "")
    return F.struct(coarse.alias("coarse"), F.when(coarse.isNotNull() & sub.isin(*SUBTYPES), sub).alias("subtype"))


def class_kind(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def class_words(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def quoted(text: Column) -> Column:
    """A string literal in Python's notation; None for null."""
    control = lambda c: F.when(c.rlike(r"^[\x00-\x1f\x7f]$"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)
    t = text
    for raw, by in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(by))
    t = F.when(t.rlike(r"[\x00-\x1f\x7f]"), F.array_join(F.transform(F.split(t, ""), control), "")).otherwise(t)
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(single)


def listed(numbers: Column) -> Column:
    """[1, 2, 3] as text; None for null."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]")), F.lit("None"))


def shown(value: Column, is_number: bool = False) -> Column:
    """A value as text, None for null; large whole numbers without an exponent."""
    text = value.cast("string")
    if is_number:
        whole = (F.abs(value) >= 1e7) & (F.abs(value) < 1e16) & (value == F.floor(value))
        text = F.when(whole, F.concat(value.try_cast("bigint").cast("string"), F.lit(".0"))).otherwise(text)
    return F.coalesce(text, F.lit("None"))
