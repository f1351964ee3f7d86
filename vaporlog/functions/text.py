"""Text clean-up expressions (native, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaporlog.rules import schema

# The characters str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = "[" + WHITESPACE + "]+"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    """Strip, and turn each run of white space into one blank."""
    return strip(F.regexp_replace(text, _SPACE_RUN, " "))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only."""
    return text.isNull() | (strip(text) == "")


def missing_to_null(text: Column, sentinels=schema.TEXT_MISSING) -> Column:
    """Stripped text, or null where it is one of the missing markers."""
    stripped = strip(text)
    return F.when(~stripped.isin(*sentinels), stripped)


def clean_text(text: Column) -> Column:
    """Stripped text with missing markers turned into the empty string."""
    return F.coalesce(missing_to_null(text), F.lit(""))


def parse_int(text: Column, default: int = 0) -> Column:
    """Whole number of a text, or the default."""
    value = missing_to_null(text)
    whole = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))
    return F.coalesce(whole, F.lit(default).cast("long"))


def join_distinct(*texts: Column) -> Column:
    """Distinct non-blank texts in order, one per line; null when there is none."""
    stripped = F.array_compact(F.array(*[F.when(~is_blank(t), strip(t)) for t in texts]))
    joined = F.array_join(F.array_distinct(stripped), "\n")
    return F.when(joined != "", joined)


def split_lines(text: Column) -> Column:
    """Non-blank lines, each stripped; an empty array for null."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda line: line != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def first_attending(text: Column) -> Column:
    """First entry of a ';' list without its '@time' part; empty for null."""
    first = F.substring_index(F.substring_index(text, ";", 1), "@", 1)
    return F.coalesce(strip(first), F.lit(""))


def provider_name(text: Column) -> Column:
    """First name of a ';' list without titles, trailing comma and extra blanks."""
    first = strip(F.substring_index(text, ";", 1))
    untitled = strip(F.regexp_replace(first, r"(?iU)(?=[MDPCR])\b(MD|DO|PhD|CRNA|RN)\b", ""))
    return collapse_spaces(F.regexp_replace(untitled, r"(?U),\s*$", ""))


def strip_phi(text: Column) -> Column:
    """Drop '[PHI]' markers and extra white space."""
    return collapse_spaces(F.replace(text, F.lit("[PHI]"), F.lit("")))


def procedure_key(text: Column) -> Column:
    """Upper-cased text with single blanks; the join key of procedure texts."""
    return F.coalesce(F.upper(collapse_spaces(text)), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalize every run of letters, also after a hyphen or an apostrophe."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 1 << 30))),
        ),
        "",
    )


def display_name(stem: Column) -> Column:
    """'LAST_FIRST' as 'First Last'."""
    parts = F.split(stem, "_", 2)
    return F.when(
        F.size(parts) == 2,
        F.concat_ws(" ", title_case(F.get(parts, F.lit(1))), title_case(F.get(parts, F.lit(0)))),
    ).otherwise(title_case(stem))


def python_repr(text: Column) -> Column:
    """A text quoted the way warning messages show list items."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    has_single = F.contains(text, F.lit("'"))
    has_double = F.contains(text, F.lit('"'))
    return (
        F.when(~has_single, F.concat(F.lit("'"), escaped, F.lit("'")))
        .when(~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def python_list(items: Column) -> Column:
    """An array of texts as "['A', 'B']"."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, python_repr), ", "), F.lit("]"))


def sha_fraction(text: Column) -> Column:
    """A stable fraction in [0, 1) from the first 32 bits of the SHA-256."""
    return sha_long(text).cast("double") / F.lit(float(1 << 32))


def sha_long(text: Column) -> Column:
    """The first 32 bits of the SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def fixed_point(fraction: Column, digits: int) -> Column:
    """A fraction in [0, 1] with a fixed number of decimals, rounded on its exact value.

    The double is scaled by 2**60 to a whole number first, so that ties are real ties.
    """
    scale, unit = 10**digits, 1 << 60
    whole = (fraction * F.lit(float(unit))).cast("long").cast("decimal(19,0)") * F.lit(scale).cast("decimal(5,0)")
    rest = whole % F.lit(unit).cast("decimal(19,0)")
    units = ((whole - rest) / F.lit(unit).cast("decimal(19,0)")).cast("long")
    half = F.lit(unit // 2).cast("decimal(19,0)")
    units = units + F.when((rest > half) | ((rest == half) & (units % 2 == 1)), 1).otherwise(0)
    return F.concat(
        F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0")
    )
