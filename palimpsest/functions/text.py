"""Text functions as Column expressions: normalisation, words, hashes, shingles, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is removed before texts are matched, in this order.
URL = r"(?i)https?://\S+|www\.\S+"
DATELINE = r"(?i)^\s*[A-Za-z .,'/&-]{1,40}\(\s*(?:reuters|ap|afp|upi)\s*\)\s*[-–—:]*\s*"
AGENCY_TAG = r"(?i)\(\s*(?:reuters|ap|afp|upi)\s*\)"
HANDLE = r"[@#][\p{L}\p{N}_]+"
AGENCY_WORD = r"(?i)\breuters\b"
#: Characters of the prefix that is hashed, and words of the head view.
PREFIX_CHARS, HEAD_WORDS = 300, 100


# White space as Unicode has it, with the four separators of ASCII; for a class in a pattern.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_light(c: Column | str) -> Column:
    """Lower case, everything but letters, numbers and underscore to single spaces, trimmed. Java's \\w differs from Unicode words."""
    # One pass over the text, in which a single space between words is no match.
    return F.trim(F.regexp_replace(F.lower(col(c)), r" *+[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*+|  +", " "))


def strip_markers(c: Column | str) -> Column:
    """URLs, one leading dateline, agency tags, handles and the agency's name removed, one after another."""
    x = F.regexp_replace(col(c), URL, " ")
    x = F.regexp_replace(x, DATELINE, "")
    for p in (AGENCY_TAG, HANDLE, AGENCY_WORD):
        x = F.regexp_replace(x, p, " ")
    return x


def norm_strip(c: Column | str) -> Column:
    return norm_light(strip_markers(c))


def words(c: Column | str) -> Column:
    """Words of normalised text; the empty text has none."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def raw_word_count(c: Column | str) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(col(c), F.lit(rf"[^{WHITE}]+"))


def digest(c: Column | str) -> Column:
    """128-bit hash, null for the empty text, so that missing never matches missing."""
    return F.when(col(c) != "", F.md5(col(c)))


def shingles(w: Column, k: int) -> Column:
    """Distinct runs of k words, or the whole of fewer words."""

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(v, i, k), " "))
        return F.when(F.size(v) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    # Bound once as a lambda's variable; else the words would be made again for each run.
    return F.element_at(F.transform(F.array(w), of), 1)


def preview(c: Column | str, n: int) -> Column:
    return F.regexp_replace(F.substring(col(c), 1, n), "\n", " ")


def title_of(c: Column | str) -> Column:
    return F.substring_index(col(c), "\n", 1)


def body_of(c: Column | str) -> Column:
    """What follows the first line break, or nothing."""
    x = col(c)
    return F.when(F.instr(x, "\n") > 0, F.substring(x, F.instr(x, "\n") + 1, F.length(x))).otherwise("")


def title_and_body(title: Column | str, body: Column | str) -> Column:
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.coalesce(col(body), F.lit("")))


def scrub_at(c: Column | str) -> Column:
    """Standalone runs of @ removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"(?:(?<=\s)|^)@+(?=\s|$)", " "), r"\s+", " "))


def redact_id(c: Column | str, known: str) -> Column:
    """An id of a known pattern as it is, any other as its digest."""
    x = col(c).cast("string")
    return F.when(x.rlike(known), x).otherwise(F.concat(F.lit("sha256:"), F.sha2(x, 256)))


def kwic(text: Column | str, term: str, width: int = 70) -> Column:
    """The first whole-word match, whatever its case, with ``width`` characters on both sides; line breaks as a sign."""
    x = col(text)
    at = F.regexp_instr(x, F.lit(rf"(?i)\b{term}\b"))
    return F.when(at > 0, F.regexp_replace(F.substring(x, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + len(term) + width), "\n", "⏎"))
