"""Span algebra: source, temporal and entity spans, their removal, and size-matched random deletion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import WHITE, raw_word_count
from palimpsest.operators.grid import CONDITIONS

# Source-marker patterns (name, pattern, flags), all matched on the original text. i: any case, m: ^ and $
# at lines.
SOURCE: tuple[tuple[str, str, str], ...] = (
    ("url", r"https?://\S+|www\.\S+", ""),
    ("twitter_pic", r"pic\.twitter\.com/\S+", "i"),
    ("dateline", r"^\s*[A-Z][A-Za-z .,'/&-]{1,40}\(\s*(?:Reuters|AP|AFP|UPI)\s*\)\s*[-–—:]*", "m"),
    ("agency_tag", r"\(\s*(?:Reuters|AP|AFP|UPI)\s*\)", ""),
    ("outlet_names", r"\b(?:Reuters|Breitbart|Infowars|21st Century Wire|Natural News|Daily Kos|Fox News|Washington Post|New York Times|NY Times|Huffington Post|HuffPost|CNN|BBC|Associated Press|Getty Images)\b", "i"),
    ("featured_image", r"\bfeatured image\b[^\n.]{0,80}", "i"),
    ("image_credit", r"\b(?:image|photo|screenshot|video)\s+(?:via|by|credit)\b[^\n.]{0,80}", "i"),
    ("boilerplate_cta", r"\b(?:share this|share on facebook|tweet this|like us on facebook|follow us on|subscribe to)\b|\bread more\b\s*:?[^\n.]{0,60}", "i"),
    ("social_share_strip", r"google\s+pinterest\s+digg\s+linkedin\s+reddit\s+stumbleupon\s+print\s+delicious\s+pocket\s+tumblr", "i"),
    ("follow_social", r"\bfollow\b[^\n.]{0,100}?\b(?:twitter|facebook|instagram|periscope)\b(?:\s*(?:and|,)\s*(?:twitter|facebook|instagram|periscope)\b)*\s*:?\s*(?:@\w+)?", "i"),
    ("boilerplate_line", r"^\s*(?:advertisements?|share|print|tweet|email|comments?|related(?: articles)?|sources?|via|read more)\s*:?\s*$", "im"),
    ("credit_line", r"^\s*(?:source|sources|via|image|photo|credit)\s*:\s*[^\n]{0,100}$", "im"),
    ("share_prompts", r"\bshare\s+(?:this|on\s+\w+)(?:\s+(?:article|post|story))?(?:\s+tweet)?\s*:?", "i"),
    ("print_prompt", r"\bprint\s+this\s+(?:post|page|article)\b[^\n.]{0,40}", "i"),
    ("ad_markers", r"-?\s*\badvertisement\b(?:\s+square,\s+site\s+wide)?\s*-?", "i"),
    ("posted_stamp", r"\bposted\s+(?:at\s+[\d:]+\s*[ap]m\s+)?on\s+\w+\s+\d{1,2},\s+\d{4}(?:\s+by\s+[A-Z][\w.]*(?:\s+[A-Z][\w.]*){0,2})?", "i"),
    ("sf_source", r"\bSF Source\b[^\n]{0,60}", ""),
    ("source_credit", r"\bsources?\s*:\s*[^\n.]{0,60}|\(\s*source\s*\)|\|\s*(?=sources?\s*:)", "i"),
    ("email_address", r"\b(?:or\s+)?e-?mail\s+(?:him|her|them|me|us)?\s*at\s+[\w.+-]+@[\w-]+\.\s?\w+|\b[\w.+-]+@[\w-]+\.\s?(?:com|org|net|edu|co)\b", "i"),
    ("broken_urls", r"https?\s*:\s*/\s*/\s*\S*|https?\s*:\s*\.|\bpic\.?\s*twitter\.?(?:\s*com\S*)?|\bt\.\s?co/\S+", "i"),
    ("tweet_attribution", r"[—–-]\s+[^()\n]{1,60}\(@\w+\)(?:\s+[A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+(?:19|20)\d{2},?)?", ""),
    ("bare_domains", r"\b[\w-]+\.\s?(?:com|org|net|edu)\b(?:/\S*)?", "i"),
    ("click_prompts", r"\bclick\s+(?:here|below|to\s+\w+)\b[^\n.]{0,40}|\bleave\s+a\s+(?:comment|reply)\b|\bplease\s+(?:feel\s+free\s+to\s+)?(?:share|like|follow|subscribe|support|donate|click|comment)\b[^\n.]{0,60}", "i"),
    ("handles_hashtags", r"(?<!\w)[@#]\w+", ""),
)
# Which of them are newswire markers; the others are web boilerplate.
WIRE = ("dateline", "agency_tag", "outlet_names")
# Temporal expressions.
TEMPORAL: tuple[tuple[str, str], ...] = (
    (r"\b(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs?)?|Fri|Sat(?:ur)?|Sun)(?:day)?\b\.?", ""),
    (r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b\.?(?:\s+\d{1,2}(?:st|nd|rd|th)?\b)?(?:,?\s+(?:19|20)\d{2}\b)?", ""),
    (r"\b(?:19|20)\d{2}\b", ""),
    (r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b", ""),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?", "i"),
)
# Fixed value: entities where no model for them is at hand: capitalised names of several words, short capitals.
ENTITY = r"\b(?:[A-Z][A-Za-z'’.-]+)(?:\s+(?:of|the|de|von|van|and|for)?\s*[A-Z][A-Za-z'’.-]+)+\b|\b[A-Z]{2,6}\b"

SPANS = "array<struct<start:int,end:int>>"


def java(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode words, digits and white space, and with line feeds as the only ends of lines."""
    return f"(?Ud{flags})" + pattern


def patterns(letters: str, extra_terms: tuple[str, ...] = ()) -> list[str]:
    """Patterns of a mask: S all source markers, W newswire, B the others, T temporal, E entities."""
    out = []
    for c in letters:
        if c in "SWB":
            out += [java(p, f) for n, p, f in SOURCE if c == "S" or (n in WIRE) == (c == "W")]
            if c == "S" and extra_terms:
                out.append(java(r"\b(?:" + "|".join(map(re.escape, extra_terms)) + r")\b", "i"))
        elif c == "T":
            out += [java(p, f) for p, f in TEMPORAL]
        elif c == "E":
            out.append(java(ENTITY))
    return out


def spans(text: Column, letters: str, extra_terms: tuple[str, ...] = ()) -> Column:
    """Spans (code points, end exclusive) of the mask on the original text, in order of start; none in a null text."""
    found = [F.when(text.rlike(p), regex_spans(text, p)).otherwise(F.array().cast(SPANS)) for p in patterns(letters, extra_terms)]
    return F.array_sort(F.concat(*found)) if found else F.array().cast(SPANS)


def coverage(df: DataFrame, by: tuple[str, ...], text: str) -> DataFrame:
    """(by, pattern, share): percentage of texts that each source pattern matches, to one decimal."""
    x = df.groupBy(*by).agg(*(F.avg(F.coalesce(F.col(text).rlike(java(p, f)), F.lit(False)).cast("double")).alias(n) for n, p, f in SOURCE))
    rows = F.array(*(F.struct(F.lit(n).alias("pattern"), F.round(100.0 * F.col(n), 1).alias("share")) for n, _, _ in SOURCE))
    return x.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def cut(text: Column, found: Column) -> Column:
    """The text without its spans (overlapping ones merged, nothing put in their place), white space collapsed; untouched without spans.

    What is kept before a span begins where the spans before it end, so the pieces are joined once.
    """
    size = F.size(found)

    def pieces(x: Column) -> Column:
        # The furthest end of the spans so far, then the gap from there to the next span's start.
        zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<from:int,to:int>>").alias("gaps"))
        step = lambda acc, s: F.struct(
            F.greatest(acc["last"], s["end"]).alias("last"),
            F.when(s["start"] > acc["last"], F.concat(acc["gaps"], F.array(F.struct(acc["last"].alias("from"), s["start"].alias("to"))))).otherwise(acc["gaps"]).alias("gaps"),
        )
        done = lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["last"].alias("from"), F.length(text).alias("to"))))
        return F.array_join(F.transform(F.aggregate(x, zero, step, done), lambda g: F.substring(text, g["from"] + 1, g["to"] - g["from"])), "")

    # The spans are bound once, as a lambda's variable.
    rest = F.element_at(F.transform(F.array(F.array_sort(found)), pieces), 1)
    return F.when(size == 0, text).otherwise(F.regexp_replace(F.regexp_replace(rest, f"[{WHITE}]+", " "), "^ | $", ""))


def regex_spans(text: Column, pattern: str) -> Column:
    """Spans of one pattern without Python: positions are the running lengths of what is between and in matches."""
    gap, hit = F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["hit"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["hit"]).alias("end")))).alias("out"),
    )
    pairs = F.filter(F.arrays_zip(gap.alias("gap"), hit.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def mask(df: DataFrame, text: str, letters: str, extra_terms: tuple[str, ...] = ()) -> DataFrame:
    """df with spans and masked; every letter's patterns look at the original text."""
    return df.withColumn("spans", F.coalesce(spans(F.col(text), letters, extra_terms), F.array().cast(SPANS))).withColumn("masked", cut(F.col(text), F.col("spans")))


def drop_words(df: DataFrame, key: str, text: str, m: str, seed: int, keep_one: bool) -> DataFrame:
    """df with dropped: the text without m words drawn by hash of (seed, key, position); m <= 0 leaves it as it is.

    keep_one: one word always stays (the older rule); else the count is exact, and texts may become empty.
    """
    w = F.filter(F.split(F.regexp_replace(F.col(text), f"[{WHITE}]+", " "), " "), lambda x: x != "")
    order = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))

    def drop(v: Column) -> Column:
        ranked = F.array_sort(F.transform(v, lambda x, i: F.struct(order(i).alias("o"), i.alias("i"), x.alias("x"))))
        gone = F.greatest(F.lit(0), F.least(F.col(m).cast("int"), F.size(v) - (1 if keep_one else 0)))
        kept = F.slice(ranked, gone + 1, F.size(v) + 1)
        return F.array_join(F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["i"], p["x"]))), lambda p: p["x"]), " ")

    # The words are bound once, as a lambda's variable.
    rest = F.element_at(F.transform(F.array(w), drop), 1)
    return df.withColumn("dropped", F.when(F.col(m) <= 0, F.col(text)).otherwise(rest))


def letters(cond: str) -> tuple[str, bool]:
    """The mask's letters of a condition, and whether it is the mask's random control."""
    source, _, entities, temporal, control = CONDITIONS[cond]
    return control or {"0": "", "1": "S"}.get(source, source) + "E" * entities + "T" * temporal, bool(control)


def masked_texts(df: DataFrame, text: str, of: str) -> DataFrame:
    """df with masked (null where the text stays as it is) and _m, how many words the mask removes."""
    x = mask(df, text, of).drop("spans")
    m = F.coalesce(raw_word_count(text) - raw_word_count("masked"), F.lit(0)).cast("int")
    return x.withColumn("_m", m).withColumn("masked", F.when(F.col("masked") != F.col(text), F.col("masked")))


def condition_of(df: DataFrame, key: str, text: str, seed: int | None) -> DataFrame:
    """df of masked_texts with condition_text: the masked text, or with a seed as many words dropped at random as the mask removes."""
    if seed is None:
        return df.withColumn("condition_text", F.coalesce("masked", text))
    return drop_words(df, key, text, "_m", seed, keep_one=False).withColumnRenamed("dropped", "condition_text")


def condition_texts(df: DataFrame, key: str, text: str, cond: str, seed: int) -> DataFrame:
    """df with condition_text: the text under a condition, its mask's spans removed or, for a control, as many words dropped at random as the
    mask that it controls for removes from the same text."""
    of, control = letters(cond)
    if not of:
        return df.withColumn("condition_text", F.col(text))
    return condition_of(masked_texts(df, text, of), key, text, seed if control else None).drop("masked", "_m")
