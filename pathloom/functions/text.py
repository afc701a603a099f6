"""Column functions over text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"

# Stop words of the keyword extractor, and of the simple fallback (its first 25).
STOP_WORDS = [
    "的", "是", "在", "有", "和", "與", "或", "要", "我", "你", "他", "她", "它",
    "the", "is", "are", "a", "an", "and", "or", "to", "of", "in", "on", "at",
    "for", "with", "from", "by", "as", "this", "that", "these", "those",
    "will", "would", "should", "could", "can", "may", "might",
]
FALLBACK_STOP_WORDS = STOP_WORDS[:25]
# Words that a keyword filter drops.
COMMON_KEYWORDS = [
    "productivity", "collaboration", "automation", "intelligence", "ai, ml & automation intelligence",
    "productivity & collaboration", "ml", "ai", "&", "and", "or", "the", "a", "an",
]
# Short names of node types and the canonical names they stand for; all others are lower-cased.
CANONICAL_TYPES = {"httprequest": "httpRequest", "http": "httpRequest", "function": "code", "splitinbatches": "splitInBatches", "loop": "splitInBatches"}


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def acronyms(text: Column) -> Column:
    """Words of two or more capital ASCII letters, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,}+(?![\p{L}\p{N}_])"), F.lit(0)))


def keywords(text: Column, min_length: int = 2, stop_words: list[str] | None = None) -> Column:
    """Acronyms, words that are neither stop words nor too short, and runs of 2 to 4 Han characters; sorted."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    words = F.filter(F.array_except(tokens(F.lower(text)), stop), lambda t: F.length(t) >= min_length)
    han = F.array_except(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]{2,4}"), F.lit(0)), stop)
    return F.array_sort(F.array_distinct(F.concat(F.transform(acronyms(text), F.lower), words, han)))


def technical_terms(text: Column) -> Column:
    """Acronyms and dotted terms, case kept; sorted."""
    dotted = F.regexp_extract_all(text, F.lit(rf"{WORDS}\.{WORDS}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(acronyms(text), dotted)))


def fallback_tokens(text: Column) -> Column:
    """Lower-cased words between white space, stripped of punctuation, longer than two, no stop words; sorted."""
    stop = F.array(*[F.lit(w) for w in FALLBACK_STOP_WORDS])
    words = F.transform(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda t: F.btrim(t, F.lit(".,!?;:()[]{}\"'-")))
    return F.array_sort(F.filter(F.array_except(words, stop), lambda t: F.length(t) > 2))


def filtered_keywords(words: Column, categories: Column) -> Column:
    """``words`` without category names, common and short ones; unfiltered if nothing would be left."""
    lower = F.transform(categories, F.lower)
    common = F.array(*[F.lit(w) for w in COMMON_KEYWORDS])
    key = lambda w: F.lower(F.btrim(w))
    out = F.filter(words, lambda w: (F.length(key(w)) >= 2) & ~F.array_contains(common, key(w)) & ~F.coalesce(F.array_contains(lower, key(w)), F.lit(False)))
    return F.when(F.size(out) > 0, out).otherwise(words)


def ascii_only(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def description_status(text: Column) -> Column:
    """ok, or why a description can't be used: empty, or empty once it is ASCII."""
    blank = (F.btrim(F.coalesce(text, F.lit(""))) == "")
    return F.when(blank, "empty").when(ascii_only(text) == "", "no_ascii").otherwise("ok")


def short_error(message: Column, most: int = 200) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("..."))).otherwise(message)


def last_part(node_type: Column) -> Column:
    return F.element_at(F.split(node_type, r"\."), -1)


def canonical_type(node_type: Column) -> Column:
    """The part after the last dot, lower-cased or by its canonical name."""
    low = F.lower(last_part(node_type))
    names = F.create_map(*[F.lit(x) for kv in CANONICAL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, low), low)


def display_name(node_type: Column) -> Column:
    return F.initcap(F.regexp_replace(last_part(node_type), "(?<!^)(?=[A-Z])", " "))


def without_number(name: Column) -> Column:
    """``name`` without a leading all-digit word."""
    return F.regexp_replace(name, r"^\d+ ", "")


def prompt(template: str, description: Column, slot: str = "{{ description }}") -> Column:
    """``template`` with every slot filled."""
    return F.replace(F.lit(template), F.lit(slot), description)


def duration(seconds: Column) -> Column:
    """59s, 1m 5s, 2h 3m: fractions are cut off, and above an hour the seconds too."""
    whole = F.floor(seconds).cast("long")
    part = lambda x: x.cast("long").cast("string")
    hours = F.concat(part(F.floor(whole / 3600)), F.lit("h "), part(F.floor(whole % 3600 / 60)), F.lit("m"))
    minutes = F.concat(part(F.floor(whole / 60)), F.lit("m "), part(whole % 60), F.lit("s"))
    return F.when(seconds < 60, F.concat(part(whole), F.lit("s"))).when(seconds < 3600, minutes).otherwise(hours)


def progress(current: Column, total: Column, elapsed: Column) -> Column:
    """[2/8] 25.0% | ETA: 6s: the time that is left at the pace so far."""
    share = F.format_string("%.1f", F.coalesce(F.try_divide(current * 100.0, total.cast("double")), F.lit(0.0)))
    left = F.when(current > 0, duration(elapsed / current * (total - current))).otherwise("calculating...")
    return F.concat(F.lit("["), current.cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), share, F.lit("% | ETA: "), left)
