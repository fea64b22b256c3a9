"""Tokenisers and string normalisation as column expressions (no Python in the data path).

Word characters are [\\p{L}\\p{N}_]: the same set in Spark, in DuckDB and, but for a few new code
points, in Python. Null text gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the lexical profiles.
STOP_DEFAULT = (
    "co", "to", "jest", "i", "oraz", "a", "w", "we", "na", "z", "za", "do", "o", "od", "po", "dla", "czy", "jak", "jaki", "jakie", "ktory",
    "która", "the", "is", "are", "what", "of", "in", "for", "and",
)
STOP_FIELDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "what", "when", "which", "with", "why",
)
STOP_LTR = ("a", "and", "are", "for", "from", "how", "in", "is", "it", "of", "or", "the", "this", "to", "what", "when", "which", "with")
STOP_OVERLAP = ("a", "and", "are", "for", "how", "in", "is", "of", "or", "the", "to", "what", "with")
STOP_FEEDBACK = (
    "about", "after", "also", "and", "are", "can", "does", "for", "from", "how", "into", "jest", "jak", "jaki", "który", "na", "oraz", "the",
    "this", "what", "when", "where", "which", "with", "work",
)

WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[A-Za-z0-9]+(?:[_-][A-Za-z0-9]*)+|[A-Za-z0-9]+"
TECHNICAL = r"[A-Za-z0-9]+(?:[_.:/-][A-Za-z0-9]+)*"
RUN = r"[\p{L}\p{N}_-]+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _stop(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def word_tokens(text: Column, stop: tuple[str, ...] = STOP_DEFAULT, least: int = 2) -> Column:
    """Lower-case words of at least `least` characters that aren't in the stop list."""
    return F.filter(_all(F.lower(text), WORD), lambda t: (F.length(t) >= least) & ~F.array_contains(_stop(stop), t))


def identifier_tokens(text: Column, ngrams: bool = True) -> Column:
    """Words with their hyphens and underscores kept, each followed by its parts; then pairs of neighbours."""
    raw = F.filter(
        F.transform(_all(text, IDENTIFIER), F.lower),
        lambda t: (F.length(t) > 1) & (~F.array_contains(_stop(STOP_FIELDS), t) | t.rlike("[0-9]")),
    )
    own = F.flatten(
        F.transform(
            raw,
            lambda t: F.concat(
                F.array(t), F.when(t.rlike("[-_]"), F.filter(F.split(t, "[-_]"), lambda p: F.length(p) > 1)).otherwise(F.array().cast("array<string>"))
            ),
        )
    )
    return with_bigrams(own) if ngrams else own


def with_bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def technical_tokens(text: Column, technical: bool = True) -> Column:
    """Words without stop words; the technical form keeps joined identifiers and adds their parts."""
    if not technical:
        return word_tokens(text, STOP_FIELDS)
    raw = F.filter(_all(F.lower(text), TECHNICAL), lambda t: (F.length(t) > 1) & ~F.array_contains(_stop(STOP_FIELDS), t))
    return F.flatten(
        F.transform(
            raw,
            lambda t: F.concat(
                F.array(t),
                F.when(
                    t.rlike("[_.:/-]"),
                    F.filter(F.split(t, "[_.:/-]+"), lambda p: (F.length(p) > 1) & ~F.array_contains(_stop(STOP_FIELDS), p)),
                ).otherwise(F.array().cast("array<string>")),
            ),
        )
    )


def _runs(text: Column) -> Column:
    """Runs of word characters and hyphens, without hyphens at their ends."""
    return F.transform(_all(text, RUN), lambda t: F.regexp_replace(t, "^-+|-+$", ""))


def ltr_tokens(text: Column) -> Column:
    """Lower-case tokens that begin with a letter, identifiers whole, without stop words."""
    return F.filter(
        F.transform(F.filter(_runs(text), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$")), F.lower),
        lambda t: ~F.array_contains(_stop(STOP_LTR), t),
    )


def overlap_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two or more characters for the lexical-overlap boost."""
    return F.array_distinct(
        F.filter(
            F.transform(F.filter(_runs(text), lambda t: t.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$")), F.lower),
            lambda t: (F.length(t) > 1) & ~F.array_contains(_stop(STOP_OVERLAP), t),
        )
    )


def diversity_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(_all(F.lower(text), WORD), lambda t: F.length(t) > 2))


def feedback_tokens(text: Column) -> Column:
    """Identifiers and words of three or more letters, as written, for pseudo-relevance feedback."""
    return F.filter(
        _runs(text),
        lambda t: t.rlike("^(?:[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z][A-Za-z0-9]{2,})$")
        & ~F.array_contains(_stop(STOP_FEEDBACK), F.lower(t)),
    )


def acronyms(text: Column) -> Column:
    """Upper-case tokens of 2 to 10 characters."""
    return F.filter(_runs(text), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9_-]{1,9}$") & (F.upper(t) == t) & t.rlike("[A-Z]"))


def has_lexical_signal(text: Column) -> Column:
    """An acronym, a quoted term, a three-digit number or a joined identifier."""
    t = F.coalesce(text, F.lit(""))
    runs = _runs(t)
    return (
        (F.size(acronyms(t)) > 0)
        | t.rlike("[`\"'][^`\"']+[`\"']")
        | F.exists(_all(t, WORD), lambda w: w.rlike("^[0-9]{3}$"))
        | F.exists(runs, lambda w: w.rlike("^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+$"))
    )


def normalise_source(c: Column) -> Column:
    """Lower case, forward slashes, no outer blanks."""
    return F.lower(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))))


def normalise_question(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def topic(section: Column, heading: Column) -> Column:
    """The first back-ticked term of the section, else the first four words of the heading that aren't stop words."""
    ticked = F.regexp_extract(F.coalesce(section, F.lit("")), "`([^`\n]+)`", 1)
    words = F.filter(_all(heading, "[A-Za-z][A-Za-z0-9_.-]+"), lambda t: ~F.array_contains(_stop(STOP_FIELDS), F.lower(t)))
    return F.coalesce(F.nullif(ticked, F.lit("")), F.array_join(F.slice(words, 1, 4), " "))


def heading_slug(heading: Column) -> Column:
    """Lower-case ASCII letters and digits of a heading, joined by hyphens; `section` where there are none."""
    low = F.replace(F.lower(heading), F.lit("ß"), F.lit("ss"))
    s = F.regexp_replace(F.regexp_replace(low, "[`*_]", ""), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("section"))


def truncate(c: Column, most: int = 120) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def duration(seconds: Column) -> Column:
    """h/m/s text of a number of seconds, rounded down."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def parse_numbers(c: Column, kind: str = "int", least: float | None = None, most: float | None = None, fallback: tuple = ()) -> Column:
    """Distinct numbers of a list separated by commas or semicolons, in their order; what is invalid or out of range is dropped.

    Whole numbers are rounded towards 0, others to four digits; where nothing is left the fallback stands.
    """
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(",")), ",")
    own = F.array_compact(F.transform(parts, lambda p: F.trim(p).try_cast("double")))
    own = F.filter(own, lambda x: ~F.isnan(x) & (F.lit(least is None) | (x >= F.lit(least or 0.0))) & (F.lit(most is None) | (x <= F.lit(most or 0.0))))
    own = F.array_distinct(F.transform(own, lambda x: x.cast("int") if kind == "int" else F.round(x, 4)))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, fallback)).cast(f"array<{kind}>"))


def parse_flags(c: Column) -> Column:
    """Distinct on / off values of such a list, in their order; both where none is valid."""
    parts = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(",")), ","), lambda p: F.lower(F.trim(p)))
    own = F.transform(F.filter(parts, lambda p: p.isin("on", "off", "true", "false")), lambda p: p.isin("on", "true"))
    return F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.array(F.lit(False), F.lit(True)))


def passage_prefix(text: Column, model: Column, query: bool, instruction: str = "") -> Column:
    """Prefix that an embedding model expects: passage/query marks for e5, an instruction before qwen queries."""
    name = F.lower(model)
    e5 = F.concat(F.lit("query: " if query else "passage: "), text)
    qwen = F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text) if query else text
    return F.when(name.contains("e5"), e5).when(name.contains("qwen3"), qwen).otherwise(text)
