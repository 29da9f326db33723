"""Text cleaning, metadata and small parsing expressions (Column -> Column).

All of them stay in JVM expressions. Character classes spell out the Unicode
white space that Java's default ``\\s`` leaves out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and line boundaries as Java regex classes.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END_CHARS = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
WORD = r"[a-z0-9_\p{L}\p{N}]"

ASCII_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

# Patterns and limits that decide results.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
NAME_PATTERN = r"[A-Za-z.'\-][A-Za-z .'\-]{0,48}[A-Za-z.'\-]"  # 2 to 50 characters, no white space at the ends
UNPRINTABLE = r"[^\x09\x0A\x20-\x7E\u00a0-\uffff]"
RULER_LINE = r"\A[\-=_*.]{3,}\z"
UNSAFE_KEY_CHARS = r"[^a-zA-Z0-9._\-]"
EMBEDDING_WORD_LIMIT = 6000
SEARCH_WORD_LIMIT = 1200
MISSING = "N/A"
UNKNOWN = "Unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends."""
    return F.btrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Stripped, non-blank lines."""
    # Both halves of a CR LF break the line; the empty one between them is dropped.
    stripped = F.transform(F.split(text, f"[{LINE_END_CHARS}]"), strip)
    return F.filter(stripped, lambda line: line != "")


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""

    def cut(t: Column) -> Column:
        # Text of one byte per character needs only the quick ASCII class.
        plain = (F.octet_length(t) == F.length(t)) & ~contains_any(t, ASCII_SEPARATORS)
        split = F.when(plain, F.split(t, r"\s+")).otherwise(F.split(t, f"{SPACE}+"))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(split)

    return let(strip(text), cut)


def word_tokens(text: Column, shortest: int = 2) -> Column:
    """Lower-cased runs of at least ``shortest`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{shortest},}}"), F.lit(0))


def first_email(text: Column) -> Column:
    found = F.when(text.contains("@"), F.regexp_extract(text, EMAIL_PATTERN, 0))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(MISSING))


def leading_name(text: Column) -> Column:
    """The first non-blank line when it looks like a person's name."""
    # All line ends are white space, so the first visible character opens that line. The name is cut
    # out as it is matched: a long first line is told by the first character that no name has.
    name = F.regexp_extract(text, rf"\A{SPACE}*+({NAME_PATTERN})(?:(?![{LINE_END_CHARS}]){SPACE})*+(?:[{LINE_END_CHARS}]|\z)", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(UNKNOWN))


def first_words(text: Column, limit: int) -> Column:
    """Cut to ``limit`` words; only a text that is cut gets single spaces."""

    def cut(whole: Column) -> Column:
        kept = let(
            words(whole),
            lambda ws: F.when(F.size(ws) > limit, F.array_join(F.slice(ws, 1, limit), " ")).otherwise(whole),
        )
        # More than ``limit`` words take at least twice as many characters, less one gap.
        return F.when(F.length(whole) > 2 * limit, kept).otherwise(whole)

    return let(text, cut)


def clean_for_embedding(text: Column, limit: int = EMBEDDING_WORD_LIMIT) -> Column:
    """Printable, whitespace-collapsed text of at most ``limit`` words."""
    printable = F.regexp_replace(F.coalesce(text, F.lit("")), UNPRINTABLE, " ")

    def one_space(t: Column) -> Column:
        spaced = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
        return F.when(t.contains("  ") | t.contains("\t"), spaced).otherwise(t)

    def two_newlines(t: Column) -> Column:
        return F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    return first_words(strip(let(let(printable, one_space), two_newlines)), limit)


def embeddable(text: Column, limit: int = EMBEDDING_WORD_LIMIT) -> Column:
    """The cleaned text, or null when nothing is left to embed."""
    return let(clean_for_embedding(text, limit), lambda cleaned: F.when(cleaned != "", cleaned))


def searchable_text(
    text: Column, name: Column, email: Column, limit: int = SEARCH_WORD_LIMIT
) -> Column:
    """Identity header plus the body without blank and ruler lines."""
    kept = F.filter(lines(text), lambda line: ~line.rlike(RULER_LINE))
    body = first_words(F.array_join(kept, "\n"), limit)
    return F.concat(
        F.lit("Candidate: "),
        F.coalesce(name, F.lit(UNKNOWN)),
        F.lit("\nEmail: "),
        F.coalesce(email, F.lit(MISSING)),
        F.lit("\n\n"),
        body,
    )


def record_key(email: Column, filename: Column) -> Column:
    """Stable store key of one person's file."""
    return F.concat(
        F.regexp_replace(email, UNSAFE_KEY_CHARS, "_"),
        F.lit("__"),
        F.regexp_replace(filename, UNSAFE_KEY_CHARS, "_"),
    )


def upload_date(uploaded_at: Column) -> Column:
    return F.coalesce(F.date_format(uploaded_at, "yyyy-MM-dd"), F.lit(MISSING))


def agent_label(agent: Column) -> Column:
    return F.initcap(F.translate(agent, "_", " "))


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def output_kind(output: Column) -> Column:
    """``error``, ``code`` or ``markdown``, by the look of an answer."""
    code_line = r"\A(def |class |import |print|#)"

    def kind(text: Column) -> Column:
        return (
            F.when(text.startswith("Traceback") | text.contains("Error"), F.lit("error"))
            .when(F.exists(lines(text), lambda line: line.rlike(code_line)), F.lit("code"))
            .otherwise(F.lit("markdown"))
        )

    return let(strip(output), kind)


def looks_like_code(code: Column) -> Column:
    return code.rlike(rf"\A{SPACE}*(def|print|import|#|for|while|if)")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Substring test against a short fixed list of phrases."""
    if not phrases:
        return F.lit(False)
    test = text.contains(phrases[0])
    for phrase in phrases[1:]:
        test = test | text.contains(phrase)
    return test


# Command phrases, first match wins, top to bottom.
MATCHER_COMMANDS = (
    ("more", ("more resumes", "upload more", "add resumes")),
    ("restart", ("restart", "reset", "new jd", "start over")),
    ("results", ("result", "rank", "show", "table")),
    ("stats", ("db stats",)),
)
SEARCH_COMMANDS = (
    ("only_matched", ("only shortlisted", "only matched")),
    ("show_all", ("show all", "remove filter")),
    ("stats", ("db stats",)),
)


def first_match(lowered: Column, commands, otherwise: str, head: Column | None = None) -> Column:
    """Label of the first command with a phrase in the text."""
    chain = head
    for label, phrases in commands:
        test = contains_any(lowered, phrases)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def matcher_intent(message: Column) -> Column:
    return let(F.lower(strip(message)), lambda m: first_match(m, MATCHER_COMMANDS, "other"))


def search_intent(message: Column) -> Column:
    def intent(lowered: Column) -> Column:
        head = F.when(lowered.startswith("set results"), F.lit("set_results"))
        return first_match(lowered, SEARCH_COMMANDS, "query", head)

    return let(F.lower(strip(message)), intent)


def requested_results(message: Column, lowest: int = 1, highest: int = 20) -> Column:
    """N of ``set results N`` clamped to the allowed range, null when it is no number."""
    lowered = F.lower(strip(message))
    last = F.try_element_at(words(lowered), F.lit(-1))
    number = F.when(last.rlike(r"\A[+-]?\d{1,37}\z"), last.try_cast("decimal(38,0)"))
    clamped = F.greatest(F.lit(lowest), F.least(F.lit(highest), number))
    return F.when(lowered.startswith("set results") & number.isNotNull(), clamped.cast("int"))


# Words a search query may hold that carry no meaning of their own.
QUERY_STOP_WORDS = (
    "a", "an", "the", "and", "or", "for", "with", "who", "has", "have", "in", "of",
    "to", "is", "are", "me", "find", "show", "candidates", "person", "people",
    "someone", "skills", "skill",
)


def query_keywords(query: Column, stop_words: Sequence[str] = QUERY_STOP_WORDS) -> Column:
    """Lower-cased query words of three or more characters outside the stop list."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(
        word_tokens(query, 1), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)
    )


def mentions_any(document: Column, keywords: Column) -> Column:
    """Whether the lower-cased document contains any keyword literally."""
    lowered = F.lower(F.coalesce(document, F.lit("")))
    return let(lowered, lambda d: F.exists(keywords, lambda w: d.contains(w)))
