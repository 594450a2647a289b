"""Text functions: native column expressions, evaluated inside the JVM.

White space means the same explicit character set everywhere (regular
expression ``\\s`` and ``trim`` differ between engines on no-break and other
Unicode blanks).  ``\\z`` is the very end of the text; ``$`` would also match
before a final line break.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from matterlake import schemas as S

# The characters that count as white space.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set for character classes; ranges keep the regular expressions fast.
BLANK_SET = (
    "\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK = "[" + BLANK_SET + "]"
NON_BLANK = "[^" + BLANK_SET + "]"

# What a document title may end in.
TITLE_EXTENSIONS = r"\.(docx?|dotx?|rtf)\z"
TITLE_COPY_MARK = BLANK + r"*\([0-9]+\)" + BLANK + r"*\z"
TITLE_VERSION_MARK = "[" + BLANK_SET + r"_-]*v[0-9]+(\.[0-9]+)*" + BLANK + r"*\z"
TITLE_STATUS_MARK = (
    "["
    + BLANK_SET
    + r"_-]*(final|draft|signed|executed|clean|redline|markup|wip)"
    + BLANK
    + r"*\z"
)
TITLE_PASSES = 5

# What a file-name hint may carry besides the matter name.
HINT_EXTENSIONS = r"(?i)\.(docx?|pdf)\z"
HINT_MARKS = r"(?i)_v[0-9]+|_final|_draft|_clean"

# An ASCII word boundary; the engine's own \b is Unicode-aware.
WORD_BOUNDARY = (
    "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)

# A stretch without an end mark, with its end marks when a blank or the end of
# the text follows.  Every stretch is consumed, so a long text without any end
# mark is still read once.
SENTENCE = "[^.!?]+(?:[.!?]++(?:" + BLANK + r"|\z))?"
SENTENCE_MARK = "[.!?]"
# Just behind an end mark and a blank.
SENTENCE_END = "(?<=[.!?]" + BLANK + ")"


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_wildcards(c: Column) -> Column:
    """Remove the two SQL pattern characters."""
    return F.translate(c, "%_", "")


def normalise_title(c: Column) -> Column:
    """Collapse file endings, copy, version and status marks of a title."""
    title = F.regexp_replace(trim_blanks(F.lower(c)), TITLE_EXTENSIONS, "")
    for _ in range(TITLE_PASSES):
        for mark in (TITLE_COPY_MARK, TITLE_VERSION_MARK, TITLE_STATUS_MARK):
            title = F.regexp_replace(title, mark, "")
    return trim_blanks(F.regexp_replace(title, BLANK + "+", " "))


def clean_hint(c: Column) -> Column:
    """A file name or text start reduced to a possible matter name."""
    bare = F.regexp_replace(F.regexp_replace(c, HINT_EXTENSIONS, ""), HINT_MARKS, "")
    return trim_blanks(strip_wildcards(bare))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def contains_word(name: Column, text: Column) -> Column:
    """``name`` occurs literally in ``text`` between ASCII word boundaries."""
    wanted = F.lower(trim_blanks(name))
    quoted = F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(
        F.lit(WORD_BOUNDARY + "\\Q"), quoted, F.lit("\\E" + WORD_BOUNDARY)
    )
    return (F.length(wanted) >= 3) & F.regexp_like(F.lower(text), pattern)


def haystack(*hints: Column) -> Column:
    """Join the non-empty hints by one blank."""
    return F.concat_ws(" ", *[F.nullif(h, F.lit("")) for h in hints])


def normalise_line_ends(c: Column) -> Column:
    return trim_blanks(F.replace(c, F.lit("\r\n"), F.lit("\n")))


def paragraphs(c: Column) -> Column:
    """Non-empty paragraphs, split on blank lines."""
    parts = F.transform(F.split(normalise_line_ends(c), "\n{2,}"), trim_blanks)
    return F.filter(parts, lambda p: F.length(p) > 0)


def sentences(c: Column, lossy: bool = False) -> Column:
    """Sentences of a text; ``lossy`` drops fragments without a full end."""
    if lossy:
        found = F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))
        return F.filter(found, lambda s: F.regexp_like(s, F.lit(SENTENCE_MARK)))
    return F.filter(F.split(c, SENTENCE_END), lambda s: F.length(s) > 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NON_BLANK + "+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_BLANK + "+"))


def approx_tokens(c: Column) -> Column:
    """Characters divided by four, rounded up."""
    return F.ceil(F.length(c) / F.lit(S.CHARS_PER_TOKEN)).cast("int")


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def context_block(
    matter: Column,
    client: Column,
    side: Column,
    kind: Column,
    text: Column,
    labels: tuple[str, str, str, str] = ("matter", "client", "side", "kind"),
) -> Column:
    """One line per known value under its label, an empty line, then the text."""
    known = [
        F.when(F.length(value) > 0, F.concat(F.lit(f"{label} = "), value, F.lit("\n")))
        for label, value in zip(labels, (matter, client, side, kind))
    ]
    lines = F.concat_ws("", *known)
    return F.concat(lines, F.when(lines != "", "\n").otherwise(""), text)
