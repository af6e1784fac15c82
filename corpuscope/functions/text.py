"""Text rules as Column expressions: article cleaning, tokens, snippets.

Blanks are Unicode white space plus the four ASCII separators, as in Python's ``str.strip`` and
``str.split``.  Lines are told apart inside patterns over the whole text, where a line is what follows a newline, so rules run in
compiled code instead of a function for each line; no pattern repeats a group, so long lines need no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.vector import let

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"\A{WS}+|{WS}+\z"
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# the same blanks for Spark, whose patterns know Unicode's white space as a class of its own; a list of ranges takes ten times as long
BLANK, NOT_BLANK = r"(?U:[\s\x1c-\x1f])", r"(?U:[^\s\x1c-\x1f])"
#: Blanks inside a line, and what ends one.
GAP, LINE_END = r"(?U:[\s\x1c-\x1f&&[^\n]])*", r"(?=\n|\z)"

# The rules of the article and snippet formats.
REPLY_MARK = rf"(?i)\A(?:re:{WS}*)+"
# (patterns of whole lines are the ones that the checking SQL applies to stripped lines)
SEPARATOR = r"\A[-=_]{3,}\z"
ATTRIBUTION = r"(?is)\AIn article .* wrote:\z"
LOOSE_ATTRIBUTION = r"(?is)\AIn article.*wrote:"
SIGNATURES = ("--", "---")
SNIPPET_HEADERS = (
    "from:", "path:", "newsgroups:", "subject:", "message-id:", "date:", "organization:", "lines:", "references:", "sender:",
    "archive-name:", "last-modified:", "reply-to:",
)
METADATA_WORDS = ("archive-name", "last-modified")

MAX_SNIPPET = 400
TITLE_TOKENS, BODY_FOR_TITLE, LEAST_TOKENS = 10, 80, 10


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Blank-separated tokens; none of an empty or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{BLANK}+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"{NOT_BLANK}+"))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for one of some words in any case; words have no special characters but the hyphen."""
    return f"(?i:{'|'.join(words)})"


def _halves(raw: Column) -> Column:
    """Header and body, parted by the first blank line; each line follows a newline.  Without a blank line all is header."""
    return F.split(F.concat(F.lit("\n"), raw), rf"\n{GAP}{LINE_END}", 2)


def _subject_of(header: Column) -> Column:
    last = F.try_element_at(F.regexp_extract_all(header, F.lit(rf"\n{GAP}{any_of(('subject:',))}([^\n]*)"), F.lit(1)), F.lit(-1))
    return strip(F.regexp_replace(strip(last), REPLY_MARK, ""))


def subject(raw: Column) -> Column:
    """The last subject line without reply marks; empty if it is, null if there is none."""
    return _subject_of(F.element_at(_halves(raw), 1))


def clean_article(raw: Column) -> Column:
    """An article without headers, quotes, signature, separators and attribution, its subject in front.

    Without a blank line all lines are header.  Null stays null.
    """
    dropped = rf"\n{GAP}(?:>[^\n]*|[-=_]{{3,}}{GAP}|(?i:in article )[^\n]* (?i:wrote:){GAP}){LINE_END}"

    def made(halves: Column) -> Column:
        after = F.when(halves.isNotNull(), F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        body = F.element_at(F.split(after, rf"\n{GAP}-{{2,3}}{GAP}{LINE_END}", 2), 1)
        text = strip(F.regexp_replace(body, dropped, ""))
        title = F.coalesce(_subject_of(F.element_at(halves, 1)), F.lit(""))
        return let(title, lambda t: F.concat(F.when(t != "", F.concat(t, F.lit(". "))).otherwise(""), text))

    return strip(F.regexp_replace(F.regexp_replace(let(_halves(raw), made), "\n{3,}", "\n\n"), r"[ \t]+", " "))


def snippet(text: Column, max_chars: int = MAX_SNIPPET) -> Column:
    """A readable excerpt of a stored article: noise lines go, a short first line is a title, long text is cut."""

    headers, words = any_of(SNIPPET_HEADERS), any_of(METADATA_WORDS)
    noise = rf"\n{GAP}(?:[>|][^\n]*|{headers}[^\n]*|(?i:in article)[^\n]*(?i:wrote:)[^\n]*|-{{2,3}}{GAP}|[^\n@]*@[^\n]*|[^\n]*{words}[^\n]*|){LINE_END}"

    def quiet(s: Column) -> Column:
        return (s != "") & ~((s == F.upper(s)) & (s != F.lower(s)) & (token_count(s) > 3))

    def spaced(lines: Column) -> Column:
        return strip(F.regexp_replace(F.array_join(lines, " "), " {2,}", " "))

    def assemble(lines: Column) -> Column:
        titled = (F.size(lines) > 0) & (token_count(F.try_element_at(lines, F.lit(1))) <= TITLE_TOKENS)
        title = F.when(titled, F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"\.+\z", "")).otherwise("")
        body = spaced(F.when(titled, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines))

        def chosen(b: Column) -> Column:
            both = F.when((title != "") & (F.length(b) > BODY_FOR_TITLE), F.concat(title, F.lit(" — "), b))
            return both.when(b != "", b).otherwise(title)

        return let(let(body, chosen), lambda r: F.when(token_count(r) < LEAST_TOKENS, spaced(lines)).otherwise(r))

    def cut(r: Column) -> Column:
        return F.when(F.length(r) > max_chars, F.concat(F.regexp_replace(F.substring(r, 1, max_chars), r" [^ ]*\z", ""), F.lit("..."))).otherwise(r)

    whole = F.concat(F.lit("\n"), F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n")))
    lines = F.filter(F.transform(F.split(F.regexp_replace(whole, noise, ""), "\n", -1), strip), quiet)
    return let(let(lines, assemble), cut)
