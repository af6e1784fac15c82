"""The rules of articles and snippets against a plain Python reading of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text as T

ARTICLES = {
    "plain": ("From: a\nSubject: Re: RE:  hello\n\nbody line\nmore", "hello. body line\nmore"),
    "no blank line": ("From: a\nbody", ""),
    "subject only, no body": ("Subject: x", "x."),
    "leading blank": ("\nSubject: not a header\ntext", "Subject: not a header\ntext"),
    "last subject wins": ("Subject: one\nsubject: two\n\nb", "two. b"),
    "last subject empty": ("Subject: one\nSubject:\n\nb", "b"),
    "quotes and attribution": ("h\n\n> q\n  > q\nIn Article 5 he WROTE:\nkept", "kept"),
    "attribution must end": ("h\n\nIn article 5 he wrote: x", "In article 5 he wrote: x"),
    "signature stops": ("h\n\na\n--\nb", "a"),
    "long signature stops": ("h\n\na\n---\nb", "a"),
    "signature with blanks": ("h\n\na\n -- \nb", "a"),
    "separators": ("h\n\na\n=====\n-=_\n==\nb", "a\n==\nb"),
    "blank runs": ("h\n\na\n\n\n\nb", "a\n\nb"),
    "lines of blanks stay apart": ("h\n\na\n \n \nb", "a\n \n \nb"),
    "tabs": ("h\n\na\t\tb  c", "a b c"),
    "unicode blanks": ("h\n \na ", "a"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", ARTICLES)
def test_clean_article(spark, name):
    raw, want = ARTICLES[name]
    got = spark.createDataFrame([(raw,)], "raw string").select(T.clean_article(F.col("raw"))).first()[0]
    assert got == want


def test_nulls(spark):
    row = spark.createDataFrame([(None,)], "raw string").select(T.clean_article(F.col("raw")), T.snippet(F.col("raw")), T.token_count(F.col("raw")), T.subject(F.col("raw"))).first()
    assert tuple(row) == (None, "", 0, None)


def words(n: int) -> str:
    return " ".join(["word"] * n)


SNIPPETS = {
    "empty": ("", ""),
    "title and long body": (f"Title here...\n{words(20)}", f"Title here — {words(20)}"),
    "title and short body": (f"Title here.\n{words(12)}", words(12)),
    "body of exactly 80": ("A title.\n" + ("a " * 39 + "aa"), "a " * 39 + "aa"),
    "body of 81": ("A title.\n" + ("a " * 39 + "aaa"), "A title — " + "a " * 39 + "aaa"),
    "ten tokens are a title": ("a b c d e f g h i j\n" + words(30), "a b c d e f g h i j — " + words(30)),
    "eleven are not": ("a b c d e f g h i j k\n" + words(30), "a b c d e f g h i j k " + words(30)),
    "short guard restores dots": ("Short title...\nfew words", "Short title... few words"),
    "literal newline": ("one\\ntwo " + words(12), "two " + words(12)),
    "noise goes": ("> q\n| q\nFrom: x\nX@Y\nIn article 5 wrote: x\nFOUR UPPER CASE WORDS\nsee Archive-Name x\n--\n---\nTHREE UPPER WORDS\n" + words(30), "THREE UPPER WORDS — " + words(30)),
    "cut at a blank": (words(90), words(80) + "..."),
    "exactly 400 stays": ("a b c d e f g h i j k " + "x" * 378, "a b c d e f g h i j k " + "x" * 378),
    "no blank to cut at": ("x" * 500, "x" * 400 + "..."),
}


@pytest.mark.parametrize("name", SNIPPETS)
def test_snippet(spark, name):
    text, want = SNIPPETS[name]
    got = spark.createDataFrame([(text,)], "t string").select(T.snippet(F.col("t"))).first()[0]
    assert got == want
