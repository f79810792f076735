"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to. Fixed values.
MARKED, PLAIN = "àâäáãçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def light_stem(token: Column) -> Column:
    """Plural s or x goes from words of five letters or more."""
    return F.when((F.length(token) >= 5) & token.rlike("[sx]$"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; shorter arrays have none. ``words`` must be a
    column of its own: an expression would be evaluated for each run."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


#: Character references that are read, besides numbers of printable ASCII. Fixed values.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"), ("&rsquo;", "’"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Text of markup: scripts, styles and comments go with what they hold; p,
    br, div and li become spaces and other tags nothing, so a word that a tag
    parts stays whole; references are read, white space is collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)</?(p|br|div|li)(\s[^>]*|/)?>", " ")
    out = F.regexp_replace(out, r"(?s)</?[A-Za-z][^>]*>|<![^>]*>", "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def capped(text: Column, n: int) -> Column:
    """At most n characters, and an ellipsis where some were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def numbers(text: Column) -> Column:
    """Distinct numbers with grouped thousands joined, in order of appearance."""
    raw = F.regexp_extract_all(text, F.lit(r"[0-9]{1,3}(?:[ ,][0-9]{3})+|[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda x: F.regexp_replace(x, "[ ,]", "")))
