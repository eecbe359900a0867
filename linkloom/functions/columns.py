"""Scalar functions as column expressions: no Python, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII (one block of Unicode) and its plain forms.
WIDE_ASCII = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
PLAIN_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Characters that file systems refuse, and their full-width likes.
REFUSED, ALLOWED = '/\\:*?"<>|', "／＼：＊？″＜＞｜"


def narrow(c: Column) -> Column:
    """Full-width ASCII and the ideographic space as plain ASCII."""
    return F.translate(c, WIDE_ASCII, PLAIN_ASCII)


def plain_key(c: Column) -> Column:
    """A comparison key without width, case and blanks."""
    return F.lower(F.replace(narrow(c), F.lit(" "), F.lit("")))


def title_key(c: Column) -> Column:
    """``plain_key`` without the signs that decorate titles."""
    return F.regexp_replace(plain_key(c), "[\\-.・/:;,_~〜()\\[\\]「」『』【】<>]", "")


def season_of(date: Column) -> Column:
    """YYYY-winter, -spring, -summer or -autumn of a date, by quarters of the year."""
    return F.concat_ws("-", F.year(date), F.element_at(F.array(*[F.lit(x) for x in ("winter", "spring", "summer", "autumn")]), F.quarter(date)))


def title_year(title: Column) -> Column:
    """The year that a title names in parentheses: (2011), （2011年版）."""
    year = F.regexp_extract(narrow(title), "[(]([0-9]{4})(?:年版)?[)]", 1).try_cast("int")
    return F.when(year > 0, year)


def label_number(text: Column) -> Column:
    """The positive whole number of a label that is nothing but one: 第7話, 7話, #07, ep.7, 7; null otherwise."""
    t = plain_key(text)
    digits = F.regexp_extract(t, "^(?:第?([0-9]{1,9})(?:話|回|幕|夜|局|羽)|[#♯]([0-9]{1,9})|ep(?:isode)?\\.?([0-9]{1,9})|([0-9]{1,9}))$", 0)
    n = F.regexp_extract(digits, "([0-9]+)", 1).try_cast("int")
    return F.when(n > 0, n)


def fractional_label(text: Column) -> Column:
    """The canonical decimal of a label such as 第08.50話 (8.5): a string, never a float. Null for others and for x.0."""
    t = plain_key(text)
    whole = F.regexp_extract(t, "^(?:第|[#♯]|ep(?:isode)?\\.?)?([0-9]{1,6})[.]([0-9]{1,6})話?$", 1)
    part = F.regexp_replace(F.regexp_extract(t, "^(?:第|[#♯]|ep(?:isode)?\\.?)?([0-9]{1,6})[.]([0-9]{1,6})話?$", 2), "0+$", "")
    return F.when((whole != "") & (part != ""), F.concat(F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.lit("."), part))


def episode_number(number: Column, text: Column, sort: Column) -> Column:
    """The number that an episode goes by.

    A fractional identity has none. A number that is whole and positive is it; any other number leaves it to the label,
    and so does a label without a number; the sort key is asked only where both are missing.
    """
    blank = text.isNull() | (F.trim(narrow(text)) == "")
    fraction = fractional_label(text).isNotNull() | (number.isNotNull() & (number != F.floor(number)))
    whole = F.when((number > 0) & (number == F.floor(number)), number.cast("int"))
    return F.when(fraction, F.lit(None).cast("int")).when(number.isNotNull(), F.coalesce(whole, label_number(text))).when(~blank, label_number(text)).otherwise(F.when(sort > 0, sort.cast("int")))


def path_component(text: Column) -> Column:
    """Text as one component of a path on any system."""
    clean = F.regexp_replace(F.translate(text, REFUSED, ALLOWED), "[\\x00-\\x1f\\x7f]", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, "^[\\s　]+", ""), "[\\s　.]+$", "")
    reserved = F.upper(F.regexp_extract(clean, "^([^.]*)", 1)).rlike("^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(reserved, F.concat(F.lit("＿"), clean)).otherwise(clean)


def same_parts(a: Column, b: Column, separators: str = "[/／]") -> Column:
    """Whether two texts have the same parts in any order, at least two of them."""
    parts = lambda c: F.array_sort(F.filter(F.transform(F.split(c, separators), lambda x: plain_key(x)), lambda x: x != ""))
    return (parts(a) == parts(b)) & (F.size(parts(a)) >= 2)


def one_edit_apart(a: Column, b: Column, least: int = 10) -> Column:
    """Whether two texts of at least ``least`` characters differ by one character changed or added."""
    return (F.least(F.length(a), F.length(b)) >= least) & (a != b) & (F.levenshtein(a, b) == 1)


def search_keyword(title: Column) -> Column:
    """The longest word of a title, Japanese words before others; of equals the first."""
    words = F.filter(F.split(title, "[ 　]+"), lambda w: w != "")
    ranked = F.transform(words, lambda w, i: F.struct(F.when(w.rlike("[ぁ-ヿ㐀-鿿]"), 1).otherwise(0).alias("j"), F.length(w).alias("n"), (-i).alias("i"), w.alias("w")))
    return F.array_max(ranked)["w"]


def search_variants(title: Column) -> Column:
    """Spellings under which a title may be found, each once, in a fixed order."""
    squeezed = F.replace(F.replace(title, F.lit(" "), F.lit("")), F.lit("　"), F.lit(""))
    bare = F.regexp_replace(title, " ?(?:第[0-9]期|Season [0-9]|[0-9](?:nd|rd) Season|II|III)$", "")
    made = F.array(title, narrow(title), squeezed, F.translate(title, "〜・～", "   "), bare)
    return F.array_distinct(F.filter(made, lambda x: x != ""))


def folder_hint(path: Column) -> Column:
    """The name of a file's folder."""
    return F.nullif(F.regexp_extract(path, "([^/]*)/[^/]*$", 1), F.lit(""))
