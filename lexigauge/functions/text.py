"""Text expressions: normalisation, buckets, rare characters, classification of lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text normalisation understands it.
SPACE_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The rare letters, in their order.
RARE_CHARS = "әғқңөұүіһ"
#: Letters that tell Kazakh, and Kazakh or Kyrgyz.
KAZAKH_ONLY = "әғқұіһ"
KAZAKH_OR_KYRGYZ = "ңөү"
#: Rare letters by report label; Latin i counts with і.
RARE_LABELS = {
    "Ә/ә": "ә", "Ғ/ғ": "ғ", "Қ/қ": "қ", "Ң/ң": "ң", "Ө/ө": "ө",
    "Ұ/ұ": "ұ", "Ү/ү": "ү", "Һ/һ": "һ", "І/і_or_I/i": "іi",
}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once.

    A lambda evaluates what it refers to outside itself anew for each element, unless that is a column
    or another lambda's variable; here it becomes the latter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column | str) -> Column:
    """Null is empty; runs of white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(column(text), F.lit("")), SPACE_CLASS + "+", " "))


def words(text: Column | str) -> Column:
    """Words of normalised text; none of an empty one."""
    return F.filter(F.split(column(text), " "), lambda w: w != "")


def page_tokens(text: Column | str) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(r"(?U)\w+"), F.lit(0))


def length_bucket(text: Column | str) -> Column:
    n = F.char_length(column(text))
    return F.when(n < 32, "short").when(n < 128, "medium").when(n < 512, "long").otherwise("very_long")


def length_bucket3(text: Column | str) -> Column:
    """The older buckets of page metrics."""
    n = F.char_length(normalize(text))
    return F.when(n < 50, "short").when(n <= 200, "medium").otherwise("long")


def rare_class(rare: str = RARE_CHARS) -> str:
    return "[" + rare + "]"


def has_rare(text: Column | str, rare: str = RARE_CHARS) -> Column:
    return F.lower(column(text)).rlike(rare_class(rare))


def _any_of(low: Column, chars: str) -> Column:
    return reduce(or_, [F.contains(low, F.lit(c)) for c in chars])


def _present(low: Column, rare: str) -> Column:
    found = [F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in rare]
    return F.when(low.isNotNull(), F.array_compact(F.array(*found)))


def rare_present(text: Column | str, rare: str = RARE_CHARS) -> Column:
    """The rare characters that occur, in the order of ``rare``; null for a null text."""
    return let(F.lower(column(text)), lambda low: _present(low, rare))


def only_rare(text: Column | str, rare: str = RARE_CHARS) -> Column:
    return F.regexp_replace(F.lower(column(text)), f"[^{rare}]", "")


def count_char(text: Column | str, char: str) -> Column:
    t = column(text)
    return F.char_length(t) - F.char_length(F.replace(t, F.lit(char), F.lit("")))


def invalid_charset(text: Column | str, charset: str) -> Column:
    """Whether a character is outside ``charset``."""
    return F.char_length(F.translate(column(text), charset, "")) > 0


def is_structural(text: Column | str) -> Column:
    """Whether the whole text is one bracketed mark."""
    return F.trim(column(text)).rlike(r"^\[[^\]]+\]$")


def _language(low: Column) -> Column:
    return (
        F.when(_any_of(low, KAZAKH_ONLY), "kazakh").when(_any_of(low, KAZAKH_OR_KYRGYZ), "kyrgyz_or_kazakh").otherwise("russian_or_other")
    )


def infer_language(text: Column | str, given: Column | str | None = None) -> Column:
    found = let(F.lower(F.coalesce(column(text), F.lit(""))), _language)
    return found if given is None else F.coalesce(F.nullif(column(given), F.lit("")), found)


def letter_marks(text: Column | str, rare: str = RARE_CHARS) -> Column:
    """struct(inferred, has_rare, present) of a text, which is put into lower case once; null is empty.

    White space holds none of the letters, so the text need not be normalised.
    """
    marks = lambda low: F.struct(
        _language(low).alias("inferred"), _any_of(low, rare).alias("has_rare"), _present(low, rare).alias("present")
    )
    return let(F.lower(F.coalesce(column(text), F.lit(""))), marks)


def infer_crop_type(zone_type: Column | str) -> Column:
    low = F.lower(F.coalesce(column(zone_type), F.lit("")))
    return F.when(F.contains(low, F.lit("cell")) | F.contains(low, F.lit("table")), "table_cell").otherwise("zone")


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(column(c), F.lit("")) for c in columns])


def zone_text(*names: str) -> Column:
    """Text of a zone: the first filled of its columns, else empty."""
    return F.coalesce(first_filled(*(names or ("text", "gt_text", "reference"))), F.lit(""))


def page_id(dataset: Column | str, index: Column | str) -> Column:
    """``dataset`` with slashes replaced, and a six-digit index (longer ones stay whole)."""
    return F.concat_ws("_", F.regexp_replace(column(dataset), "/", "__"), F.format_string("%06d", column(index)))


def image_ref(tar: Column | str, member: Column | str, plain: Column | str) -> Column:
    """``tar::member`` if both are there, else the plain reference."""
    both = F.concat(column(tar), F.lit("::"), column(member))
    return F.coalesce(both, column(plain))


def prompt_and_reference(text_info: Column | str) -> tuple[Column, Column]:
    """Texts of the last entries tagged ``mask`` and ``no_mask`` in an array of (text, tag)."""
    last = lambda tag: F.get(F.reverse(F.filter(column(text_info), lambda e: e["tag"] == tag)), F.lit(0))["text"]
    return F.coalesce(last("mask"), F.lit("")), F.coalesce(last("no_mask"), F.lit(""))


def page_reference(text_info: Column | str) -> Column:
    """Texts of all entries not tagged ``mask``, joined by spaces."""
    parts = F.filter(column(text_info), lambda e: (e["tag"] != "mask") & (F.coalesce(e["text"], F.lit("")) != ""))
    return F.array_join(F.transform(parts, lambda e: e["text"]), " ")


def glob_pattern(pattern: str) -> str:
    """A regular expression for a case-sensitive shell pattern."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"


def matches_any(patterns: list[str], *columns: Column | str) -> Column:
    """Whether a pattern matches one of the columns; no pattern matches all."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        for c in columns:
            out = out | F.coalesce(column(c).rlike(glob_pattern(p)), F.lit(False))
    return out


def escape_html(text: Column | str) -> Column:
    out = column(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out
