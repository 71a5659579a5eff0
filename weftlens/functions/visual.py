"""One consistent form for texts that read alike (used by path keys and by the look-alike operator).

``visual_form`` decomposes, drops what can't be seen, replaces look-alike
letters of other scripts, unifies spaces and hyphens and composes again.
Letters keep their case and their visible accents; printable ASCII is left
as it is.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letter each one looks like.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "օ": "o", "ք": "p", "զ": "q",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɑ": "a", "ɡ": "g",
}
# Hyphens and minus signs that are drawn as a short stroke.
HYPHENS = "‐‑‒–⁃−﹘﹣－֊"
# Characters without a shape that aren't of the format category.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
# Tags of compatibility decompositions that keep the shape.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")


def is_ignorable(ch: str) -> bool:
    """Format characters, variation selectors and fillers: nothing is drawn for them."""
    return unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in UNSEEN or "᠋" <= ch <= "᠏"


@lru_cache(maxsize=65536)
def shape_of(ch: str) -> str:
    """The decomposed form of one character that stands for its shape; '' if it has none."""
    if " " <= ch <= "~":
        return ch
    if is_ignorable(ch):
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in LOOK_ALIKES:  # before its decomposition: the lunate sigma decomposes to a letter of another shape
        return LOOK_ALIKES[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts and (not parts[0].startswith("<") or parts[0] in SAME_SHAPE):
        return "".join(shape_of(chr(int(p, 16))) for p in parts if not p.startswith("<"))
    if "가" <= ch <= "힣":
        return unicodedata.normalize("NFD", ch)
    if unicodedata.category(ch) == "Zs":
        return " "
    return ch


def visual_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(shape_of, text)))


@F.pandas_udf(T.StringType())
def _visual(texts: pd.Series) -> pd.Series:
    return texts.astype(object).map(visual_form, na_action="ignore").astype(object)


def visual_column(text: Column) -> Column:
    """``visual_form`` of a string column, in Arrow batches: Spark has no Unicode normalisation of its own."""
    return _visual(text)


def visual_path(path: Column) -> Column:
    """Key by which paths compare: consistent form, one kind of slash, no letter case."""
    return F.lower(F.translate(visual_column(path), "\\", "/"))


@lru_cache(maxsize=1)
def changed_characters() -> dict[str, str]:
    """Every character whose form differs from it, with its form: what a table for other engines needs besides canonical composition.

    By rule, over the planes that hold such characters: the first, the
    mathematical alphabets, and the tags and selectors.
    """
    spans = (range(0x80, 0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800), range(0xE0000, 0xE01F0))
    pairs = ((chr(c), unicodedata.normalize("NFC", shape_of(chr(c)))) for span in spans for c in span)
    return {c: form for c, form in pairs if form != unicodedata.normalize("NFC", c)}


@lru_cache(maxsize=1)
def compatible_characters() -> dict[str, str]:
    """Every character whose compatibility form differs from its canonical one, with that form, by rule over the same planes."""
    spans = (range(0x80, 0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800))
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for span in spans for c in span)
    return {c: form for c, form in pairs if form != unicodedata.normalize("NFC", c)}


def form_sql(texts: str, characters: dict[str, str] | None = None) -> str:
    """SQL (common table expressions) of ``forms(text, form)`` for the query ``texts`` of a column ``text``; the characters of the visual form if none are given."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    table = ", ".join(f"({quote(c)}, {quote(f)})" for c, f in (characters or changed_characters()).items())
    return f"""changed(c, shape) as (values {table}),
spelled as (select text, i, substring(text, i, 1) as c from (select distinct text, unnest(range(1, length(text) + 1)) as i from ({texts}) where text is not null)),
forms as (select text, nfc_normalize(string_agg(coalesce(shape, c), '' order by i)) as form from spelled left join changed using (c) group by text union all select '', '')"""
