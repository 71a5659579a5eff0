"""Paths as Column expressions: normal form, comparison keys, segments, safety of archive entries."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import bind

# Device names that Windows reserves, as a pattern over the stem of a segment.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)"
# Characters that no Windows segment may have.
FORBIDDEN = r'[<>:"|?*]'
#: Bytes of UTF-8 that one segment of an archive entry may have.
SEGMENT_BYTES = 255
# Image suffixes and their formats.
SUFFIX_FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "gif": "gif", "webp": "webp"}
# Files that operating systems leave in folders.
SYSTEM_FILES = [".ds_store", "thumbs.db", "desktop.ini"]

_EDGE = "[\\s ﻿]"


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.astype(object).map(lambda t: t if t.isascii() else unicodedata.normalize(form, t), na_action="ignore").astype(object)

    return normal


def nfc(text: Column) -> Column:
    """Canonical composition, in Arrow batches; ASCII passes untouched."""
    return _normal("NFC")(text)


def nfkc_lower(text: Column) -> Column:
    """Compatibility composition in lower case: the equality of class names and archive entries."""
    return F.lower(_normal("NFKC")(text))


def strip_quotes(text: Column) -> Column:
    """Without one pair of equal quotes around it, trimmed inside as well."""
    trim = lambda t: F.regexp_replace(t, f"^{_EDGE}+|{_EDGE}+$", "")
    quoted = r"(?s)^([\"'])(.*)\1$"
    return bind(trim(text), lambda t: F.when(t.rlike(quoted), trim(F.regexp_extract(t, quoted, 2))).otherwise(t))


def slash_form(text: Column) -> Column:
    """``normalize_path`` but for the Unicode form: it stays inside code generation."""
    bare = F.regexp_replace(strip_quotes(text), r"(?i)^file://(?:/(?=[a-z]:[\\/]))?", "")
    one = F.regexp_replace(F.translate(bare, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(one, "(?<=.)/+$", "")


def normalize_path(text: Column) -> Column:
    """Trimmed, unquoted, composed, with single forward slashes, without file scheme and trailing slash."""
    return slash_form(nfc(text))


def path_key(text: Column) -> Column:
    """Key under which two paths are the same file: normal form in lower case."""
    return F.lower(normalize_path(text))


def segments(path: Column) -> Column:
    """Segments between slashes, without empty ones and dots."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def last_segment(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def has_traversal(path: Column) -> Column:
    return F.array_contains(F.split(F.translate(path, "\\", "/"), "/"), "..")


def is_absolute(path: Column) -> Column:
    """A root, a drive with a slash, or a file URL."""
    return strip_quotes(path).rlike(r"(?i)^([\\/]|[a-z]:[\\/]|file://)")


def redact(path: Column, keep: int = 3) -> Column:
    """The last ``keep`` segments, after an ellipsis where there were more."""
    parts = segments(path)
    tail = F.array_join(F.slice(parts, -keep, keep), "/")
    return F.when(F.size(parts) > keep, F.concat(F.lit("…/"), tail)).otherwise(F.array_join(parts, "/"))


def suffix_format(path: Column) -> Column:
    """Image format that the suffix stands for; null for other suffixes."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_FORMATS.items() for x in pair]), suffix)


def with_suffix(path: Column, suffix: Column) -> Column:
    """``path`` with its suffix swapped, or appended where it has none."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("."), suffix)


def entry_problem(name: Column) -> Column:
    """First reason why an archive entry isn't safe to extract, null if it is.

    Reasons in order: empty, control-character, absolute, drive-path,
    traversal, invalid-character, reserved-name, segment-too-long.
    """
    path = F.translate(name, "\\", "/")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    some = lambda test: F.exists(parts, test)
    reasons = [
        ("empty", name.isNull() | (F.trim(name) == "")),
        ("control-character", name.rlike(r"[\x00-\x1f\x7f]")),
        ("absolute", path.startswith("/")),
        ("drive-path", path.rlike("(?i)^[a-z]:")),
        ("empty", F.size(parts) == 0),
        ("traversal", some(lambda s: s.isin(".", ".."))),
        ("invalid-character", some(lambda s: s.rlike(FORBIDDEN) | s.endswith(" ") | s.endswith("."))),
        ("reserved-name", some(lambda s: s.rlike(RESERVED))),
        ("segment-too-long", some(lambda s: F.octet_length(s) > SEGMENT_BYTES)),
    ]
    return reduce(lambda e, r: e.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))


def shared_tail(a: Column, b: Column) -> Column:
    """How many trailing segments two paths have in common."""
    x, y = F.reverse(segments(a)), F.reverse(segments(b))
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & p.isNotNull())
    broken = F.array_position(same, False)
    return F.when(broken == 0, F.size(same)).otherwise(broken - 1).cast("int")


def fit_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8."""
    @F.pandas_udf(T.StringType())
    def fit(texts: pd.Series) -> pd.Series:
        return texts.astype(object).map(lambda t: t.encode()[:most].decode(errors="ignore"), na_action="ignore").astype(object)

    return F.when(F.octet_length(text) > most, fit(text)).otherwise(text)


def safe_file_name(name: Column) -> Column:
    """Control and forbidden characters to ``_``, no dots or blanks at the end, reserved names prefixed, never empty."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"|?*\\/]', "_"), r"[. ]+$", "")
    return F.when(clean == "", "_").when(clean.rlike(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def resolve_external(path: str | None, base: str | None) -> str | None:
    """A path against a base folder as drive, share, rooted or relative path; null where it has no meaning.

    No meaning have null and empty paths, drives without a slash, shares
    without a name, paths that climb above their root, and segments with
    characters that Windows forbids.
    """
    def parts(text: str | None) -> tuple[str, list[str]] | None:
        text = (text or "").strip()
        if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
            text = text[1:-1].strip()
        if re.match(r"(?i)file://", text):
            text = unquote(text[7:])
            text = text[1:] if re.match(r"(?i)/[a-z]:", text) else text if text.startswith("/") else "//" + text
        text = text.replace("\\", "/")
        share = re.match(r"//([^/]+)/+([^/]+)(?:/|$)(.*)", text)
        drive = re.match(r"(?i)([a-z]:)/(.*)", text)
        if share:
            return f"//{share[1]}/{share[2]}/", share[3].split("/")
        if text.startswith("//") or re.match(r"(?i)[a-z]:", text) and not drive:
            return None
        if drive:
            return drive[1] + "/", drive[2].split("/")
        return ("/", text[1:].split("/")) if text.startswith("/") else ("", text.split("/"))

    if path is None or not path.strip():
        return None
    own = parts(path)
    if own is None:
        return None
    root, names = own
    if not root and base:
        below = parts(base)
        if below is None:
            return None
        root, names = below[0], [*below[1], *names]
    kept: list[str] = []
    for name in names:
        if name in ("", "."):
            continue
        if name == "..":
            if not kept:
                return None
            kept.pop()
        elif re.search(r'[<>:"|?*]', name):
            return None
        else:
            kept.append(name)
    return root + "/".join(kept)


@F.pandas_udf(T.StringType())
def _external(path: pd.Series, base: pd.Series) -> pd.Series:
    none = lambda s: s.astype(object).where(s.notna(), None)
    return pd.Series([resolve_external(p, b) for p, b in zip(none(path), none(base))], dtype=object)


def external_path(path: Column, base: Column) -> Column:
    """``resolve_external`` in Arrow batches: climbing segments need a stack, which expressions don't have."""
    return _external(path, base)
