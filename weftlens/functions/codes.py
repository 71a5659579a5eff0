"""Hashes, identifiers, enumerations, colours, dates and strict numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind

# Aliases of project types, split types and label origins.
PROJECT_TYPES = {"classification": "classification", "cls": "classification", "detection": "detection", "det": "detection", "segmentation": "segmentation", "seg": "segmentation"}
SPLIT_TYPES_V2 = {"train": "training", "training": "training", "val": "validation", "valid": "validation", "validation": "validation", "unassigned": "unassigned", "not-split": "unassigned", "not_split": "unassigned"}
SPLIT_TYPES = {"training": "training", "train": "training", "validation": "validation", "valid": "validation", "val": "validation", "notsplit": "unassigned", "unassigned": "unassigned", "none": "unassigned"}
LABEL_ORIGINS = {"man": "manual", "manual": "manual", "auto": "automatic", "automatic": "automatic"}
# Written names of the splits in the two generations.
SPLITS_V1 = {"training": "Training", "validation": "Validation", "unassigned": "Not split"}
SPLITS_V2 = {"training": "train", "validation": "val", "unassigned": "not-split"}
# Palettes for classes without a colour, of the two generations.
PALETTE_V2 = ["#CC3F31", "#2F80ED", "#27AE60", "#F2994A", "#9B51E0", "#00A3A3", "#EB5757", "#6FCF97", "#56CCF2", "#F2C94C"]
PALETTE_V1 = [0xFF00B050, 0xFFF00000, 0xFFFFC000, 0xFF0070C0, 0xFF7030A0, 0xFF00B0F0, 0xFFFF00FF, 0xFF92D050]
# The 32-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
SAFE_INTEGER = 9007199254740991


def mapped(value: Column, names: dict[str, str], otherwise: str = "unknown") -> Column:
    """The meaning of an alias, trimmed and in lower case; null stays null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.element_at(table, F.lower(F.trim(value))), F.lit(otherwise)))


def split_type(value: Column) -> Column:
    """Canonical split of a V1 spelling, separators ignored."""
    return mapped(F.regexp_replace(value, r"[ _-]+", ""), SPLIT_TYPES)


def split_type_v2(value: Column) -> Column:
    """Canonical split of a V2 spelling; a null one is ``unknown``."""
    return F.coalesce(mapped(value, SPLIT_TYPES_V2), F.lit("unknown"))


def canonical_split(types: Column) -> Column:
    """(split, state) of a file's memberships, given by their kinds.

    No membership is ``missing`` and leaves the file unassigned. Two known
    kinds are a ``conflict``; more than one membership, known or not, is
    ``repeated``. A split that no membership knows is ``unknown``.
    """
    kinds = F.array_distinct(F.filter(types, lambda t: t.isNotNull() & (t != "unknown")))
    none = F.coalesce(F.size(types) <= 0, F.lit(True))
    state = F.when(none, "missing").when(F.size(kinds) > 1, "conflict").when(F.size(types) > 1, "repeated").otherwise("ok")
    return F.struct(F.when(none, "unassigned").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("unknown").alias("split"), state.alias("state"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(points, F.lit(FNV_OFFSET).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))


def deterministic_uuid(text: Column) -> Column:
    """UUID-shaped identifier of a text: four salted hashes with the version and variant digits set."""
    digits = F.concat(*[F.lpad(F.lower(F.hex(fnv1a(F.concat(F.lit(f"{salt}:"), text)))), 8, "0") for salt in "abcd"])

    def shaped(digits: Column) -> Column:
        part = lambda start, n: F.substring(digits, start, n)
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))

    return bind(digits, shaped)


def project_number(identity: Column) -> Column:
    """Project id derived from the text of its identity."""
    return F.lit(100000) + fnv1a(identity) % 700000


def json_text(value: Column) -> Column:
    """A string as a JSON string, a null as null."""
    return F.regexp_replace(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1")


def project_identity(name: Column, classes: Column, files: Column) -> Column:
    """The identity of a project as JSON: its name, its classes (index, name) and files (index, path, file_name), each in order of index."""
    listed = lambda rows, *parts: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(F.lit("["), r["index"].cast("string"), *[F.concat(F.lit(","), json_text(r[p])) for p in parts], F.lit("]"))), ","), F.lit("]"))
    return F.concat(F.lit('{"name":'), json_text(name), F.lit(',"classes":'), listed(classes, "name"), F.lit(',"files":'), listed(files, "path", "file_name"), F.lit("}"))


def argb_number(color: Column, index: Column) -> Column:
    """Signed 32-bit ARGB of ``#rrggbb``, ``#aarrggbb`` or a whole number of 32 bits; the palette's colour where there is no text, null for any other text."""
    digits = F.regexp_extract(F.lower(F.trim(color)), r"^#([0-9a-f]{8}|[0-9a-f]{6})$", 1)
    value = F.conv(F.when(F.length(digits) == 6, F.concat(F.lit("ff"), digits)).when(F.length(digits) == 8, digits), 16, 10).cast("bigint")
    fallback = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in PALETTE_V1]), (index % len(PALETTE_V1) + 1).cast("int"))
    number = F.when(F.trim(color).rlike(r"^-?\d+$"), F.trim(color).try_cast("decimal(38,0)"))
    value = F.coalesce(value, F.when(number.between(-2147483648, 4294967295), number.cast("bigint")), F.when(F.coalesce(F.trim(color), F.lit("")) == "", fallback))
    return F.when(value > 2147483647, value - 4294967296).otherwise(value)


def argb_text(number: Column) -> Column:
    """``#rrggbb`` of an opaque signed or unsigned ARGB number, ``#aarrggbb`` of others; null outside 32 bits."""
    plain = F.when(number < 0, number + 4294967296).otherwise(number)
    digits = F.lower(F.lpad(F.hex(plain), 8, "0"))
    text = F.when(digits.startswith("ff"), F.concat(F.lit("#"), F.substring(digits, 3, 6))).otherwise(F.concat(F.lit("#"), digits))
    return F.when(number.between(-2147483648, 4294967295), text)


def class_color(color: Column, index: Column) -> Column:
    """``#RRGGBB`` without alpha; the palette's colour where the text is none."""
    digits = F.regexp_extract(F.upper(F.trim(color)), r"^#([0-9A-F]{2})?([0-9A-F]{6})$", 2)
    fallback = F.element_at(F.array(*map(F.lit, PALETTE_V2)), (index % len(PALETTE_V2) + 1).cast("int"))
    return F.when(digits != "", F.concat(F.lit("#"), digits)).otherwise(fallback)


def v1_date_ms(text: Column) -> Column:
    """Milliseconds of ``yyyy-MM-dd HH:mm:ss`` (or with T) read as UTC; null unless the calendar has it."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})$", i).try_cast("int")
    day = F.datediff(F.try_make_timestamp_ntz(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date"), F.lit("1970-01-01").cast("date"))
    inside = (part(4) < 24) & (part(5) < 60) & (part(6) < 60)
    return F.when(inside, (day.cast("bigint") * 86400 + part(4) * 3600 + part(5) * 60 + part(6)) * 1000)


def v1_date_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC of milliseconds, whatever the session's zone."""
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def strict_number(text: Column) -> Column:
    """A decimal number of at most 2^53 - 1 in size; null for any other text."""
    value = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) <= SAFE_INTEGER, value)


def strict_integer(text: Column) -> Column:
    """A whole number from 0 to 2^53 - 1 written in digits; null for any other text."""
    return F.when(text.rlike(r"^\d{1,16}$") & (text.try_cast("bigint") <= SAFE_INTEGER), text.try_cast("bigint"))


def strict_boolean(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def xml_escape(text: Column) -> Column:
    """The five entities of XML text, ampersands first."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def xml_legal(text: Column) -> Column:
    """Whether XML 1.0 allows every character."""
    return ~text.rlike("[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]")
