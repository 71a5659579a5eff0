"""Mixed timestamp texts to one UTC instant (problem 1).

Every text is parsed under every format that it satisfies. Per source an
expectation-maximisation over the mixture of formats weighs the candidates:
a value contributes likelihood under each valid parse, and the posterior
chooses its interpretation or leaves it marked as ambiguous.

Rows are first reduced to counts of (source, candidate pattern). The number of
patterns is bounded by the format list, not by the data, so the fit sees whole
sources however large they are and no source becomes one large task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import set_aside

# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "NPT": 345, "KST": 540, "JST": 540, "SGT": 480, "HKT": 480, "AEST": 600, "AEDT": 660, "ACST": 570, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180}
# Abbreviations that name more than one zone; each reading is a format of its own.
SHARED_ABBREVIATIONS = {"CST": {"cst_china": 480, "cst_america": -360}, "IST": {"ist_india": 330, "ist_ireland": 60}}
# English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\[[A-Za-z0-9_/+-]+\])?"
#: Family, pattern, and the groups in the order year, month, day, hour, minute, second, fraction, half of the day, zone.
FAMILIES = [
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("named", rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}})(?: {_CLOCK}(?: ?([AaPp][Mm]))?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:,? {_CLOCK}(?: ?([AaPp][Mm]))?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("korean", rf"^(\d{{4}})년 ?(\d{{1,2}})월 ?(\d{{1,2}})일(?: (?:(오전|오후) ?)?{_CLOCK})?$", "$1|$2|$3|$5|$6|$7|$8|$4|"),
    ("cjk", rf"^(\d{{4}})年 ?(\d{{1,2}})月 ?(\d{{1,2}})日(?: ?(?:(上午|下午|午前|午後) ?)?{_CLOCK})?$", "$1|$2|$3|$5|$6|$7|$8|$4|"),
]
#: Digit strings and the wrapper of old JSON writers: group 1 counts from 1970 in the unit given by its length or kind.
EPOCHS = [("epoch_s", r"^\d{10}$"), ("epoch_ms", r"^\d{13}$"), ("epoch_us", r"^\d{16}$"), ("json_date", r"^/Date\((-?\d{1,17})(?:[+-]\d{4})?\)/$")]

_EM = "source string, pattern string, format string, posterior double, ambiguous boolean"
_PLAUSIBLE_FROM = "2000-01-01"


def _epoch_ms(ntz: Column) -> Column:
    """Milliseconds of a zoneless timestamp read as UTC, whatever the session's zone."""
    days = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)) * 1000


def parse_candidates(df: DataFrame, text: str, zone: str, day_first: str | None = None, arrival: str | None = None) -> DataFrame:
    """``df`` with ``candidates``: array of (format, epoch_ms, plausible, against) for each valid parse of ``text``.

    ``zone`` names the column with the IANA zone of texts that name none (null:
    such texts have no candidate). Both orders of day and month are candidates;
    one that a stated ``day_first`` speaks against is marked. Null, blank and
    impossible texts give an empty array.
    """
    value = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    family = reduce(lambda e, f: e.when(value.rlike(f[1]), f[0]), [*EPOCHS, *FAMILIES], F.when(value.isNull() | (value == ""), F.lit(None).cast("string")))
    out = df.withColumn("__value", value).withColumn("__family", family)
    parts = reduce(lambda e, f: e.when(F.col("__family") == f[0], F.regexp_replace("__value", f[1], f[2])), FAMILIES, F.when(F.lit(False), ""))
    out = out.withColumn("__p", F.split(parts, r"\|", -1))

    def number(i: int) -> Column:
        return F.expr(f"try_cast(__p[{i}] as int)")

    month_name = F.lower(F.substring(F.col("__p")[1], 1, 3))
    second_part = F.when(F.col("__family") == "named", F.array_position(F.array(*map(F.lit, MONTHS)), month_name).cast("int")).otherwise(number(1))
    half, hour = F.lower(F.col("__p")[7]), F.coalesce(number(3), F.lit(0))
    hour = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None))
        .when(half.isin("pm", "오후", "下午", "午後"), hour % 12 + 12)
        .otherwise(hour % 12)
    )
    second = F.coalesce(number(5), F.lit(0))
    out = out.withColumns({
        "__y": number(0), "__a": second_part, "__b": number(2), "__h": hour, "__min": F.coalesce(number(4), F.lit(0)),
        "__s": F.when(second < 60, second), "__ms": F.expr("coalesce(try_cast(rpad(substr(__p[6], 1, 3), 3, '0') as int), 0)"), "__zone": F.col("__p")[8],
    })

    named = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    sign = F.when(F.col("__zone").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace("__zone", "[^0-9]", "")
    by_digits = sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.expr("try_cast(substr(regexp_replace(__zone, '[^0-9]', ''), 3, 2) as int)"), F.lit(0)))
    out = out.withColumn("__offset", F.when(F.col("__zone").rlike(r"^[+-]\d"), by_digits).otherwise(F.element_at(named, F.col("__zone"))))

    def instant(month: Column, day: Column, offset: Column) -> Column:
        wall = F.try_make_timestamp_ntz(F.col("__y"), month, day, F.col("__h"), F.col("__min"), F.col("__s").cast("decimal(16,6)"))
        at_station = F.when(F.col(zone).isNotNull(), _epoch_ms(F.convert_timezone(F.col(zone), F.lit("UTC"), wall)))
        zoned = F.when(offset.isNotNull(), _epoch_ms(wall) - offset * 60000)
        return F.when(F.col("__zone") == "", at_station).otherwise(zoned) + F.col("__ms")

    digits_ms = (
        F.when(F.col("__family") == "epoch_s", F.expr("try_cast(__value as bigint)") * 1000)
        .when(F.col("__family") == "epoch_ms", F.expr("try_cast(__value as bigint)"))
        .when(F.col("__family") == "epoch_us", F.floor(F.expr("try_cast(__value as bigint)") / 1000))
        .when(F.col("__family") == "json_date", F.regexp_extract("__value", EPOCHS[3][1], 1).cast("bigint"))
    )
    a, b, offset = F.col("__a"), F.col("__b"), F.col("__offset")
    hint = F.col(day_first) if day_first else F.lit(None).cast("boolean")
    is_numeric = F.col("__family") == "numeric"
    choices = [
        F.struct(F.col("__family").alias("format"), digits_ms.alias("epoch_ms")),
        F.struct(F.concat("__family", F.when(F.col("__zone") == "", "_local").otherwise("_zoned")).alias("format"), F.when(~is_numeric, instant(a, b, offset)).alias("epoch_ms")),
        F.struct(F.lit("numeric_dmy").alias("format"), F.when(is_numeric, instant(b, a, offset)).alias("epoch_ms")),
        F.struct(F.lit("numeric_mdy").alias("format"), F.when(is_numeric, instant(a, b, offset)).alias("epoch_ms")),
        *[
            F.struct(F.lit(name).alias("format"), F.when((F.col("__zone") == short) & ~is_numeric, instant(a, b, F.lit(minutes))).alias("epoch_ms"))
            for short, readings in SHARED_ABBREVIATIONS.items()
            for name, minutes in readings.items()
        ],
    ]
    # In the numeric family the groups are first, second: "dmy" has the day in a, so month and day swap for it.
    latest = F.unix_millis(F.col(arrival)) + 86_400_000 if arrival else F.unix_millis(F.current_timestamp())
    earliest = F.lit(int(pd.Timestamp(_PLAUSIBLE_FROM).timestamp() * 1000))
    valid = F.filter(F.array(*choices), lambda c: c["epoch_ms"].isNotNull() & c["format"].isNotNull())
    against = lambda f: F.coalesce(((f == "numeric_dmy") & ~hint) | ((f == "numeric_mdy") & hint), F.lit(False))
    judged = F.transform(valid, lambda c: F.struct(c["format"].alias("format"), c["epoch_ms"].alias("epoch_ms"), c["epoch_ms"].between(earliest, latest).alias("plausible"), against(c["format"]).alias("against")))
    return out.withColumn("candidates", judged).select(*df.columns, "candidates")


#: The component of texts that mean none of their parses; it is no format.
UNREADABLE = "unreadable"


def _fit(patterns: pd.DataFrame, rounds: int, unlikely: float, misled: float, unreadable: float, sure: float) -> pd.DataFrame:
    """Mixture weights of one source by EM over its pattern counts, then the posterior choice of each pattern.

    A parse has likelihood 1, ``unlikely`` outside the plausible span, and
    ``misled`` of that against the source's own word; that a text means none of
    its parses has ``unreadable``.
    """
    patterns = patterns[patterns["pattern"] != ""]
    if patterns.empty:
        return pd.DataFrame({"source": [], "pattern": [], "format": [], "posterior": [], "ambiguous": []}).astype({"source": object, "pattern": object, "format": object, "posterior": float, "ambiguous": bool})
    weights = {"1": 1.0, "0": unlikely, "1!": misled, "0!": unlikely * misled}
    parsed = [[(c.rsplit("=", 1)[0], weights[c.rsplit("=", 1)[1]]) for c in p.split(";")] + [(UNREADABLE, unreadable)] for p in patterns["pattern"]]
    names = sorted({f for p in parsed for f, _ in p})
    place = {f: i for i, f in enumerate(names)}
    like = np.zeros((len(parsed), len(names)))
    for i, p in enumerate(parsed):
        for f, x in p:
            like[i, place[f]] = x
    n, weight = patterns["n"].to_numpy(float), np.full(len(names), 1 / len(names))
    for _ in range(rounds):
        share = like * weight
        share /= share.sum(1, keepdims=True)
        new = (share * n[:, None]).sum(0) + 1e-3
        new /= new.sum()
        if np.abs(new - weight).max() < 1e-9:
            break
        weight = new
    share = like * weight
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    top = share[np.arange(len(parsed)), best]
    return pd.DataFrame({"source": patterns["source"].tolist(), "pattern": patterns["pattern"].tolist(), "format": [names[b] for b in best], "posterior": top, "ambiguous": top < sure}).astype({"source": object, "pattern": object, "format": object})


def normalise_timestamps(df: DataFrame, text: str, zone: str, source: list[str], day_first: str | None = None, arrival: str | None = None, rounds: int = 50, unlikely: float = 0.01, misled: float = 1e-9, unreadable: float = 1e-6, sure: float = 0.9) -> DataFrame:
    """``df`` with ``format``, ``epoch_ms``, ``posterior`` and ``ambiguous``.

    ``source`` names the columns that tell sources apart; each gets its own
    mixture over formats and one component of texts that mean none of their
    parses (likelihood ``unreadable``). A value outside the plausible span
    counts ``unlikely`` as much, an order of day and month that a stated
    ``day_first`` speaks against ``misled``: less than that it is no date, so a
    month of 14 isn't rescued by the other order. A posterior below ``sure``
    leaves the value ambiguous: its chosen format is reported, its
    ``epoch_ms`` is null. Texts without a valid parse (null, blank, impossible,
    or better explained as none) have null format and instant and are not
    ambiguous. Repeated
    rows each count. An empty table gives an empty table. Columns of ``df``
    that clash with the new ones are kept under a name with ``_in`` after it.
    """
    df, name = set_aside(df, ["candidates", "format", "epoch_ms", "posterior", "ambiguous"])
    text, zone, source, day_first, arrival = name(text), name(zone), [name(c) for c in source], day_first and name(day_first), arrival and name(arrival)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in source])
    pattern = F.array_join(F.array_sort(F.transform("candidates", lambda c: F.concat(c["format"], F.when(c["plausible"], "=1").otherwise("=0"), F.when(c["against"], "!").otherwise("")))), ";")
    parsed = parse_candidates(df, text, zone, day_first, arrival).withColumns({"__source": key, "__pattern": pattern})
    # Texts without a candidate leave in the fit: a filter here would be pushed below the parse and copy it many times over.
    counts = parsed.groupBy(F.col("__source").alias("source"), F.col("__pattern").alias("pattern")).agg(F.count("*").alias("n"))
    fitted = counts.groupBy("source").applyInPandas(lambda p: _fit(p, rounds, unlikely, misled, unreadable, sure), _EM)
    fitted = fitted.select(F.col("source").alias("__source"), F.col("pattern").alias("__pattern"), "format", "posterior", "ambiguous")
    joined = parsed.join(fitted, ["__source", "__pattern"], "left")
    chosen = F.filter("candidates", lambda c: c["format"] == F.col("format"))
    return joined.select(
        *df.columns, F.when(F.col("format") != UNREADABLE, F.col("format")).alias("format"), F.when(~F.col("ambiguous"), F.try_element_at(chosen, F.lit(1))["epoch_ms"]).alias("epoch_ms"), "posterior", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")
    )
