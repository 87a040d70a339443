"""Timestamps in mixed notations and zones, as one UTC instant in microseconds.

One regular expression holds every notation as an alternative with named groups.  A single
replacement rewrites a matching text to its components, which are then range-checked and put
together with integer day arithmetic.  Everything stays in built-in expressions; the only join is
with the small table of sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.session import bounded_broadcast

SEP = "\u0001"
FIELDS = ("y", "o", "d", "p", "q", "n", "h", "i", "s", "f", "a", "z", "e")
"""year, month, day, first and second of a slash date, month name, hour, minute, second, fraction,
half of day, zone, epoch number."""

# Month names in English and German.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11,
    "dec": 12, "mär": 3, "okt": 10, "dez": 12,
}

# Minutes east of UTC of zone abbreviations, and of those that differ by place.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "brt": -180,
}
BY_PLACE = {
    ("ist", "Europe/Dublin"): 60,
    ("ist", "Asia/Jerusalem"): 120,
    ("cst", "Asia/Shanghai"): 480,
    ("cst", "America/Havana"): -300,
    ("bst", "Asia/Dhaka"): 360,
}

ZONE = r"Z|[+-]\d{2}:?\d{2}(?:\[[^\]]*\])?|[+-]\d{2}|\[[A-Za-z0-9_+\-/]+\]|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|[A-Za-z]{1,5}"


def _clock(k: int, digits: str) -> str:
    return rf"(?<h{k}>{digits}):(?<i{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d+))?)?"


def _alternatives() -> list[str]:
    zone = lambda k: rf"(?:\s*(?<z{k}>{ZONE}))?"
    half = lambda k: rf"(?:\s*(?<a{k}>[AaPp]\.?[Mm]\.?))?"
    return [
        rf"(?<y1>\d{{4}})-(?<o1>\d{{2}})-(?<d1>\d{{2}})(?:(?:T|\s+){_clock(1, r'\d{2}')}{zone(1)})?",
        rf"(?<y2>\d{{4}})(?<o2>\d{{2}})(?<d2>\d{{2}})T(?<h2>\d{{2}})(?<i2>\d{{2}})(?:(?<s2>\d{{2}})(?:[.,](?<f2>\d+))?)?{zone(2)}",
        rf"(?:\p{{L}}{{2,10}}\.?,?\s+)?(?<d3>\d{{1,2}})[ -](?<n3>\p{{L}}{{3,9}})\.?[ -](?<y3>\d{{4}})(?:\s+{_clock(3, r'\d{1,2}')}{zone(3)})?",
        rf"(?<n4>\p{{L}}{{3,9}})\.?\s+(?<d4>\d{{1,2}}),?\s+(?<y4>\d{{4}})(?:,?\s+{_clock(4, r'\d{1,2}')}{half(4)}{zone(4)})?",
        rf"(?<d5>\d{{1,2}})\.\s*(?<n5>\p{{L}}{{3,9}})\.?\s+(?<y5>\d{{4}})(?:,?\s+{_clock(5, r'\d{1,2}')}(?:\s*Uhr)?{zone(5)})?",
        rf"(?<p6>\d{{1,2}})/(?<q6>\d{{1,2}})/(?<y6>\d{{4}})(?:,?\s+{_clock(6, r'\d{1,2}')}{half(6)}{zone(6)})?",
        rf"(?<d7>\d{{1,2}})\.(?<o7>\d{{1,2}})\.(?<y7>\d{{4}})(?:,?\s+{_clock(7, r'\d{1,2}')}(?:\s*Uhr)?{zone(7)})?",
        r"(?<e8>\d{1,15})",
    ]


PATTERN = r"(?iu)^\s*(?:" + "|".join(_alternatives()) + r")\s*$"
REPLACEMENT = SEP.join(
    "".join("${%s%d}" % (f, k) for k in range(1, 9) if f"(?<{f}{k}>" in PATTERN) for f in FIELDS
)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic only."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def _zone_names(spark: SparkSession) -> list[str]:
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _step(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """df with the columns computed once: a generator of one row, which the optimizer can't merge into later uses."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def normalize_instants(df: DataFrame, value: str, zone: str, day_first: str, out: str = "instant_us") -> DataFrame:
    """df with a bigint column ``out``: microseconds since 1970 UTC, null where the text is no real time.

    ``zone`` and ``day_first`` name columns with the IANA zone of zone-less texts and the order of
    slash dates.  Null, empty and unknown texts, impossible dates and clock times, unknown zones,
    and zone-less texts without a site give null; rows are never dropped.  A local time that a clock
    change skips moves later by the skipped span, a repeated one is the earlier; digits beyond the
    microsecond are cut; an existing column named ``out`` is replaced.
    """
    spark = df.sparkSession
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    # without SEP in the text only a match yields all fields, so their digits need no try_cast, which
    # throws and catches an exception for every empty field
    text = F.translate(F.col(value), SEP, " ")
    parts = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(REPLACEMENT)), SEP, -1)
    df = _step(df, ["*"], __p=F.when(F.size(parts) == len(FIELDS), parts))

    part = {f: F.get(F.col("__p"), k) for k, f in enumerate(FIELDS)}
    num = lambda f: F.when(part[f] != "", part[f]).cast("int")
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    site_first, slash = F.col(day_first), part["p"] != ""
    month, day = F.when(site_first, num("q")).otherwise(num("p")), F.when(site_first, num("p")).otherwise(num("q"))
    df = _step(
        df,
        ["*"],
        __y=num("y"),
        __m=F.when(slash & site_first.isNotNull(), month)
        .when(part["n"] != "", F.try_element_at(months, F.lower(part["n"])))
        .otherwise(num("o")),
        __d=F.when(slash & site_first.isNotNull(), day).otherwise(num("d")),
        __h=F.coalesce(num("h"), F.lit(0)),
        __i=F.coalesce(num("i"), F.lit(0)),
        __s=F.coalesce(num("s"), F.lit(0)),
        __f=F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("bigint"),
        __a=F.lower(F.substring(part["a"], 1, 1)),
        __z=F.regexp_replace(part["z"], r"(?<=\d)\[.*$|[\[\]]", ""),
        __e=F.when(part["e"] != "", part["e"]).cast("bigint"),
    )
    y, m, d, h, half = (F.col(c) for c in ("__y", "__m", "__d", "__h", "__a"))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    month_days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (
        (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= month_days) & (F.col("__i") <= 59) & (F.col("__s") <= 59)
        & F.when(half != "", h.between(1, 12)).otherwise(h <= 23)
    )
    hour = F.when(half == "p", h % 12 + 12).when(half == "a", h % 12).otherwise(h)
    seconds = days_from_civil(y, m, d) * 86400 + hour * 3600 + F.col("__i") * 60 + F.col("__s")

    z, site = F.col("__z"), F.col(zone)
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    placed = F.lit(None).cast("int")
    for (name, place), minutes in BY_PLACE.items():
        placed = F.when((F.lower(z) == name) & (site == place), minutes).otherwise(placed)
    digits = F.regexp_replace(z, "[^0-9]", "")
    numeric = z.rlike(r"^[+-]\d{2}(:?\d{2})?$")
    oh = F.when(numeric, F.substring(digits, 1, 2)).cast("int")
    om = F.coalesce(F.when(numeric & (F.length(digits) > 2), F.substring(digits, 3, 2)).cast("int"), F.lit(0))
    signed = (oh * 60 + om) * F.when(z.startswith("-"), -1).otherwise(1)
    # a zone name counts only if the JVM knows it, so that no text can fail the query
    region = F.when(z == "", site).when(z.contains("/"), z)
    names = ", ".join(f"'{x}'" for x in _zone_names(spark))
    df = _step(
        df,
        [*keep, "__e"],
        __local=F.when(real, seconds * 1_000_000 + F.col("__f")),
        __region=F.when(F.expr(f"CASE WHEN __z = '' THEN `{zone}` ELSE __z END IN ({names})"), region),
        __offset=F.when(numeric, F.when((oh <= 18) & (om <= 59), signed)).otherwise(
            F.coalesce(placed, F.try_element_at(abbreviations, F.lower(z)))
        ),
    )
    at, epoch = F.col("__local"), F.col("__e")
    by_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(at), F.col("__region")))
    instant = (
        F.when(epoch.isNotNull(), F.when(epoch < 100_000_000_000, epoch * 1_000_000).otherwise(epoch * 1000))
        .when(F.col("__region").isNotNull(), by_region)
        .when(F.col("__offset").isNotNull(), at - F.col("__offset").cast("bigint") * 60_000_000)
    )
    return df.select(*keep, instant.alias(out))


def instants_with_sites(
    df: DataFrame, sites: DataFrame, key: str, value: str, kind: str, max_sites: int = 100_000
) -> DataFrame:
    """rec_kind, rec_id and instant_us of each usable text; sites gives zone and day order by product.

    ``sites`` is broadcast only if it holds at most ``max_sites`` rows.  A product without a site keeps
    only the texts that carry their own zone.  Repeated rows stay repeated.
    """
    s = sites.filter(F.col("product").isNotNull()).groupBy("product").agg(
        F.min("tz_name").alias("__zone"), F.min("day_first").alias("__first")
    )
    rows = df.select(F.col(key).alias("rec_id"), F.col(value).alias("__value"), "product")
    rows = rows.filter(F.col("__value").isNotNull())
    joined = rows.join(bounded_broadcast(s, max_sites), "product", "left")
    done = normalize_instants(joined, "__value", "__zone", "__first")
    return done.filter("instant_us is not null").select(F.lit(kind).alias("rec_kind"), "rec_id", "instant_us")
