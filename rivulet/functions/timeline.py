"""Rational time: ticks and timescales, fractions, clocks, and the text forms of numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = "decimal(38,0)"


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rescale(ts: Column, old: Column | int, new: Column | int) -> Column:
    """ts in units of 1/old as units of 1/new, truncated toward zero; null for no timestamp. Products beyond 64 bits go
    through decimals."""
    ts, old, new = ts.cast("long"), _c(old).cast("long"), _c(new).cast("long")
    wide = ts.cast(_DECIMAL) * new.cast(_DECIMAL)
    fits = F.abs(ts) <= F.lit((1 << 31) - 1)
    narrow = ts * new
    exact = lambda x: (x - x % old) / old
    return F.when(old == new, ts).when(fits & (new < (1 << 31)), exact(F.when(fits, narrow)).cast("long")).otherwise(exact(wide).cast("long"))


def compare_ts(a: Column, a_scale: Column | int, b: Column, b_scale: Column | int) -> Column:
    """-1, 0 or 1 by cross-multiplication, without rounding."""
    x, y = a.cast(_DECIMAL) * _c(b_scale).cast(_DECIMAL), b.cast(_DECIMAL) * _c(a_scale).cast(_DECIMAL)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def fraction_equal(a_num: Column, a_den: Column, b_num: Column, b_den: Column) -> Column:
    """1/2 equals 2/4."""
    return a_num.cast(_DECIMAL) * b_den.cast(_DECIMAL) == b_num.cast(_DECIMAL) * a_den.cast(_DECIMAL)


def parse_fraction(text: Column) -> Column:
    """struct(num, den) of `n/d`, `n-d`, an integer, or a decimal (trailing zeros of its fraction dropped); null otherwise."""
    pair = r"^([+-]?\d{1,18})[/-](\d{1,18})$"
    dec = r"^([+-]?)(\d{0,12})\.(\d{0,9}?)0*$"
    whole, part = F.regexp_extract(text, dec, 2), F.regexp_extract(text, dec, 3)
    den = F.pow(F.lit(10.0), F.length(part)).cast("long")
    num = F.when(F.regexp_extract(text, dec, 1) == "-", -1).otherwise(1) * (F.concat(F.lit("0"), whole).cast("long") * den + F.concat(F.lit("0"), part).cast("long"))
    struct = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    return (
        F.when(text.rlike(pair), struct(F.when(text.rlike(pair), F.regexp_extract(text, pair, 1)).cast("long"), F.when(text.rlike(pair), F.regexp_extract(text, pair, 2)).cast("long")))
        .when(text.rlike(r"^[+-]?\d{1,18}$"), struct(F.when(text.rlike(r"^[+-]?\d{1,18}$"), text).cast("long"), F.lit(1)))
        .when(text.rlike(dec) & (F.length(F.concat(whole, part)) > 0), struct(num, den))
    )


def parse_number(text: Column) -> Column:
    """A property number: a unit suffix k, m, g or s, `sec`, `min`, hexadecimal 0x, or +I and -I for the extremes."""
    body, low = r"^([+-]?\d+(?:\.\d+)?)", F.lower(text)
    value = lambda tail: F.when(low.rlike(body + tail + "$"), F.regexp_extract(low, body, 1)).cast("double")
    return (
        F.when(text == "+I", F.lit(float((1 << 31) - 1)))
        .when(text == "-I", F.lit(float(-(1 << 31))))
        .when(low.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(low, 3, 20), 16, 10).cast("double"))
        .when(low.rlike(body + "k$"), value("k") * 1_000)
        .when(low.rlike(body + "m$"), value("m") * 1_000_000)
        .when(low.rlike(body + "g$"), value("g") * 1_000_000_000)
        .when(low.rlike(body + "(s|sec)$"), value("(s|sec)") * 1_000)
        .when(low.rlike(body + "min$"), value("min") * 60_000)
        .when(low.rlike(body + "$"), value(""))
    )


def parse_time(text: Column) -> Column:
    """Milliseconds of T[[h:]m:]s[.f]. The fraction is read as a whole number of ms from its first two digits: .5 is 5 ms."""
    form = r"^T(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d{1,2})\d*)?$"
    part = lambda i: F.concat(F.lit("0"), F.regexp_extract(text, form, i)).cast("long")
    return F.when(text.rlike(form), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


def parse_range_time(text: Column) -> Column:
    """Milliseconds of a range border T[[h:]m:]s[.ms]: all digits are ms, and 1000 or more count as none."""
    form = r"^T(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d{1,9})\d*)?$"
    part = lambda i: F.concat(F.lit("0"), F.regexp_extract(text, form, i)).cast("long")
    return F.when(text.rlike(form), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + F.when(part(4) >= 1000, 0).otherwise(part(4)))


def clock(ms: Column, mark: str = ".") -> Column:
    """hh:mm:ss and milliseconds after mark."""
    at = lambda unit, most: (F.floor(ms / unit) % most).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("int"), at(60_000, 60), at(1000, 60), (ms % 1000).cast("int"))


def parse_clock(text: Column) -> Column:
    """Milliseconds of [hh:]mm:ss and .mmm or ,mmm."""
    form = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{3})$"
    part = lambda i: F.concat(F.lit("0"), F.regexp_extract(F.trim(text), form, i)).cast("long")
    return F.when(F.trim(text).rlike(form), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


#: Seconds from 1900 to 1970, the two epochs (a fixed value).
NTP_EPOCH = 2_208_988_800


def ntp_from_ms(utc_ms: Column) -> Column:
    """32.32 fixed-point seconds since 1900, as a signed 64-bit number."""
    seconds, ms = F.floor(utc_ms / 1000) + NTP_EPOCH, utc_ms % 1000
    return F.shiftleft(seconds.cast("long"), 32).bitwiseOR(F.floor(ms * (1 << 32) / 1000).cast("long"))


def ntp_seconds(ntp: Column) -> Column:
    return F.shiftrightunsigned(ntp, 32)


def ntp_diff_ms(a: Column, b: Column) -> Column:
    """a - b in milliseconds, each rounded down to one."""
    ms = lambda x: ntp_seconds(x) * 1000 + F.shiftrightunsigned(x.bitwiseAND((1 << 32) - 1) * 1000, 32)
    return ms(a) - ms(b)


def ntp_to_ms(ntp: Column) -> Column:
    """UTC milliseconds, rounded to the nearest."""
    return (ntp_seconds(ntp) - NTP_EPOCH) * 1000 + F.shiftrightunsigned(ntp.bitwiseAND((1 << 32) - 1) * 1000 + (1 << 31), 32)


def utc_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Milliseconds since 1970 of a UTC calendar date and time; null for a day that isn't in the calendar."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))
    return F.unix_date(date).cast("long") * 86_400_000 + (hour * 3600 + minute * 60 + second) * F.lit(1000).cast("long")


#: Month names of mail dates (fixed values).
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse_date(text: Column) -> Column:
    """UTC milliseconds of an ISO date (yyyy-mm-ddThh:mm:ss[.fff][Z|±hh:mm], no zone is UTC) or a mail date ([Www, ]dd Mon yyyy
    hh:mm:ss [GMT|±hhmm]); null for anything else."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(?:Z|([+-])(\d{2}):?(\d{2}))?$"
    mail = r"^(?:[A-Z][a-z]{2},? )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2})(?: (?:GMT|UTC|([+-])(\d{2})(\d{2})))?$"
    number = lambda form, i: F.concat(F.lit("0"), F.regexp_extract(text, form, i)).cast("int")

    def zone(form: str, i: int) -> Column:
        ms = (number(form, i + 1) * 60 + number(form, i + 2)) * 60_000
        return F.when(F.regexp_extract(text, form, i) == "-", -ms).otherwise(ms)

    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, mail, 2)).cast("int")
    fraction = F.rpad(F.substring(F.regexp_extract(text, iso, 7), 1, 3), 3, "0").cast("int")
    by_iso = utc_ms(*[number(iso, i) for i in range(1, 7)]) + fraction - zone(iso, 8)
    by_mail = utc_ms(number(mail, 3), month, number(mail, 1), *[number(mail, i) for i in (4, 5, 6)]) - zone(mail, 7)
    return F.when(text.rlike(iso), by_iso).when(text.rlike(mail), by_mail)


def range_spec(text: Column, fps: int = 25) -> Column:
    """struct(kind, value) of a range border: T times, D durations and dates in ms, TC time codes hh:mm:ss:ff and F frames in
    frames, S sizes in bytes, SAP without value; null for anything else."""
    code = r"^TC(\d{1,2}):(\d{2}):(\d{2}):(\d{2})$"
    part = lambda i: F.concat(F.lit("0"), F.regexp_extract(text, code, i)).cast("long")
    frames = ((part(1) * 60 + part(2)) * 60 + part(3)) * fps + part(4)
    rest = parse_number(F.substring(text, 2, 40)).cast("long")
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    return (
        F.when(text == "SAP", made("SAP", F.lit(None)))
        .when(text.rlike(code), made("TC", frames))
        .when(parse_range_time(text).isNotNull(), made("T", parse_range_time(text)))
        .when(text.rlike(r"^F\d+$"), made("F", rest))
        .when(text.rlike(r"^D\d"), made("D", rest))
        .when(text.rlike(r"^S\d"), made("S", rest))
        .when(parse_date(text).isNotNull(), made("date", parse_date(text)))
    )
