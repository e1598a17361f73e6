"""Products, their sessions, month codes and symbol formats."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timing import as_date, day_ns, second_of_day, iso_weekday, seconds, us_summer, SECOND

# Month codes in order.
MONTH_CODES = "FGHJKMNQUVXZ"
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


@dataclass(frozen=True)
class Product:
    """What is fixed for a product; times are UTC seconds of the day."""

    name: str
    tick: float
    point_value: float
    currency: str
    exchange: str
    provider: str
    zone: str
    floor: float
    rth: str
    sessions: dict[str, tuple[str, str]] = field(default_factory=dict)
    open_close: tuple[str, str] = ("22:00:00", "21:00:00")
    lunch: tuple[str, str] | None = None
    maintenance: tuple[str, str] | None = None
    warmup: bool = False

    @property
    def tick_fp(self) -> int:
        return int(self.tick * SECOND)


# Product, tick, point value, currency, time zone, price floor.
_NEW_YORK = {"edt": ("13:30:00", "20:00:00"), "est": ("14:30:00", "21:00:00")}
_TOKYO = {"asia": ("01:00:00", "06:15:00"), "us": ("13:30:00", "20:00:00")}
_BERLIN = {"cet": ("08:00:00", "22:00:00")}
_HONG_KONG = {"utc": ("01:15:00", "08:30:00")}
_NIGHT = ("21:00:00", "22:00:00")
PRODUCTS = {
    p.name: p
    for p in (
        Product("ES", 0.25, 50.0, "USD", "CME", "databento", "America/New_York", 500, "us_eastern", _NEW_YORK, maintenance=_NIGHT),
        Product("NIY", 5.0, 500.0, "JPY", "CME", "databento", "Asia/Tokyo", 5000, "fixed_utc", _TOKYO, maintenance=_NIGHT, warmup=True),
        Product("NKD", 5.0, 5.0, "USD", "CME", "databento", "Asia/Tokyo", 5000, "fixed_utc", _TOKYO, maintenance=_NIGHT, warmup=True),
        Product("FDAX", 0.5, 25.0, "EUR", "EUREX", "databento", "Europe/Berlin", 1000, "fixed_cet", _BERLIN, ("00:10:00", "21:00:00")),
        Product("FESX", 1.0, 10.0, "EUR", "EUREX", "databento", "Europe/Berlin", 1000, "fixed_cet", _BERLIN, ("00:10:00", "21:00:00")),
        Product("FSMI", 1.0, 10.0, "CHF", "EUREX", "databento", "Europe/Zurich", 1000, "fixed_cet", _BERLIN, ("06:50:00", "21:00:00")),
        *(
            Product(name, 1.0, value, "HKD", "HKEX", "HKEX", "Asia/Hong_Kong", floor, "fixed_utc", _HONG_KONG, ("01:15:00", "08:30:00"), ("04:00:00", "05:00:00"))
            for name, value, floor in (("HSI", 50.0, 5000), ("MHI", 10.0, 5000), ("HHI", 50.0, 1000), ("MCH", 10.0, 1000))
        ),
    )
}


def available_products() -> list[str]:
    return list(PRODUCTS)


def product(name: str) -> Product:
    if name not in PRODUCTS:
        raise ValueError(f"unknown product {name}")
    return PRODUCTS[name]


def info(name: str) -> dict:
    p = product(name)
    return {**p.__dict__, "tick_size_pts": p.tick, "tick_size_fp": p.tick_fp, "default_session": rth_times(p, dt.date(2025, 1, 1))}


def dim_product(spark: SparkSession) -> DataFrame:
    """One row per product: a dimension of a dozen rows, fixed in size."""
    rows = [(p.name, p.tick, p.tick_fp, p.point_value, p.currency, p.exchange, p.provider) for p in PRODUCTS.values()]
    return spark.createDataFrame(rows, "product string, tick_size_pts double, tick_size_fp long, point_value double, currency string, exchange string, provider string")


def product_of(contract: str) -> str:
    """The product with the longest name that the contract begins with."""
    found = [p for p in PRODUCTS if contract.startswith(p)]
    if not found:
        raise ValueError(f"no product for contract {contract}")
    return max(found, key=len)


def product_of_column(contract: Column) -> Column:
    """The same for a column: longest names are tried first."""
    out = F.lit(None).cast("string")
    for name in sorted(PRODUCTS, key=len):
        out = F.when(contract.startswith(name), F.lit(name)).otherwise(out)
    return out


def rth_times(p: Product, day: dt.date, session: str = "default") -> tuple[str, str]:
    """UTC start and end of a session on a day."""
    if session != "default":
        if session not in p.sessions:
            raise ValueError(f"{p.name} has no session {session}")
        return p.sessions[session]
    if p.rth == "us_eastern":
        return p.sessions["edt" if us_summer(day) else "est"]
    start, end = next(iter(p.sessions.values()))
    if p.rth == "fixed_cet":
        return tuple(f"{(int(t[:2]) - 1) % 24:02d}{t[2:]}" for t in (start, end))
    return start, end


def rth_bounds(name: str, day: str | dt.date, session: str = "default") -> dict[str, int | None]:
    """Nanosecond bounds of a session, and of its lunch break; other sessions than the default have none."""
    p, day = product(name), as_date(day)
    at = lambda t: day_ns(day) + seconds(t) * SECOND
    start, end = rth_times(p, day, session)
    lunch = p.lunch if session == "default" else None
    return {"start": at(start), "end": at(end), "lunch_start": at(lunch[0]) if lunch else None, "lunch_end": at(lunch[1]) if lunch else None}


def bounds_table(spark: SparkSession, name: str, days: list[dt.date], session: str = "default") -> DataFrame:
    """Bounds of each day, for ranges: as many rows as there are days."""
    rows = [(d, *rth_bounds(name, d, session).values()) for d in days]
    return spark.createDataFrame(rows, "session_date date, rth_start long, rth_end long, lunch_start long, lunch_end long")


def full_session(name: str, ns: Column) -> Column:
    """Whether a time is in the electronic session: outside maintenance, or on a weekday within hours, or outside lunch."""
    p, s = product(name), second_of_day(ns)
    within = lambda times: (s >= seconds(times[0])) & (s < seconds(times[1]))
    if p.exchange == "CME":
        return ~within(p.maintenance)
    if p.exchange == "EUREX":
        return iso_weekday(ns).between(1, 5) & within(p.open_close)
    inside = within(p.open_close)
    return inside & ~within(p.lunch) if p.lunch else inside


def month_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k + 1, MONTH_NAMES[k]) for k, c in enumerate(MONTH_CODES)], "code string, month int, name string")


def expiry(contract: Column) -> Column:
    """Months since year 0 of the expiry in a contract like ESZ25; null for spreads and others."""
    code = F.regexp_extract(contract, rf"^[A-Z]+([{MONTH_CODES}])(\d{{2}})$", 1)
    year = F.regexp_extract(contract, rf"^[A-Z]+([{MONTH_CODES}])(\d{{2}})$", 2)
    return F.when(code != "", (2000 + year.cast("int")) * 12 + F.position(code, F.lit(MONTH_CODES)))


def _year(digit: Column, session_year: Column) -> Column:
    """The last two digits of the year meant by one digit, not more than two years before the session's."""
    candidate = session_year - session_year % 10 + digit.cast("int")
    full = F.when(candidate < session_year - 2, candidate + 10).otherwise(candidate)
    return F.lpad((full % 100).cast("string"), 2, "0")


def parse_symbol(symbol: Column, session_year: Column) -> Column:
    """(product, contract, is_spread) of the four vendor formats; null for any other symbol."""
    s, m = F.trim(symbol), MONTH_CODES
    name = lambda pattern, k: F.regexp_extract(s, pattern, k)
    outright, spread = rf"^([A-Z]+)([{m}])(\d)$", rf"^([A-Z]+)([{m}])(\d)-[A-Z]+([{m}])(\d)$"
    eurex, eurex_spread = r"^([A-Z]+)\s+SI\s+(\d{4})(0[1-9]|1[0-2])\d{2}\s+CS$", rf"^([A-Z]+)\.S\.({'|'.join(MONTH_NAMES)})(\d{{2}})\.({'|'.join(MONTH_NAMES)})(\d{{2}})\.SPD$"
    code_of_number = lambda c: F.substr(F.lit(m), c.cast("int"), F.lit(1))
    code_of_name = lambda c: F.substr(F.lit(m), ((F.position(c, F.lit("".join(MONTH_NAMES))) + 2) / 3).cast("int"), F.lit(1))

    def made(product_name: Column, contract: Column, is_spread: bool) -> Column:
        return F.struct(product_name.alias("product"), contract.alias("contract"), F.lit(is_spread).alias("is_spread"))

    digit = lambda pattern, k: _year(name(pattern, k), session_year)
    return (
        F.when(s.rlike(outright), made(name(outright, 1), F.concat(name(outright, 1), name(outright, 2), digit(outright, 3)), False))
        .when(s.rlike(spread), made(name(spread, 1), F.concat(name(spread, 1), F.lit("_CAL_"), name(spread, 2), digit(spread, 3), name(spread, 4), digit(spread, 5)), True))
        .when(s.rlike(eurex), made(name(eurex, 1), F.concat(name(eurex, 1), code_of_number(name(eurex, 3)), F.substr(name(eurex, 2), F.lit(3), F.lit(2))), False))
        .when(
            s.rlike(eurex_spread),
            made(
                name(eurex_spread, 1),
                F.concat(name(eurex_spread, 1), F.lit("_CAL_"), code_of_name(name(eurex_spread, 2)), name(eurex_spread, 3), code_of_name(name(eurex_spread, 4)), name(eurex_spread, 5)),
                True,
            ),
        )
    )


def parse_hkex_symbol(symbol: Column, session_year: Column) -> Column:
    """(product, contract) of a Hong Kong future like HSIG6; null for options and others."""
    pattern, s = rf"^([A-Z]{{2,4}})([{MONTH_CODES}])(\d)$", F.trim(symbol)
    part = lambda k: F.regexp_extract(s, pattern, k)
    contract = F.concat(part(1), part(2), _year(part(3), session_year))
    return F.when(s.rlike(pattern), F.struct(part(1).alias("product"), contract.alias("contract")))
