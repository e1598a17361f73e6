"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated, and replaced by a keyed Feistel permutation of the numbers of their
kind: card numbers keep their length, first digit, separators and a right check digit; phone numbers, social security
numbers, IPv4 addresses and dates stay valid ones of their format; IBANs keep country and letters and get a right
checksum. The permutation depends on the key and the value alone, so equal values stay linked across documents, and
different values of a kind stay different. Numbers that aren't valid of their kind stay as they are; cards and IBANs are
sought from every group of a run of groups on, so numbers or words beside a valid one don't hide it. Mail names and
secrets are permuted by a Feistel network whose halves are strings: characters move within their class, letters keep
their case. Mail addresses keep their domain and secrets their prefix, and secrets of hexadecimal digits stay such.

The key is an argument; whoever has it can invert the pseudonyms, so it belongs into a secret store. The query reads it
from the setting spark.orderloom.pii.key; without it a key is drawn for the run, and values are linked within it only.

A text is split at the matches and put together again with their pseudonyms; texts that can't hold a match are passed
on by one cheap test. Patterns repeat groups a bounded number of times, as the JVM's stack doesn't grow with the text.
DataFrame operations only, no shuffle, whole texts.

Defined results: a null text stays null with nothing found; overlapping matches are taken from the left, the first
pattern winning; repeated rows are treated alike; texts of any length are read whole; other columns, whatever their
names, are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Patterns of each kind, in order of precedence. A domain has 253 characters at most, so 126 dots.
KINDS = {
    "mail": r"(?<!%)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
START = r"(?<![A-Za-z0-9_.@+-])"
#: Groups that cards and IBANs are sought in, and how many of them one has at most.
RUNS = {"iban": (START + r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,}", " ", 9), "card": (START + r"[0-9][0-9 -]{11,}[0-9]", "[ -]", 19)}
#: A text without this holds no match.
MAYBE = r"[0-9]|@|(?i:password|passwd|pwd|secret|token|api_?key)"
#: The first day of the calendar, the days before 1900, those of the 200 years from then on, and all days to
#: the end of 9999, but for 49 at the end of 2099 that count with the others. Dates of these years are permuted among
#: themselves, other ones among the others; both numbers as products. Countries' digits in IBAN sums run from A = 10.
EPOCH, BEFORE, NEAR, FAR = "0001-01-01", 693_595, (250, 292), (121, 29_579)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it uses more than once, computed once."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def feistel(x: Column, u: int | Column, v: int | Column, kind: str, key: str) -> Column:
    """A keyed permutation of 0 .. u*v - 1."""
    u, v = (c if isinstance(c, Column) else F.lit(c).cast("long") for c in (u, v))
    start = F.struct((x - x % v).cast("long").alias("a"), (x % v).cast("long").alias("b"))
    start = F.struct((start.a / v).cast("long").alias("a"), start.b.alias("b"))

    def noise(i: Column, half: Column, name: str) -> Column:
        hashed = F.md5(F.concat_ws("|", F.lit(key), F.lit(kind + name), i.cast("string"), half.cast("string")).cast("binary"))
        return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        a = (acc.a + noise(i, acc.b, "a") % u) % u
        return _let(F.struct(a.alias("a"), acc.b.alias("b")), lambda s: F.struct(s.a.alias("a"), ((s.b + noise(i, s.a, "b") % v) % v).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda acc: acc.a * v + acc.b)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _put(m: Column, digits: Column) -> Column:
    """The characters of m with its digits replaced in order."""
    def char(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: char(i)), "")


def _padded(n: Column, width: int | Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _number(s: Column) -> Column:
    return s.cast("long")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last counted once."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2)))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: term(i)), F.lit(0), lambda a, x: a + x)


def _ten(n: Column) -> Column:
    """Ten to the power n, exactly."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _valid_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & ~d.rlike("^0+$") & (luhn_sum(d) % 10 == 0)


def _valid_iban(s: Column) -> Column:
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}$") & (F.length(_digits(F.substr(s, F.lit(5), F.length(s)))) >= 4) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1)


def _valid_parts(text: Column, kind: str, valid: Callable[[Column], Column]) -> Column:
    """A pattern of the valid numbers that begin and end at groups of the text's runs, for each first group the longest."""
    run, between, most = RUNS[kind]

    def longest(groups: Column, i: Column) -> Column:
        parts = F.transform(F.sequence(F.least(F.lit(most), F.size(groups) - i + 1), F.lit(1), F.lit(-1)), lambda n: F.slice(groups, i, n))
        return F.get(F.filter(parts, lambda x: ~F.array_contains(x, "") & valid(F.array_join(x, ""))), F.lit(0))

    def of_run(r: Column) -> Column:
        return _let(F.split(r, between), lambda groups: F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.array_join(longest(groups, i), between)))

    found = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), of_run)))
    by_length = F.transform(F.array_sort(F.transform(F.array_compact(found), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x.x)
    return F.coalesce(F.nullif(F.array_join(by_length, "|"), F.lit("")), F.lit("(?!)"))


def pattern_of(text: Column) -> Column:
    """What is to be found in a text: all kinds by their patterns, but of IBANs and cards the valid ones that it holds."""
    plain = lambda *kinds: "|".join(f"(?:{KINDS[k]})" for k in kinds)
    return F.concat(
        F.lit(f"{START}(?:{plain('mail', 'secret')}|(?:"), _valid_parts(text, "iban", _valid_iban), F.lit(f")(?![A-Za-z0-9])|{plain('ip', 'date', 'ssn', 'phone')})|(?<![A-Za-z0-9_.@+])(?:"),
        _valid_parts(text, "card", _valid_card), F.lit(")(?![0-9])"),
    )


def card(m: Column, key: str) -> Column:
    """Valid by Luhn, else unchanged."""
    def change(d: Column) -> Column:
        n = F.length(d) - 2
        right = F.floor(n / 2).cast("int")
        inner = _padded(feistel(_number(F.substr(d, F.lit(2), n)), _ten(n - right), _ten(right), "card", key), n)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), inner)
        return _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _let(_digits(m), lambda d: F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), _let(change(d), lambda new: _put(m, new))).otherwise(m))


def phone(m: Column, key: str) -> Column:
    """Any ten digits after the country code."""
    def split(d: Column) -> Column:
        country = F.substr(d, F.lit(1), F.length(d) - 10)
        change = _padded(feistel(_number(F.right(d, F.lit(10))), 100_000, 100_000, "phone", key), 10)
        return _let(F.concat(country, change), lambda new: _put(m, new))

    return _let(_digits(m), split)


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999; else unchanged."""
    area, group, serial = (_number(F.substr(m, F.lit(a), F.lit(n))) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = (area - 1 - F.when(area > 666, 1).otherwise(0)) * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def show(y: Column) -> Column:
        a = F.floor(y / (99 * 9999)) + 1
        b = y % (99 * 9999)
        return F.concat_ws("-", _padded(F.when(a >= 666, a + 1).otherwise(a), 3), _padded(F.floor(b / 9999) + 1, 2), _padded(b % 9999 + 1, 4))

    return F.when(valid, _let(feistel(x, 898, 99 * 9999, "ssn", key), show)).otherwise(m)


def ip(m: Column, key: str) -> Column:
    """Addresses with octets up to 255; else unchanged."""
    def change(o: Column) -> Column:
        octet = lambda k: _number(o[k])
        valid = (octet(0) <= 255) & (octet(1) <= 255) & (octet(2) <= 255) & (octet(3) <= 255)
        x = (octet(0) * 256 + octet(1)) * 65536 + octet(2) * 256 + octet(3)
        show = lambda y: F.concat_ws(".", *((F.floor(y / d) % 256).cast("string") for d in (16777216, 65536, 256, 1)))
        return F.when(valid, _let(feistel(x, 65536, 65536, "ip", key), show)).otherwise(m)

    return _let(F.split(m, r"\."), change)


def date(m: Column, key: str) -> Column:
    """Real dates, written year first, or day and month before the year; else unchanged.

    With a slash the month comes first unless it couldn't be one."""
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")
    part = lambda a: F.substr(m, F.lit(a), F.lit(2))
    year = F.when(iso, F.substr(m, F.lit(1), F.lit(4))).otherwise(F.substr(m, F.lit(7), F.lit(4)))
    us = slash & (_number(part(1)) <= 12)
    month = F.when(iso, part(6)).when(us, part(1)).otherwise(part(4))
    day = F.when(iso, part(9)).when(us, part(4)).otherwise(part(1))

    def show(new: Column) -> Column:
        first, second = F.when(us, F.date_format(new, "MM/dd/yyyy")).when(slash, F.date_format(new, "dd/MM/yyyy")), F.date_format(new, "dd.MM.yyyy")
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash, first).otherwise(second)

    def change(x: Column) -> Column:
        n = NEAR[0] * NEAR[1]
        near = x.between(BEFORE, BEFORE + n - 1)
        far = _let(feistel(F.when(x < BEFORE, x).otherwise(x - n), *FAR, "other date", key), lambda y: F.when(y < BEFORE, y).otherwise(y + n))
        return F.date_add(F.to_date(F.lit(EPOCH)), F.when(near, feistel(x - BEFORE, *NEAR, "date", key) + BEFORE).otherwise(far).cast("int"))

    parsed = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    days = F.datediff(parsed, F.to_date(F.lit(EPOCH))).cast("long")
    return _let(days, lambda x: F.when(x.isNotNull() & (x >= 0), _let(change(x), show)).otherwise(m))


def _mod97(s: Column) -> Column:
    """The IBAN remainder of a string of digits and capitals, moved into order already."""
    def add(acc: Column, i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("long")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0).cast("long"), add)


def iban(m: Column, key: str) -> Column:
    """Valid by its checksum, else unchanged; the first 17 digits after it are permuted."""
    def change(s: Column) -> Column:
        country, rest = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s))

        def put(d: Column) -> Column:
            n = F.least(F.length(d), F.lit(17))
            right = F.floor(n / 2).cast("int")
            new = F.concat(_padded(feistel(_number(F.substr(d, F.lit(1), n)), _ten(n - right), _ten(right), "iban", key), n), F.substr(d, n + 1, F.length(d)))
            body = _let(new, lambda digits: _put(rest, digits))
            return _let(body, lambda b: F.concat(country, _padded(98 - _mod97(F.concat(b, country, F.lit("00"))), 2), b))

        valid = _mod97(F.concat(rest, F.substr(s, F.lit(1), F.lit(4)))) == 1
        return F.when(valid & (F.length(_digits(rest)) >= 4), _let(_digits(rest), put)).otherwise(s)

    def spaced(new: Column) -> Column:
        char = lambda i: F.when(F.substr(m, i, F.lit(1)) == " ", " ").otherwise(F.substr(new, F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: char(i)), "")

    return _let(change(F.replace(m, F.lit(" "), F.lit(""))), spaced)


def _shifted(s: Column, seed: Column, letters: Column, sign: int = 1) -> Column:
    """Letters and digits of s moved on within their class by what a hash of the seed gives; letters: how many there are."""

    def moved(c: Column, i: Column, h: Column) -> Column:
        by = F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        put = lambda first, n: F.chr(F.pmod(F.ascii(c) - ord(first) + sign * by, n) + ord(first))
        return F.when(c.rlike("[0-9]"), put("0", F.lit(10))).when(c.rlike("[a-z]"), put("a", letters)).when(c.rlike("[A-Z]"), put("A", letters)).otherwise(c)

    def block(part: Column, j: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", seed, j.cast("string")).cast("binary"), 256)
        return _let(hashed, lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, i: moved(c, i, h)), ""))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s).{1,16}"), F.lit(0)), block), "")


def shuffled(s: Column, kind: str, tweak: Column, key: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the strings that have letters, digits and other characters at the same places.

    Case doesn't matter to what a letter becomes, and stays. tweak chooses among permutations."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))

    def run(letters: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            seed = lambda name, other: F.concat_ws("|", F.lit(key), F.lit(kind + name), i.cast("string"), tweak, F.sha2(F.lower(other).cast("binary"), 256))
            moved = _let(seed("a", acc.b), lambda x: F.struct(_shifted(acc.a, x, letters).alias("a"), acc.b.alias("b")))
            return _let(moved, lambda x: _let(seed("b", x.a), lambda y: F.struct(x.a.alias("a"), _shifted(x.b, y, letters).alias("b"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda acc: F.concat(acc.a, acc.b))

    return _let(F.when(s.rlike("^[0-9a-f]+$"), 6).otherwise(26) if hexadecimal else F.lit(26), run)


def mail(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(shuffled(name, "mail", F.lower(domain), key), F.lit("@"), domain)


def secret(m: Column, key: str) -> Column:
    """After the four letters of a key id, or after the sign and quote of an assignment."""
    name = F.regexp_extract(m, r"^(?:AKIA|ASIA|[A-Za-z_]+\s?[=:]\s?[\"']?)", 0)
    value = F.substr(m, F.length(name) + 1, F.length(m))
    return F.concat(name, F.when(value == "", "").otherwise(shuffled(value, "secret", F.lit(""), key, True)))


CHANGE = {"mail": mail, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, by its kind."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), CHANGE[kind](m, key)).otherwise(out)
    return F.coalesce(out, m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of docs with pseudonyms in the text; count_col: name of one more column, how many, which docs mustn't have."""
    if not key:
        raise ValueError("pseudonyms need a key")
    if count_col and count_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {count_col} already")
    text = F.col(f"row.`{text_col}`")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("pattern", F.when(text.rlike(MAYBE), pattern_of(text)))
    marked = marked.withColumn("found", F.regexp_extract_all(text, F.col("pattern"), F.lit(0)))
    marked = marked.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    gaps = F.split(text, F.col("pattern"), -1)
    joined = F.array_join(F.zip_with(gaps, F.col("new"), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.when(F.col("new").isNull(), 0).otherwise(F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))).cast("long")
    new = F.when(F.col("new").isNull(), text).otherwise(joined)
    own = [new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return marked.select(*own, *([changed.alias(count_col)] if count_col else []))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.orderloom.pii.key", None) or secrets.token_hex(32)
    return pseudonymise(docs, key, count_col="n_replaced").select("doc_id", "n_replaced", "text")
