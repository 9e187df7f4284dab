"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Validated card numbers, IBANs, social security numbers, phone numbers, IPv4
addresses, calendar dates and e-mail addresses are permuted within their own
format.  A value is read as symbols, each with its own radix (digits 10, letters
26, octets 256, ...), split into two halves that the rounds of an unbalanced
Feistel network add to in turn, and written back in place of the old symbols.
Separators, case, country codes, card brands and domains stay; check digits are
made anew.  The permutation depends on the key, the kind and the value alone, so
equal values stay linked across documents whatever their separators.

Built-in column functions only, one projection and no exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import free_name

#: Key of the production query; a deployment passes its own.
KEY = "ohmgrid-example-key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "date", "ssn", "phone", "ipv4")

#: One alternative per kind, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][-.])(?:[3-6][0-9]{3}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720))"
    # A gap does not lead into a social security number or a date, which are values of their own.
    r"(?:[0-9]|[ -](?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?:19|20)[0-9]{2}[-/.][01][0-9][-/.][0-3][0-9](?![0-9])|[0-3][0-9][-/.][0-3][0-9][-/.](?:19|20)[0-9]{2}(?![0-9]))[0-9]){9,15}(?![0-9A-Za-z])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}"
    r"|(?:0[1-9]|1[0-2])([-/.])(?:1[3-9]|2[0-9]|3[01])\3(?:19|20)[0-9]{2})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
}
#: Cheap test that a text can hold any of them: an at sign or two digits not far apart.
MAYBE = r"@|[0-9][0-9]|[0-9]\.[0-9]"
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 x 4,297.
DATE_RADICES = (17, 4297)
FIRST_DAY = "1900-01-01"
#: Symbols of a block; longer values take several blocks, each permuted under its own number.
BLOCK = 20


def _any(patterns: dict[str, str]) -> str:
    out, groups = [], 0
    for pattern in patterns.values():
        own = pattern.replace(r"\1", rf"\{groups + 1}").replace(r"\2", rf"\{groups + 2}").replace(r"\3", rf"\{groups + 3}")
        groups += pattern.count("([-/.])")
        out.append(own)
    return "|".join(out)


ANY = _any(PATTERNS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def keyed_number(key: str, kind: str, block: Column, turn: Column, half: Column, modulus: Column) -> Column:
    """Round function: 60 bits of SHA-256 over key, kind, block, round and the other half."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), block.cast("string"), turn.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, block: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (left_size, right_size); each round adds to one half."""

    def turn(pair, i):
        on_left = F.pmod(pair["l"] + keyed_number(key, kind, block, i, pair["r"], left_size), left_size)
        on_right = F.pmod(pair["r"] + keyed_number(key, kind, block, i, pair["l"], right_size), right_size)
        even = i % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise(on_right).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _number(symbols: Column) -> Column:
    return F.aggregate(symbols, F.lit(0).cast("long"), lambda n, s: n * s["r"] + s["v"])


def _size(symbols: Column) -> Column:
    return F.aggregate(symbols, F.lit(1).cast("long"), lambda n, s: n * s["r"])


def _values(number: Column, symbols: Column) -> Column:
    """``number`` written in the radices of ``symbols``, most significant first."""
    start = F.struct(number.alias("n"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        F.reverse(symbols),
        start,
        lambda a, s: F.struct(
            F.call_function("div", a["n"], s["r"]).alias("n"),
            F.concat(F.array(F.pmod(a["n"], s["r"])), a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )


def permute(symbols: Column, key: str, kind: str) -> Column:
    """array<bigint>: the values of ``symbols`` (structs v, r) under the keyed permutation, in blocks of near-equal size."""
    n = F.size(symbols)
    blocks = F.call_function("div", n + BLOCK - 1, F.lit(BLOCK)).cast("int")

    def one(b):
        first = F.call_function("div", n * b, blocks).cast("int")
        stop = F.call_function("div", n * (b + 1), blocks).cast("int")

        def halves(block):
            middle = F.call_function("div", F.size(block) + 1, F.lit(2)).cast("int")
            left = F.slice(block, F.lit(1), middle)
            right = F.slice(block, middle + 1, F.size(block) - middle)
            mixed = feistel(_number(left), _number(right), _size(left), _size(right), key, kind, b)
            return let(mixed, lambda m: F.concat(_values(m["l"], left), _values(m["r"], right)))

        return let(F.slice(symbols, first + 1, stop - first), halves)

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), one))).otherwise(F.array().cast("array<bigint>"))


def symbol(value: Column, radix: Column | int) -> Column:
    """One symbol: its value and its radix."""
    return F.struct(value.cast("long").alias("v"), (F.lit(radix) if isinstance(radix, int) else radix).cast("long").alias("r"))


def chars(text: Column) -> Column:
    """The characters of ``text``; none for the empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def letters_and_digits(text: Column) -> Column:
    """Symbols of the ASCII letters (radix 26, either case) and digits (radix 10) of ``text``."""
    alnum = F.filter(chars(text), lambda c: c.rlike("[A-Za-z0-9]"))
    return F.transform(alnum, lambda c: F.when(c.rlike("[0-9]"), symbol(F.ascii(c) - 48, 10)).otherwise(symbol(F.ascii(F.lower(c)) - 97, 26)))


def fill(template: Column, values: Column) -> Column:
    """``template`` with the value of each ASCII letter and digit replaced in turn; the class and case of each stay."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(a, c):
        v = F.get(values, a["i"]).cast("int")
        new = (
            F.when(c.rlike("[0-9]"), F.char(v + 48)).when(c.rlike("[a-z]"), F.char(v + 97)).when(c.rlike("[A-Z]"), F.char(v + 65)).otherwise(c)
        )
        return F.struct((a["i"] + F.when(c.rlike("[A-Za-z0-9]"), 1).otherwise(0)).alias("i"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(chars(template), start, put, lambda a: a["out"])


def digit_values(text: Column) -> Column:
    """array<bigint> of the ASCII digits of ``text``."""
    return F.transform(F.filter(chars(text), lambda c: c.rlike("[0-9]")), lambda c: (F.ascii(c) - 48).cast("long"))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum; every second digit from the right end is doubled."""

    def weigh(d, i):
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(digits), weigh), F.lit(0).cast("long"), lambda n, d: n + d)


def mod97(text: Column) -> Column:
    """Remainder of the number that ISO 7064 reads from letters and digits."""

    def add(n, c):
        return F.when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars(text), F.lit(0).cast("int"), add)


def longest(value: Column, valid: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``value`` with its longest valid beginning changed; a beginning is the whole or ends before a gap (space or hyphen)."""
    ends = F.filter(F.sequence(F.length(value), F.lit(1), F.lit(-1)), lambda k: F.substr(value, k + 1, F.lit(1)).isin("", " ", "-"))
    starts = F.filter(F.transform(ends, lambda k: F.substr(value, F.lit(1), k)), valid)
    rest = lambda v: F.substr(value, F.length(v) + 1)
    return let(F.get(starts, F.lit(0)), lambda v: F.when(v.isNull(), value).otherwise(F.concat(change(v), rest(v))))


def card(value: Column, key: str) -> Column:
    """Luhn-valid numbers, alone or before more digits: the first digit, or four of a 2, stay and the check digit is made anew."""

    def valid(text):
        return let(digit_values(text), lambda d: F.size(d).between(13, 19) & (luhn_sum(d) % 10 == 0))

    def change(text):
        return let(digit_values(text), lambda digits: _card(text, digits, key))

    return longest(value, valid, change)


def _card(value: Column, digits: Column, key: str) -> Column:
    brand = F.when(digits[0] == 2, 4).otherwise(1)
    payload = F.transform(F.slice(digits, brand + 1, F.size(digits) - 1 - brand), lambda d: symbol(d, 10))

    def close(mixed):
        head = F.concat(F.slice(digits, F.lit(1), brand), mixed)
        check = F.pmod(-luhn_sum(F.concat(head, F.array(F.lit(0).cast("long")))), F.lit(10)).cast("long")
        return fill(value, F.concat(head, F.array(check)))

    return let(permute(payload, key, "card"), close)


def iban(value: Column, key: str) -> Column:
    """IBANs whose check digits hold, alone or before more groups: the country stays, the check digits are made anew."""

    def valid(text):
        packed = F.replace(text, F.lit(" "), F.lit(""))
        return F.length(packed).between(15, 34) & (mod97(F.concat(F.substring(packed, 5, 40), F.substring(packed, 1, 4))) == 1)

    return longest(value, valid, lambda text: _iban(text, key))


def _iban(value: Column, key: str) -> Column:
    packed = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(packed, 1, 2), F.substring(packed, 5, 40)

    def close(mixed):
        plain = fill(account, mixed)
        check = F.lit(98) - mod97(F.concat(plain, country, F.lit("00")))
        new = F.concat(country, F.lpad(check.cast("string"), 2, "0"), plain)
        codes = F.transform(chars(new), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 65).cast("long"))
        return fill(value, codes)

    return let(permute(letters_and_digits(account), key, "iban"), close)


def date(value: Column, key: str) -> Column:
    """Calendar dates from 1900 to 2099; the layout stays: year first, month first if the second number is above 12, else day first."""
    year_first = value.rlike("^[0-9]{4}")
    month_first = ~year_first & (F.substring(value, 4, 2) > "12")

    def number(first, length, second, american):
        last = F.when(month_first, F.substring(value, american, length)).otherwise(F.substring(value, second, length))
        return F.when(year_first, F.substring(value, first, length)).otherwise(last).cast("int")

    year, month, day = number(1, 4, 7, 7), number(6, 2, 4, 1), number(9, 2, 1, 4)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    left, right = DATE_RADICES

    def close(days):
        mixed = feistel(F.call_function("div", days, F.lit(right)), days % right, F.lit(left), F.lit(right), key, "date", F.lit(0))
        moved = let(mixed, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (m["l"] * right + m["r"]).cast("int")))
        layout = lambda d: F.when(year_first, F.date_format(d, "yyyyMMdd")).when(month_first, F.date_format(d, "MMddyyyy")).otherwise(F.date_format(d, "ddMMyyyy"))
        return let(moved, lambda d: fill(value, digit_values(layout(d))))

    valid = day <= last
    return F.when(valid, let(F.datediff(F.make_date(year, month, F.least(day, last)), F.lit(FIRST_DAY).cast("date")), close)).otherwise(value)


def ssn(value: Column, key: str) -> Column:
    """Social security numbers: areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area = F.substring(value, 1, 3).cast("int")
    at = area - 1 - F.when(area > 666, 1).otherwise(0)
    symbols = F.array(
        symbol(at, 898), symbol(F.substring(value, 5, 2).cast("int") - 1, 99), symbol(F.substring(value, 8, 4).cast("int") - 1, 9999)
    )

    def close(mixed):
        new = mixed[0] + 1 + F.when(mixed[0] >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", new, mixed[1] + 1, mixed[2] + 1)

    return let(permute(symbols, key, "ssn"), close)


def phone(value: Column, key: str) -> Column:
    """North American numbers keep +1 and valid area and exchange codes; others keep two digits after the plus sign."""

    def change(digits):
        n = F.size(digits)
        american = ((n == 10) & ~value.startswith("+")) | ((n == 11) & value.rlike("^[+]1[^0-9]*[2-9][0-9]{2}[^0-9]*[2-9]"))
        kept = F.when(american, n - 10).otherwise(2)
        own = F.slice(digits, kept + 1, n - kept)
        symbols = F.transform(
            own, lambda d, i: F.when(american & i.isin(0, 3), symbol(d - 2, 8)).otherwise(symbol(d, 10))
        )

        def close(mixed):
            new = F.transform(mixed, lambda v, i: v + F.when(american & i.isin(0, 3), 2).otherwise(0))
            return fill(value, F.concat(F.slice(digits, F.lit(1), kept), new))

        return F.when(american | n.between(8, 15), let(permute(symbols, key, "phone"), close)).otherwise(value)

    return let(digit_values(value), change)


def ipv4(value: Column, key: str) -> Column:
    """Dotted addresses, each octet below 256."""
    octets = F.transform(F.split(value, r"\."), lambda o: symbol(o.cast("int"), 256))
    return F.array_join(F.transform(permute(octets, key, "ipv4"), lambda v: v.cast("string")), ".")


def email(value: Column, key: str) -> Column:
    """Letters and digits before the at sign; the domain and punctuation stay."""
    local = F.substring_index(value, "@", 1)
    return F.concat(fill(local, permute(letters_and_digits(local), key, "email")), F.substr(value, F.length(local) + 1))


def kind_of(value: Column) -> Column:
    """Which of ``KINDS`` the pattern found."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("^[A-Z]"), "iban")
        .when(value.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), "ipv4")
        .when(value.rlike("^([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$"), "date")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike("^[2-6]([ -]?[0-9]){12,18}$"), "card")
        .otherwise("phone")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its check stays."""
    makers = {"email": email, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "card": card}
    kind = kind_of(value)
    out = F.when(F.lit(False), value)
    for name, maker in makers.items():
        out = out.when(kind == name, maker(value, key))
    return out.otherwise(phone(value, key))


def pseudonymise(documents: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """``documents`` with the personal data in ``text`` replaced; every row and other column stays as it is.

    ``count`` names a column for how many values were changed.  A null text stays
    null, an empty one empty; texts without any candidate are passed on unread by
    the longer pattern.  The length of a text in characters does not change but
    for IPv4 addresses.
    """
    body = F.col(f"`{text}`")
    found_name, new_name = free_name(documents, "found_values"), free_name(documents, "new_values")
    found = F.when(body.rlike(MAYBE), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = documents.withColumn(found_name, found)
    new = F.transform(found_name, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    rows = rows.withColumn(new_name, F.when(F.size(found_name) > 0, new))
    between = F.split(body, ANY, -1)
    pieces = F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col(new_name), i)["new"], F.lit(""))))
    rows = rows.withColumn(text, F.when(F.size(found_name) > 0, F.array_join(pieces, "")).otherwise(body))
    if count:
        changed = F.size(F.filter(new_name, lambda c: c["old"] != c["new"])).cast("long")
        rows = rows.withColumn(count, F.coalesce(F.when(F.size(found_name) > 0, changed), F.lit(0).cast("long")))
    return rows.drop(found_name, new_name)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms: doc_id, text, n_changed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, count="n_changed")
