"""Format-preserving Feistel pseudonyms for validated numbers, dates and mail addresses; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feistel rounds (an even number).
ROUNDS = 8

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:" + "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"

# The forms that are looked for; the first that fits at a place counts.
FORMS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iso_date": r"(?<![\d.-])\d{4}[-/]\d{2}[-/]\d{2}(?![\d-])",
    "day_date": r"(?<![\d./-])\d{2}[./]\d{2}[./]\d{4}(?![\d/])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
# More groups of digits, up to one where another form begins. Possessive: Java matches it without recursion, however long.
_MORE = rf"(?:[ -](?!{'|'.join(f'(?:{p})' for p in FORMS.values())})\d+)*+"
# What an IBAN or a card number may be a part of; the parts are checked. Codes without a known length take what may belong to them.
FORMS["iban"] = rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?(?!{_IBAN})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{_IBAN})[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]){_MORE})"
FORMS["card"] = rf"(?<![\d.])(?=\d(?:[ -]?\d){{12}})\d+{_MORE}"
#: Card numbers as they are printed.
CARD = r"^[ -]?(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})$"
PATTERN = "|".join(f"(?:{FORMS[p]})" for p in ("mail", "iban", "iso_date", "day_date", "ip", "ssn", "phone", "card"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's argument is bound, a repeated expression within a lambda is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hex_int(text: Column, start: Column | int, size: int) -> Column:
    return F.conv(F.substring(text, start, size) if isinstance(start, int) else text.substr(start, F.lit(size)), 16, 10).cast("long")


def _shift(text: Column, digest: Column) -> Column:
    """Each character of text moved within its alphabet by the number that stands at its place in a hash of 128 hex digits."""

    def one(i: Column) -> Column:
        code = F.ascii(text.substr(i, F.lit(1)))
        step = _hex_int(digest, F.pmod((i - 1) * 4, F.lit(128)) + 1, 4)
        moved = lambda c, first, size: F.char(F.pmod(c - first + step, F.lit(size)) + first)
        return _let(code, lambda c: F.when(c.between(48, 57), moved(c, 48, 10)).when(c.between(97, 122), moved(c, 97, 26)).when(c.between(65, 90), moved(c, 65, 26)).otherwise(F.char(c)))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def cipher(value: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of the strings of one shape: digits stay digits, lower and upper case letters their case.

    An unbalanced Feistel network: odd rounds move the left half by a hash of the right, even rounds the right by the left.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def halves(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        return F.struct(v.substr(F.lit(1), half).alias("l"), v.substr(half + 1, F.length(v)).alias("r"))

    start = _let(value, halves)

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.when(odd, s["r"]).otherwise(s["l"])).cast("binary"), 512)
        moved = _let(digest, lambda d: _shift(F.when(odd, s["l"]).otherwise(s["r"]), d))
        return _let(moved, lambda x: F.struct(F.when(odd, x).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(x).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def cipher_number(value: Column, bits: int, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of the numbers below 2 ** bits (bits even): a Feistel network over its two halves."""
    side = 1 << bits // 2
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    start = F.struct(F.floor(value / side).cast("long").alias("l"), F.pmod(value, F.lit(side)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), s["r"].cast("string")).cast("binary"), 256)
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + _hex_int(digest, 1, 8), F.lit(side)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * side + s["r"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one undoubled."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """An IBAN's remainder: the first four characters moved to the end, letters as 10 to 35, modulo 97."""
    return _let(F.concat(text.substr(F.lit(5), F.length(text)), text.substr(F.lit(1), F.lit(4))), _mod97)


def _mod97(turned: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        c = turned.substr(i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(total * 100 + letter, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def refill(form: Column, characters: Column) -> Column:
    """form with its letters and digits replaced, in order, by characters; what stands between stays."""

    def fill(new: Column) -> Column:
        def put(s: Column, i: Column) -> Column:
            c = form.substr(i, F.lit(1))
            plain = c.rlike("[A-Za-z0-9]")
            return F.struct(F.concat(s["out"], F.when(plain, new.substr(s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + plain.cast("int")).alias("k"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        return F.aggregate(F.sequence(F.lit(1), F.length(form)), start, put, lambda s: s["out"])

    return _let(characters, fill)


def _cards(m: Column, key: str) -> Column:
    """m with the card numbers among its groups replaced: valid runs of whole groups of 13 to 19 digits, from the left.

    Runs as cards are printed (CARD) come before others, and longer ones before shorter.
    """
    plain = lambda text: F.regexp_replace(text, "[ -]", "")
    run = lambda groups, i, n: F.array_join(F.slice(groups, i, n), "")
    valid = lambda digits: F.when(digits.rlike("^[0-9]{13,19}$"), luhn_sum(digits) % 10 == 0).otherwise(False)

    def with_check(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    def new(text: Column) -> Column:
        return refill(text, _let(plain(text), lambda d: _let(cipher(d.substr(F.lit(1), F.length(d) - 1), key, "card"), with_check)))

    def scan(groups: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            # How many groups from i on are a number: as printed, or else with none in them that is printed so; or 0.
            sizes = lambda i: F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1))
            fits = lambda i: lambda n: _let(plain(run(groups, i, n)), valid)
            printed = lambda i: lambda n: F.when(run(groups, i, n).rlike(CARD), fits(i)(n)).otherwise(False)
            clear = lambda n: ~F.exists(F.sequence(i, i + n - 1), lambda k: F.exists(sizes(k), printed(k)))
            other = lambda n: F.when(fits(i)(n), clear(n)).otherwise(False)
            longest = F.coalesce(F.array_max(F.filter(sizes(i), printed(i))), F.array_max(F.filter(sizes(i), other)), F.lit(0))
            put = lambda n: F.struct(F.concat(s["out"], F.when(n > 0, new(run(groups, i, n))).otherwise(F.element_at(groups, i))).alias("out"), (i + F.greatest(n, F.lit(1))).alias("next"))
            return F.when(i < s["next"], s).otherwise(_let(longest, put))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
        return F.when(F.size(groups) > 0, F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: s["out"])).otherwise("")

    return _let(F.regexp_extract_all(m, F.lit("[ -]?[A-Za-z0-9]+"), F.lit(0)), scan)


def _iban(m: Column, key: str) -> Column:
    """The longest valid run of groups from the first on; the groups after it may be card numbers."""

    def new(text: Column) -> Column:
        def fill(plain: Column) -> Column:
            land = plain.substr(F.lit(1), F.lit(2))
            with_check = lambda body: F.concat(land, F.lpad((98 - mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)
            return refill(text, _let(cipher(plain.substr(F.lit(5), F.length(plain)), key, "iban"), with_check))

        return _let(F.replace(text, F.lit(" "), F.lit("")), fill)

    def cut(groups: Column) -> Column:
        head = lambda n: F.array_join(F.slice(groups, 1, n), "")
        valid = lambda plain: F.when(plain.rlike("^[A-Z0-9]{15,34}$"), mod97(plain) == 1).otherwise(False)
        sizes = F.sequence(F.lit(1), F.least(F.lit(9), F.size(groups)))
        longest = F.coalesce(F.array_max(F.filter(sizes, lambda n: _let(F.replace(head(n), F.lit(" "), F.lit("")), valid))), F.lit(0))
        rest = lambda n: F.array_join(F.slice(groups, n + 1, F.size(groups)), "")
        return _let(longest, lambda n: F.concat(F.when(n > 0, new(head(n))).otherwise(""), _cards(rest(n), key)))

    return _let(F.regexp_extract_all(m, F.lit("[ -]?[A-Z0-9]+"), F.lit(0)), cut)


def _ip(m: Column, key: str) -> Column:
    def new(parts: Column) -> Column:
        part = lambda i: F.element_at(parts, i).cast("long")
        number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
        valid = F.lit(True)
        for i in range(1, 5):
            valid = valid & (part(i) < 256) & (F.element_at(parts, i) == part(i).cast("string"))
        octets = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / (1 << k)), F.lit(256)).cast("string") for k in (24, 16, 8, 0)])
        return F.when(valid, _let(cipher_number(number, 32, key, "ip"), octets)).otherwise(m)

    return _let(F.split(m, r"\."), new)


def _ssn(m: Column, key: str) -> Column:
    """Permuted until it is valid again (cycle walking); the start is valid, so the walk ends in the valid numbers."""
    valid = lambda x: ~x.rlike("^(000|666|9..)") & ~x.rlike("^...00") & ~x.rlike("0000$")
    # An eighth of all numbers is invalid: 24 steps fail once in 10 ** 21.
    step = lambda s, i: F.when((i > 1) & valid(s), s).otherwise(cipher(s, key, "ssn"))
    walk = lambda plain: F.when(valid(plain), refill(m, F.aggregate(F.sequence(F.lit(1), F.lit(24)), plain, step))).otherwise(m)
    return _let(F.replace(m, F.lit("-"), F.lit("")), walk)


def _phone(m: Column, key: str) -> Column:
    """North American numbers: area and exchange begin with 2 to 9, and so does the pseudonym."""

    def new(digits: Column) -> Column:
        lead = digits.substr(F.lit(1), F.length(digits) - 10)
        return _let(F.right(digits, F.lit(10)), lambda ten: number(lead, ten))

    def number(lead: Column, ten: Column) -> Column:
        first = lambda i: ten.substr(F.lit(i), F.lit(1)).cast("long") - 2
        rest = F.concat(ten.substr(F.lit(2), F.lit(2)), ten.substr(F.lit(5), F.lit(6)))
        digit = lambda x: (x + 2).cast("long").cast("string")

        # The two leading digits are a number of 6 bits, moved by a hash of the rest, which is permuted before.
        def both(moved: Column) -> Column:
            pair = cipher_number(first(1) * 8 + first(4), 6, key, F.concat(F.lit("phone"), moved))
            return _let(pair, lambda x: F.concat(lead, digit(F.floor(x / 8)), moved.substr(F.lit(1), F.lit(2)), digit(F.pmod(x, F.lit(8))), moved.substr(F.lit(3), F.lit(6))))

        return F.when((first(1) >= 0) & (first(4) >= 0), refill(m, _let(cipher(rest, key, "phone"), both))).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), new)


def _date(m: Column, key: str, iso: bool) -> Column:
    """Valid days of the years 1600 to 2399 move within their 2 ** 16 days since 1600; all of these are days of four-digit years."""
    part = lambda a, n: m.substr(F.lit(a), F.lit(n))
    epoch = F.lit("1600-01-01").cast("date")
    if iso:
        day, order = F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2)), "yyyyMMdd"
        same, month_first = part(5, 1) == part(8, 1), None
    else:
        # 13/02/2024 can't begin with a month; with points the day comes first.
        month_first = (part(3, 1) == "/") & (part(1, 2).cast("int") <= 12)
        day = F.concat_ws("-", part(7, 4), F.when(month_first, part(1, 2)).otherwise(part(4, 2)), F.when(month_first, part(4, 2)).otherwise(part(1, 2)))
        same, order = part(3, 1) == part(6, 1), "ddMMyyyy"

    def text(new: Column) -> Column:
        plain = F.date_format(new, order)
        return plain if iso else F.when(month_first, F.date_format(new, "MMddyyyy")).otherwise(plain)

    def moved(date: Column) -> Column:
        days = F.datediff(date, epoch).cast("long")
        new = F.date_add(epoch, (F.floor(days / 65536) * 65536 + cipher_number(F.pmod(days, F.lit(65536)), 16, key, "date")).cast("int"))
        return F.when(same & (F.year(date) >= 1600) & (F.year(date) < 2400), refill(m, _let(new, text))).otherwise(m)

    return _let(day.try_cast("date"), moved)


def _mail(m: Column, key: str) -> Column:
    """The name before the @ is permuted (in lower case, so that spellings stay linked); the domain stays."""
    name = F.lower(F.substring_index(m, "@", 1))
    return _let(name, lambda n: F.concat(refill(n, cipher(F.regexp_replace(n, "[^a-z0-9]", ""), key, "mail")), F.lit("@"), F.substring_index(m, "@", -1)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; what isn't valid stays as it is."""
    is_form = lambda name: m.rlike(f"^(?:{FORMS[name]})$")
    return (
        F.when(F.contains(m, F.lit("@")), _mail(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .when(is_form("iso_date"), _date(m, key, True))
        .when(is_form("day_date"), _date(m, key, False))
        .when(is_form("ip"), _ip(m, key))
        .when(is_form("ssn"), _ssn(m, key))
        .when(is_form("phone"), _phone(m, key))
        .otherwise(_cards(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with the personal numbers in `column` replaced by pseudonyms; all columns and rows stay, in place.

    Card numbers (Luhn), IBANs (remainder 97), dates (calendar), IPv4 addresses, US social security numbers and North
    American phone numbers are checked, and permuted within the valid ones of their form under the key; separators, lengths
    and check digits fit. In mail addresses letters and digits of the name are permuted. Equal values get equal pseudonyms in
    every document, in whatever spacing; different values of a form get different ones. Invalid numbers stay. Card numbers and
    IBANs are found beside other groups of digits or capitals too (expiry date, CVV, year, currency), at the groups' borders.

    Null text stays null, empty text empty; ties don't occur; repeated rows get equal texts; an empty table stays empty. Whole
    texts are searched. Texts without a digit or @ skip the search. No shuffle.
    """
    text = F.col(f"`{column}`")
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(text, PATTERN, -1)
    new = F.array_join(F.zip_with(between, F.transform(matches, lambda m: pseudonym(m, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.withColumn(column, F.when(text.rlike("[0-9@]"), new).otherwise(text))
