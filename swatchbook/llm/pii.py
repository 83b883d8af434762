"""Format-preserving pseudonyms for personal data, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What may be personal data, in the order in which it is looked for. Numbers
# are validated before they are replaced (see :func:`pseudonym`).
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
# Characters of an account's number by country, for those written with separators.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()
)
IBAN = (
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
    rf"|{_BY_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?:(?:[ -][A-Z0-9]{{4}}){{2,7}}(?:[ -][A-Z0-9]{{1,3}})?))(?![A-Za-z0-9])"
)
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
ISO_DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9])(?<![0-9][./-])[0-9]{1,2}(?<dot>[./-])[0-9]{1,2}\k<dot>(?:19|20)[0-9]{2}(?![0-9]|[./-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
# Without the country, by their grouping.
NATIONAL = (
    r"\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}(?<gap>[ .-])[0-9]{3}\k<gap>[0-9]{4}"
    r"|0[0-9](?<pair>[ .-])[0-9]{2}(?:\k<pair>[0-9]{2}){3}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}"
)
NATIONAL_PHONE = rf"(?<![A-Za-z0-9+])(?<![0-9][ .-])(?:{NATIONAL})(?![A-Za-z0-9]|[ .-][0-9]{{2}})"
# Four groups of four, or 4-6-5, next to whatever other numbers; else digits that stand alone with single separators.
GROUPED = r"[0-9]{4}(?<four>[ -])[0-9]{4}\k<four>[0-9]{4}\k<four>[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
CARD = (
    r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
    rf"|{GROUPED})(?![A-Za-z0-9])"
)
CANDIDATE = "|".join((EMAIL, IBAN, IP, ISO_DATE, DAY_DATE, SOCIAL, PHONE, NATIONAL_PHONE, CARD))
KINDS = ("email", "iban", "ip", "date", "social", "phone", "card")

# Days from 1900-01-01 that dates are permuted in: 270 * 271.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271
# Social security numbers: 898 areas, 99 groups, 9999 serials.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _chars(text: Column) -> Column:
    """The characters of a text; an empty array for an empty one."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1))).otherwise(
        F.array().cast("array<string>")
    )


def _number(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number of 60 bits from the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _shifted(text: Column, other: Column, key: str, kind: str, turn: Column) -> Column:
    """Each digit or letter moved within its class, by a number that depends on the other half and the place."""

    def move(c: Column, i: Column) -> Column:
        by = _number(key, F.lit(kind), turn, i, other)
        code = F.ascii(c)

        def within(first: int, size: int) -> Column:
            return F.char((F.lit(first) + F.pmod(code - first + F.pmod(by, F.lit(size)), F.lit(size))).cast("bigint"))

        return (
            F.when(c.between("0", "9"), within(48, 10))
            .when(c.between("a", "z"), within(97, 26))
            .when(c.between("A", "Z"), within(65, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), move), "")


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A Feistel permutation of the texts of one template.

    The template says which places hold a digit, a small or a capital letter;
    all other characters stay. Each round moves one half by what the other
    half gives, so the mapping can be undone and no two texts share a result.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r")
    )

    def turn(state: Column, n: Column) -> Column:
        left, right = state["l"], state["r"]
        odd = n % 2 == 1
        return F.struct(
            F.when(odd, _shifted(left, right, key, kind, n)).otherwise(left).alias("l"),
            F.when(odd, right).otherwise(_shifted(right, left, key, kind, n)).alias("r"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))
    return done


def permuted_number(number: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A Feistel permutation of the whole numbers below ``a * b``."""
    start = F.struct(F.floor(number / b).cast("bigint").alias("l"), F.pmod(number, F.lit(b)).cast("bigint").alias("r"))

    def turn(state: Column, n: Column) -> Column:
        left, right = state["l"], state["r"]
        odd = n % 2 == 1
        new_left = F.pmod(left + F.pmod(_number(key, F.lit(kind), n, right), F.lit(a)), F.lit(a)).cast("bigint")
        new_right = F.pmod(right + F.pmod(_number(key, F.lit(kind), n, left), F.lit(b)), F.lit(b)).cast("bigint")
        return F.struct(F.when(odd, new_left).otherwise(left).alias("l"), F.when(odd, right).otherwise(new_right).alias("r"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: (s["l"] * F.lit(b) + s["r"]).cast("bigint")
    )


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a text of digits, the last one counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return (total + F.when(i % 2 == 0, double).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add, lambda t: t % 10)


def mod97(text: Column) -> Column:
    """The value of a text of digits and capitals (A = 10) modulo 97."""

    def add(total: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((total * F.when(digit, 10).otherwise(100) + value) % 97).cast("int")

    return F.aggregate(_chars(text), F.lit(0), add)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: str) -> Column:
    country = F.substring(m, 1, 2)
    account = permuted_text(F.substring(m, F.lit(5), F.length(m)), key, "iban")
    bare = lambda c: F.translate(c, " -", "")
    check = F.lit(98) - mod97(F.concat(bare(account), country, F.lit("00")))
    return F.when(
        mod97(F.concat(bare(F.substring(m, F.lit(5), F.length(m))), F.substring(m, 1, 4))) == 1,
        F.concat(country, _padded(check, 2), account),
    )


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, p: t * 256 + p)
    new = permuted_number(value, 65536, 65536, key, "ip")
    octets = F.transform(
        F.array(*[F.lit(x).cast("bigint") for x in (1 << 24, 1 << 16, 1 << 8, 1)]),
        lambda unit: F.pmod(F.floor(new / unit), F.lit(256)).cast("string"),
    )
    return F.when(F.forall(parts, lambda p: p <= 255), F.array_join(octets, "."))


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    mark = F.regexp_extract(m, "[./-]", 0)
    plain = F.translate(m, "./", "--")
    day_first = F.try_to_date(plain, "d-M-yyyy")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, F.try_to_date(plain, "M-d-yyyy")))
    # Days and months keep their order, and their zeros if both are written with two digits.
    both = m.rlike("^[0-9]{2}[./-][0-9]{2}[./-]")
    new = F.date_add(
        F.lit(FIRST_DAY).cast("date"),
        permuted_number(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint"), DAYS_A, DAYS_B, key, "date").cast("int"),
    )
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
        F.replace(
            F.when(day_first.isNotNull(), F.when(both, F.date_format(new, "dd-MM-yyyy")).otherwise(F.date_format(new, "d-M-yyyy")))
            .when(both, F.date_format(new, "MM-dd-yyyy"))
            .otherwise(F.date_format(new, "M-d-yyyy")),
            F.lit("-"),
            mark,
        )
    )
    return F.when(day.isNotNull(), text)


def _social(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    value = ((F.when(area > 666, area - 2).otherwise(area - 1)) * GROUPS + group - 1) * SERIALS + serial - 1
    new = permuted_number(value, AREAS, GROUPS * SERIALS, key, "social")
    new_area = F.floor(new / (GROUPS * SERIALS)) + 1
    rest = F.pmod(new, F.lit(GROUPS * SERIALS))
    text = F.concat_ws(
        "-",
        _padded(F.when(new_area >= 666, new_area + 1).otherwise(new_area), 3),
        _padded(F.floor(rest / SERIALS) + 1, 2),
        _padded(F.pmod(rest, F.lit(SERIALS)) + 1, 4),
    )
    return F.when(valid, text)


def _phone(m: Column, key: str) -> Column:
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.when(digits.between(8, 15), F.concat(country, permuted_text(rest, key, "phone")))


def _card(m: Column, key: str) -> Column:
    """The whole number, or the usual groups of a card within it."""

    def made(card: Column) -> Column:
        body = permuted_text(F.substring(card, F.lit(1), F.length(card) - 1), key, "card")
        check = F.pmod(-luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))), F.lit(10))
        return F.when(luhn(F.regexp_replace(card, "[^0-9]", "")) == 0, F.concat(body, check.cast("string")))

    def within(total: Column, card: Column) -> Column:
        return F.coalesce(total, F.replace(m, card, made(card)))

    # Groups that overlap are all looked at; as a rule there are none.
    groups = F.regexp_extract_all(m, F.lit(rf"(?<![0-9])(?=({GROUPED})(?![0-9]))"), F.lit(1))
    return F.coalesce(made(m), F.aggregate(groups, F.lit(None).cast("string"), within))


def _kind(m: Column) -> Column:
    tests = (
        ("email", EMAIL),
        ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9 -]+"),
        ("ip", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
        ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"),
        ("social", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        ("phone", rf"\+.*|{NATIONAL}"),
    )
    return reduce(lambda when, t: when.when(m.rlike(f"^(?:{t[1]})$"), F.lit(t[0])), tests[1:], F.when(m.rlike(f"^(?:{EMAIL})$"), F.lit("email"))).otherwise(F.lit("card"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The replacement of a match, or null if it is no valid value of its kind.

    Validated: octets of an address up to 255, dates of the calendar (day first, or else month first), areas,
    groups and serials of social security numbers, 8 to 15 digits of a phone
    number, check digits of bank accounts and payment cards. The replacement
    has the same format and is valid as well; equal values get equal ones
    and different values of a format different ones.
    """
    makers = (("email", _email), ("iban", _iban), ("ip", _ip), ("date", _date), ("social", _social), ("phone", _phone))
    chain = F.when(kind == "email", _email(m, key))
    for name, make in makers[1:]:
        chain = chain.when(kind == name, make(m, key))
    return chain.otherwise(_card(m, key))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_col, n_pii, n_email, n_iban, ...)``, one row per row of ``docs``.

    Every validated value in a text is replaced by its pseudonym under ``key``,
    the rest of the text stays as it is; the counts say how many values of
    each kind were replaced. A null text stays null with counts of 0, an empty
    one stays empty. Null and repeated ids, repeated rows and ties need no
    special treatment, as each row is mapped by itself; an empty table gives
    an empty one, other columns are not read. One map without a shuffle; all
    expressions run inside the JVM.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    text = F.col("_text")
    # Most texts hold nothing to look at closely.
    some = text.rlike("[0-9]|@")
    found = rows.withColumn(
        "_found", F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    made = found.withColumn(
        "_new",
        F.transform(
            "_found",
            lambda m: F.struct(m.alias("old"), _kind(m).alias("kind")),
        ),
    ).withColumn(
        "_new",
        F.transform(
            "_new", lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key).alias("new"))
        ),
    )
    pieces = F.split(text, CANDIDATE, -1)
    rebuilt = F.array_join(
        F.concat(
            F.transform(
                F.arrays_zip(F.slice(pieces, F.lit(1), F.size("_new")).alias("piece"), F.col("_new").alias("made")),
                lambda z: F.concat(z["piece"], F.coalesce(z["made"]["new"], z["made"]["old"])),
            ),
            F.slice(pieces, F.size("_new") + 1, F.lit(1)),
        ),
        "",
    )
    valid = F.transform(F.filter("_new", lambda x: x["new"].isNotNull()), lambda x: x["kind"])
    out = made.select(
        F.col("_id").alias(id_col),
        F.when(F.size("_new") > 0, rebuilt).otherwise(text).alias(text_col),
        F.coalesce(valid, F.array().cast("array<string>")).alias("_kinds"),
    )
    counts = [(F.size("_kinds") - F.size(F.array_remove("_kinds", name))).alias(f"n_{name}") for name in KINDS]
    return out.select(id_col, text_col, F.size("_kinds").alias("n_pii"), *counts)
