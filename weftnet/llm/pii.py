"""PII pseudonyms: keyed Feistel permutations inside each format, with DataFrame functions only.

What looks like personal data is found by one pattern and validated: payment
cards (13 to 19 digits, together or in groups, with a right check digit),
IPv4 addresses, telephone numbers (an exchange begins with 2 to 9; any area code),
US social security numbers and dates. The value of each is split in two halves (a modulo A, b modulo B); eight rounds of a
Feistel network with MD5 of (key, kind, round, half) permute all pairs, and the
result is written in the same format with the same separators:

* card: all digits but the last are permuted, and the last is made so that the
  check digit is right again;
* IPv4: 16 and 16 bits; telephone: three digits, then exchange (200-999) and line;
* social security: area 001-899, group and serial, none zero;
* date: YYYY-MM-DD or YYYY/MM/DD, days of the 400 years from 1800 (189 x 773).

A permutation maps equal values to equal pseudonyms and no two values to one,
so documents stay linked; with the key it can be undone (``feistel(..., undo=True)``).
E-mail addresses and hexadecimal secrets of 32, 40 or 64 characters have no such domain; they
are replaced by keyed digests in the same shape. Candidates that do not validate
stay as they are.

The text is cut at the candidates and joined again, one pass and no shuffle; a
text without candidates is passed on after the first test. Every alternative of the
pattern is bounded or begins where a run of its characters begins and gives nothing
back (possessive), so a text is searched in linear time, without recursion: megabytes
of letters, digits, dots or hyphens without a space are texts like others. Punctuation
before an address stays where it is, as do addresses whose host has no name.

Edge cases: a null text comes out as ''; ids, nulls and repeated rows pass
through; an empty table gives none; other columns are not read; the key must be
given. Candidates are taken from left to right, the longest kind first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL})++"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
)
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9A-Za-z])"
CANDIDATE = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, SSN, PHONE, CARD, SECRET))

#: The moduli (A, B) by kind.
MODULI = {
    "ip": (1 << 16, 1 << 16),
    "date": (189, 773),
    "ssn": (898, 99 * 9999),
    "phone": (1000, 800 * 10000),
}
_DAY_ZERO = "1800-01-01"


def _round(kind: Column, r: Column, half: Column, key: str) -> Column:
    """A 60-bit number from the key, the kind, the round and one half."""
    code = F.md5(F.concat_ws("|", F.lit(key), kind, r.cast("string"), half.cast("string")))
    return F.conv(F.substring(code, 1, 15), 16, 10).cast("long")


def feistel(kind: Column, a: Column, b: Column, m: Column, n: Column, key: str, undo: bool = False) -> Column:
    """(a, b) permuted in [0, m) x [0, n): even rounds change a by b, odd ones b by a."""
    order = list(range(ROUNDS))[:: -1 if undo else 1]
    sign = -1 if undo else 1

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        x = F.pmod(s["a"] + sign * (_round(kind, r, s["b"], key) % m), m)
        y = F.pmod(s["b"] + sign * (_round(kind, r, s["a"], key) % n), n)
        return F.struct(
            F.when(even, x).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(y).alias("b")
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, order)), start, step)


def _number(text: Column) -> Column:
    return text.try_cast("long")


def _luhn(digits: Column) -> Column:
    """The sum of the check-digit rule over ``digits``, the last one counted singly."""
    each = F.split(F.reverse(digits), "")
    total = lambda s, x: F.struct(
        (s["k"] + 1).alias("k"),
        (
            s["t"] + F.when(s["k"] % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        ).alias("t"),
    )
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"))
    numbers = F.transform(F.filter(each, lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(numbers, start, total)["t"]


def _same_shape(shape: Column, digits: Column) -> Column:
    """``digits`` written over the digits of ``shape``."""
    marks = F.filter(F.split(shape, ""), lambda c: c != "")
    step = lambda s, c: F.when(
        c.between("0", "9"),
        F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")),
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(marks, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def _pad(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width.cast("int"), "0")


def _card(found: Column, key: str) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    size = F.length(digits)
    left = F.floor((size - 1) / 2)
    right = size - 1 - left
    head = F.substr(digits, F.lit(1), left.cast("int")).cast("long")
    tail = F.substr(digits, (left + 1).cast("int"), right.cast("int")).cast("long")
    kind = F.concat(F.lit("card"), size.cast("string"))
    s = feistel(kind, head, tail, _power(left), _power(right), key)
    end = F.concat(_pad(s["a"], left), _pad(s["b"], right))
    last = F.pmod(-_luhn(F.concat(end, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) % 10 == 0, _same_shape(found, F.concat(end, last))).otherwise(found)


def _ip(found: Column, key: str) -> Column:
    part = lambda k: _number(F.element_at(F.split(found, "\\."), k))
    valid = F.greatest(*[part(k) for k in range(1, 5)]) <= 255
    s = feistel(F.lit("ip"), part(1) * 256 + part(2), part(3) * 256 + part(4), *map(F.lit, MODULI["ip"]), key)
    out = F.concat_ws(
        ".", *[x.cast("string") for x in (F.shiftright(s["a"], 8), s["a"] % 256, F.shiftright(s["b"], 8), s["b"] % 256)]
    )
    return F.when(valid, out).otherwise(found)


def _date(found: Column, key: str) -> Column:
    mark = F.substr(found, F.lit(5), F.lit(1))
    day = F.to_date(F.try_to_timestamp(F.translate(found, "/", "-"), F.lit("yyyy-MM-dd")))
    number = F.datediff(day, F.lit(_DAY_ZERO).cast("date"))
    m, n = MODULI["date"]
    valid = day.isNotNull() & (number >= 0) & (number < m * n)
    s = feistel(F.lit("date"), F.floor(number / n), F.pmod(number, F.lit(n)), F.lit(m), F.lit(n), key)
    out = F.date_add(F.lit(_DAY_ZERO).cast("date"), (s["a"] * n + s["b"]).cast("int")).cast("string")
    return F.when(valid, F.when(mark == "/", F.translate(out, "-", "/")).otherwise(out)).otherwise(found)


def _ssn(found: Column, key: str) -> Column:
    area, group, serial = (_number(F.element_at(F.split(found, "-"), k)) for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    s = feistel(F.lit("ssn"), place, (group - 1) * 9999 + serial - 1, *map(F.lit, MODULI["ssn"]), key)
    area_out = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
    digits = F.concat(
        _pad(area_out, F.lit(3)), _pad(F.floor(s["b"] / 9999) + 1, F.lit(2)), _pad(s["b"] % 9999 + 1, F.lit(4))
    )
    return F.when(valid, _same_shape(found, digits)).otherwise(found)


def _phone(found: Column, key: str) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    area = F.substr(digits, F.lit(1), F.lit(3)).cast("long")
    rest = F.substr(digits, F.lit(4), F.lit(7)).cast("long")
    least = 200 * 10000
    s = feistel(F.lit("phone"), area, rest - least, *map(F.lit, MODULI["phone"]), key)
    digits = F.concat(_pad(s["a"], F.lit(3)), _pad(s["b"] + least, F.lit(7)))
    return F.when(rest >= least, _same_shape(found, digits)).otherwise(found)


def _digest(kind: str, found: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), found), 256)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it does not validate."""
    is_kind = lambda pattern: found.rlike(f"^(?:{pattern})$")
    lead = F.regexp_extract(found, "^[._%+-]*+", 0)
    email = F.lower(F.regexp_replace(found, "^[._%+-]++", ""))
    named = email.rlike("^[^@].*\\.[a-z]{2}")
    mail = F.concat(
        lead,
        F.lit("u"),
        F.substring(_digest("local", F.substring_index(email, "@", 1), key), 1, 12),
        F.lit("@h"),
        F.substring(_digest("host", F.substring_index(email, "@", -1), key), 1, 8),
        F.lit(".example"),
    )
    secret = F.substr(_digest("secret", F.lower(found), key), F.lit(1), F.length(found))
    return (
        F.when(F.contains(found, F.lit("@")), F.when(named, mail).otherwise(found))
        .when(is_kind(IPV4), _ip(found, key))
        .when(is_kind(DATE), _date(found, key))
        .when(is_kind(SSN), _ssn(found, key))
        .when(is_kind(PHONE), _phone(found, key))
        .when(is_kind(CARD), _card(found, key))
        .otherwise(F.when(found == F.upper(found), F.upper(secret)).otherwise(secret))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_found, n_replaced, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    may = F.col("text").rlike("@|[0-9]{3}|[0-9]\\.[0-9]|[0-9a-fA-F]{32}")
    nothing = F.array().cast("array<string>")
    found = F.when(may, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(nothing)
    cut = read.withColumn("found", found)
    some = F.size("found") > 0
    between = F.when(some, F.split("text", CANDIDATE)).otherwise(nothing)
    masked = F.when(some, F.transform("found", lambda x: pseudonym(x, key))).otherwise(nothing)
    done = cut.withColumns({"between": between, "masked": masked})
    woven = F.concat(
        F.element_at("between", 1),
        F.array_join(
            F.zip_with("masked", F.slice("between", 2, F.greatest(F.size("masked"), F.lit(1))), lambda a, b: F.concat(a, b)), ""
        ),
    )
    changed = F.size(F.filter(F.arrays_zip("found", "masked"), lambda p: p["found"] != p["masked"]))
    return done.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        changed.cast("long").alias("n_replaced"),
        F.when(some, woven).otherwise(F.col("text")).alias("text"),
    )
