"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Card numbers (Luhn), social security numbers (ranges), IPv4 addresses (octets), dates (calendar, years 1800 to 2127) and
telephone numbers are found by pattern, validated, and permuted within their format by keyed Feistel rounds over two
halves with moduli of their own; card numbers get a fresh check digit. E-mail addresses become keyed names. The same value
under the same key gives the same pseudonym in every document. What does not validate stays as it is.

E-mail names keep 80 bits of a keyed digest, so at 10^10 addresses none are likely to share one.

Defined results: null text stays null; an empty text stays empty; rows are rewritten each, ties and repeated rows alike; other
columns of any name pass through, and ``n_chars`` follows the text where it was rewritten; an empty table gives no rows; a text
of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.tables import fresh

#: Stands in for the deployment's secret; pass your own.
DEMO_KEY = "corvane-demo-key"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IPV4 = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
DATE_ISO = r"(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])"
DATE_SLASH = r"(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = (r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)"
         r"|(?<![\w(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])")
CARD = r"(?<![\w-])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![\w-])"
ANY = f"(?:{EMAIL}|{IPV4}|{DATE_ISO}|{DATE_SLASH}|{SSN}|{PHONE}|{CARD})"
KINDS = ("email", "ip", "date", "ssn", "phone", "card")


def _prf(key: str, kind: str, i: Column, value: Column) -> Column:
    """48 keyed bits from a round and one half."""
    name = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of pairs: ``left`` below ``left_size`` and ``right`` below ``right_size``."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, (s["l"] + _prf(key, kind, i, s["r"])) % left_size).otherwise(s["l"])  # noqa: E741
        r = F.when(even, s["r"]).otherwise((s["r"] + _prf(key, kind, i, s["l"])) % right_size)
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of one to 20 digits, permuted among strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left = F.when(half > 0, F.substr(digits, F.lit(1), half).try_cast("long")).otherwise(F.lit(0).cast("long"))
    right = F.substr(digits, half + 1).try_cast("long")
    out = feistel(key, f"{kind}", left, right, size(half), size(n - half))
    pad = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise("")
    once = F.transform(F.array(out), lambda s: F.concat(pad(s["l"], half), pad(s["r"], n - half)))
    return once[0]


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, first: int) -> Column:
    """Sum of digits from the right, each second doubled; ``first`` is 0 if the last digit counts once."""
    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        d = F.when(s["k"] % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)
        return F.struct((s["t"] + d).alias("t"), (s["k"] + 1).alias("k"))

    start = F.struct(F.lit(0).alias("t"), F.lit(first).alias("k"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["t"])


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    new = _permute_digits(key, "card", body)
    full = F.transform(F.array(new), lambda b: F.concat(b, ((10 - _luhn_sum(b, 1) % 10) % 10).cast("string")))[0]
    return F.when((F.length(F.regexp_replace(d, "0", "")) > 0) & (_luhn_sum(d, 0) % 10 == 0), _fill(m, full)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0)
    rest = F.substr(m, F.length(head) + 1)
    d = _digits(rest)
    return F.when(F.length(d).between(6, 18), F.concat(head, _fill(rest, _permute_digits(key, "phone", d)))).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    once = F.transform(F.array(o), lambda v: F.struct(
        F.exists(v, lambda x: x > 255).alias("bad"),
        feistel(key, "ip", v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536), F.lit(65536)).alias("p")))[0]
    octets = F.transform(F.array(once["p"]), lambda p: F.concat_ws(
        ".", F.shiftright(p["l"], 8).cast("string"), (p["l"] % 256).cast("string"), F.shiftright(p["r"], 8).cast("string"), (p["r"] % 256).cast("string")))[0]
    return F.when(once["bad"], m).otherwise(octets)


_FIRST_DAY, _WEEKS, _SLOTS = "1800-01-01", 300, 400


def _date(key: str, m: Column) -> Column:
    slash = m.contains("/")
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    # Day first; if that is no date, month first.
    day_first = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date")
    month_first = F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).cast("date")
    found = F.when(slash, F.coalesce(day_first, month_first)).otherwise(iso)
    style = F.when(~slash, F.lit(0)).when(day_first.isNotNull(), F.lit(1)).otherwise(F.lit(2))
    days = F.datediff(found, F.lit(_FIRST_DAY).cast("date"))

    def out(s: Column) -> Column:
        p = feistel(key, "date", (s["d"] / _SLOTS).cast("long"), s["d"] % _SLOTS, F.lit(_WEEKS), F.lit(_SLOTS))
        new = F.transform(F.array(p), lambda q: F.date_add(F.lit(_FIRST_DAY).cast("date"), (q["l"] * _SLOTS + q["r"]).cast("int")))[0]
        return F.transform(F.array(new), lambda x: F.when(s["s"] == 0, F.date_format(x, "yyyy-MM-dd")).when(
            s["s"] == 1, F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "MM/dd/yyyy")))[0]

    inside = (days >= 0) & (days < _WEEKS * _SLOTS)
    changed = F.transform(F.array(F.struct(days.alias("d"), style.alias("s"))), out)[0]
    return F.when(F.coalesce(inside, F.lit(False)), changed).otherwise(m)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    p = feistel(key, "ssn", place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    new = F.transform(F.array(p), lambda q: F.concat_ws(
        "-", F.lpad((q["l"] + F.when(q["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad(((q["r"] / 9999).cast("long") + 1).cast("string"), 2, "0"), F.lpad((q["r"] % 9999 + 1).cast("string"), 4, "0")))[0]
    return F.when(valid, new).otherwise(m)


def _email(key: str, m: Column) -> Column:
    name = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(name, 1, 20), F.lit("@masked.invalid"))


def kind_of(m: Column) -> Column:
    return (F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
            .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), "date")
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(m.rlike(r"^[0-9]{13,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"), "card").otherwise("phone"))


def _pseudonym(key: str, m: Column) -> Column:
    kind = kind_of(m)
    return (F.when(kind == "email", _email(key, m)).when(kind == "ip", _ip(key, m)).when(kind == "date", _date(key, m))
            .when(kind == "ssn", _ssn(key, m)).when(kind == "card", _card(key, m)).otherwise(_phone(key, m)))


def marked(docs: DataFrame, key: str = DEMO_KEY) -> tuple[DataFrame, str, str]:
    """``docs`` with the values found and their pseudonyms, and the names of these two columns. Texts without digit and ``@`` are not searched."""
    found, new = fresh(docs.columns, "found", "new")
    text, none = F.col("text").cast("string"), F.array().cast("array<string>")
    some = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    step = docs.withColumn(found, F.coalesce(some, none))
    return step.withColumn(new, F.transform(found, lambda m: _pseudonym(key, m))), found, new


def _rewritten(found: str, new: str) -> Column:
    parts = F.split(F.col("text").cast("string"), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(F.col(new), F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    return F.when((F.size(found) == 0) | (F.col(found) == F.col(new)), F.col("text")).otherwise(joined)


def pseudonymize(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts; other columns pass through."""
    step, found, new = marked(docs, key)
    changed = (F.size(found) > 0) & (F.col(found) != F.col(new))
    step = step.withColumn("text", _rewritten(found, new))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        step = step.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return step.select(*docs.columns)


def _is(kind: str):
    return lambda k: k == kind


def report(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """One row a document: its text with pseudonyms, and how many values of each kind were replaced."""
    step, found, new = marked(docs.select("doc_id", "text"), key)
    pairs = F.filter(F.zip_with(found, new, lambda a, b: F.struct(a.alias("a"), (a != b).alias("c"))), lambda p: p["c"])
    step = step.withColumn("kinds", F.transform(pairs, lambda p: kind_of(p["a"])))
    counts = [F.size(F.filter("kinds", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return step.select("doc_id", _rewritten(found, new).alias("text"), *counts)
