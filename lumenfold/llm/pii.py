"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

One regular expression finds candidates; each is validated by its kind (card numbers by the Luhn sum, phone and social
security numbers and addresses by their ranges, dates by the calendar). A valid value becomes a vector of small
numbers, each below a radix, and a keyed Feistel network permutes the vectors: in each round one half is shifted,
element by element and modulo the radix, by a digest of the key, the round and the other half. Radices are chosen so
that every vector is a valid value of the format; so the map is a permutation of the format's values, and equal values
get equal pseudonyms in all documents. Check digits are computed anew.

Kinds: email (letters and digits of all but the last domain label), ipv4, phone (North American; any area code after +1 or in
brackets, else one from 200), card, ssn, date
(yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy; years 1800 to 2199, whose 146,097 days are 189 x 773), secret (access
keys; values of password=, token=, api_key=, secret=).

Rows: a null text stays null; an empty text stays empty; candidates that fail validation stay as they are; repeated rows
each give a row. Every other column stays. Texts are read whole, and a candidate can be of any length: matching and
permuting are linear in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

KEY_CONF = "spark.lumenfold.pii.key"
#: For the registered queries where KEY_CONF is unset, so that their results are the same each time. The operator has no
#: key of its own: with a published one, anyone could invert the permutation.
DEMONSTRATION_KEY = "lumenfold demonstration key"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"  # classes alone are repeated: Java's matcher recurses for repeated groups
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .-])|\+1[ .-]?[0-9]{3}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9.-])(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,}"
ANY = "|".join([EMAIL, SECRET, IPV4, DATE, SSN, PHONE, CARD])
#: A text without these characters has no candidate.
HINT = "[0-9@=:]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radix: Column, kind: str, key: Column) -> Column:
    """Keyed permutation of the vectors (array<int>) below `radix` (array<int>, as long). Both are computed once, so the work
    is linear in their length."""

    def rounds(x: Column) -> Column:
        start, base, half = x["v"], x["r"], x["half"]

        def turn(state: Column, r: Column) -> Column:
            left = (r % 2) == 0
            other = F.when(left, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
            digest = F.sha2(F.encode(F.concat_ws("|", key, F.lit(kind), r.cast("string"), F.size(state).cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ",")), "UTF-8"), 512)

            def move(d: Column) -> Column:
                shift = lambda i: F.conv(F.substring(d, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.transform(state, lambda v, i: F.when((i < half) == left, (v + shift(i)) % F.element_at(base, i + 1)).otherwise(v))

            return let(digest, move)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)

    return let(let(values, lambda v: F.struct(v.alias("v"), radix.alias("r"), F.floor(F.size(v) / 2).cast("int").alias("half"))), rounds)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def ints(text: Column) -> Column:
    """The digits of a string of digits, as array<int>."""
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def refill(form: Column, new: Column) -> Column:
    """form with its digits replaced, in order, by those of `new` (array<int>)."""
    seen = lambda i: F.length(digits(F.substring(form, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.element_at(new, seen(i)).cast("string")).otherwise(c)), "")


def repeated(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def luhn(values: Column, skip: int) -> Column:
    """Luhn sum of digits (array<int>); skip 0 doubles every second from the right, 1 starts with the last."""
    n = F.size(values)

    def add(v: Column, i: Column) -> Column:
        twice = ((n - 1 - i + skip) % 2) == 1
        return F.when(twice & (v > 4), v * 2 - 9).when(twice, v * 2).otherwise(v)

    return F.aggregate(F.transform(values, add), F.lit(0), lambda a, v: a + v)


def alphanumeric(text: Column, kind: str, key: Column) -> Column:
    """Letters and digits permuted, each within its class; other characters stay."""

    def permuted(chars: Column) -> Column:
        code = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(-1)
        bases = F.transform(chars, code)

        def moved(base: Column) -> Column:
            radix = F.transform(base, lambda b: F.when(b == 48, 10).when(b < 0, 1).otherwise(26))
            values = F.zip_with(chars, base, lambda c, b: F.when(b < 0, 0).otherwise(F.ascii(c) - b))
            new = feistel(values, radix, kind, key)
            return F.array_join(F.zip_with(F.arrays_zip(chars.alias("c"), base.alias("b")), new, lambda x, v: F.when(x["b"] < 0, x["c"]).otherwise(F.char(x["b"] + v))), "")

        return let(bases, moved)

    return let(F.split(text, ""), permuted)


def email(m: Column, key: Column) -> Column:
    top = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(alphanumeric(F.substring(m, F.lit(1), F.length(m) - F.length(top)), "email", key), top)


def ipv4(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    new = F.array_join(F.transform(feistel(parts, repeated(F.lit(4), 256), "ipv4", key), lambda v: v.cast("string")), ".")
    return F.when(F.forall(parts, lambda p: p < 256), new).otherwise(m)


def phone(m: Column, key: Column) -> Column:
    """Areas from 200 and areas below (taken after +1 or in brackets) are a domain each, so the form never matters."""
    own = digits(m)
    national = ints(F.substring(own, F.length(own) - 9, F.lit(10)))

    def moved(first: int, size: int, kind: str) -> Column:
        least = F.array(*[F.lit({0: first, 3: 2}.get(i, 0)) for i in range(10)])
        radix = F.array(*[F.lit({0: size, 3: 8}.get(i, 10)) for i in range(10)])
        return F.zip_with(feistel(F.zip_with(national, least, lambda v, b: v - b), radix, kind, key), least, lambda v, b: v + b)

    new = F.when(F.element_at(national, 1) > 1, moved(2, 8, "phone")).otherwise(moved(0, 2, "phone, low area"))
    code = F.when(F.length(own) > 10, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return refill(m, F.concat(code, new))


def card(m: Column, key: Column) -> Column:
    """The first digit stays; the last is the Luhn digit of the permuted ones."""

    def new(own: Column) -> Column:
        body = F.slice(own, F.lit(2), F.size(own) - 2)
        moved = F.concat(F.slice(own, 1, 1), feistel(body, repeated(F.size(own) - 2, 10), "card", key))
        whole = let(moved, lambda v: F.concat(v, F.array(((10 - luhn(v, 1) % 10) % 10).cast("int"))))
        return F.when(luhn(own, 0) % 10 == 0, refill(m, whole)).otherwise(m)

    return let(ints(digits(m)), new)


def ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)

    def text(v: Column) -> Column:
        a = F.element_at(v, 1)
        return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.element_at(v, 2) + 1).cast("string"), 2, "0"), F.lpad((F.element_at(v, 3) + 1).cast("string"), 4, "0"))

    return F.when(valid, let(moved, text)).otherwise(m)


def date(m: Column, key: Column) -> Column:
    """The day's number in the 400 years, as a vector below (189, 773)."""
    form = F.when(m.rlike("^....-"), "yyyy-MM-dd").when(m.rlike("^..../"), "yyyy/MM/dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    day = F.try_to_timestamp(m, form).cast("date")
    first = F.lit("1800-01-01").cast("date")
    number = F.datediff(day, first)
    moved = feistel(F.array(F.floor(number / 773).cast("int"), number % 773), F.array(F.lit(189), F.lit(773)), "date", key)

    def text(v: Column) -> Column:
        new = F.date_add(first, F.element_at(v, 1) * 773 + F.element_at(v, 2))
        return F.when(m.rlike("^....-"), F.date_format(new, "yyyy-MM-dd")).when(m.rlike("^..../"), F.date_format(new, "yyyy/MM/dd")).when(m.contains("."), F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))

    return F.when((number >= 0) & (number < 146097), let(moved, text)).otherwise(m)


def secret(m: Column, key: Column) -> Column:
    """What follows the marker is permuted."""
    head = F.regexp_extract(m, r"^(?:AKIA|(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?)", 0)
    return F.concat(head, alphanumeric(F.substring(m, F.length(head) + 1, F.length(m)), "secret", key))


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.rlike(r"^[^=:\"'\s]+@"), "email").when(whole(SECRET), "secret").when(whole(IPV4), "ipv4").when(whole(DATE), "date").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card")


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate; itself where it fails validation."""

    def choose(kind: Column) -> Column:
        out = F.when(kind == "email", email(m, key))
        for name, fn in (("secret", secret), ("ipv4", ipv4), ("date", date), ("ssn", ssn), ("phone", phone)):
            out = out.when(kind == name, fn(m, key))
        return out.otherwise(card(m, key))

    return let(kind_of(m), choose)


def key_of(spark: SparkSession, fallback: str | None = None) -> str:
    key = spark.conf.get(KEY_CONF, fallback)
    if not key:
        raise ValueError(f"set {KEY_CONF} or pass a key")
    return key


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, report: str | None = None) -> DataFrame:
    """docs with text_col pseudonymised under `key`, or the session's (KEY_CONF); `report` names an array column of (kind,
    pseudonym) of the replaced values. Every row stays, and every other column.

    A map over rows: no shuffle. The text is split at the candidates, and joined again with their pseudonyms.
    """
    spark = docs.sparkSession
    secret_key = F.lit(key_of(spark) if key is None else key)
    names = {c.lower() for c in docs.columns}
    new = next(n for k in range(len(names) + 1) if (n := f"_new{k or ''}") not in names)
    text = F.col(f"`{text_col}`")
    pattern = F.lit(ANY)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, 0)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(new, F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, secret_key).alias("new"))))
    between = F.split(text, ANY, -1)
    ends = F.concat(F.transform(new, lambda p: p["new"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, ends, lambda a, b: F.concat(a, b)), "")
    changed = F.filter(new, lambda p: p["old"] != p["new"])
    if report:
        out = out.withColumn(report, F.transform(changed, lambda p: F.struct(kind_of(p["old"]).alias("kind"), p["new"].alias("pseudonym"))))
    return out.withColumn(text_col, F.when(F.size(changed) > 0, joined).otherwise(text)).drop(new)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key=key_of(spark, DEMONSTRATION_KEY), report="replaced")
    return out.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), F.to_json("replaced").alias("replaced"))
