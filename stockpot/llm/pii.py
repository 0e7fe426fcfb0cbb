"""Format-preserving pseudonyms for personal data, with built-in functions only.

Validated numbers (payment cards, IBANs, IPv4 addresses, social security numbers,
phone numbers), dates and e-mail names are permuted by keyed Feistel networks inside
their own format: a card stays a card with a right check digit, a date stays a date. The
permutation depends on the key and the value alone, so equal values stay linked across
documents, however they are grouped or (e-mail names) cased, and different values of a
kind and shape never meet. IPv6 addresses are not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")
#: IBAN lengths by country (ISO 13616).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ22 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 "
    "ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
#: Fixed value: country calling codes (E.164); all others have three digits.
_CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    shapes = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{shapes})(?![A-Za-z0-9])"


#: What the text is first cut by: an e-mail address, an IBAN of its country's length, a run of digit groups
#: with up to three separators between them. No group of a run starts a word or an e-mail name.
_EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IBAN = _iban_pattern()
_GROUP = "[0-9]++(?![A-SU-Za-z]|T(?![0-9])|[A-Za-z0-9._%+-]{0,64}+@)"
_RUN = f"(?:[./-]|(?<![0-9A-Za-z./-]))(?=[0-9+(][0-9\\x20.()/+-]{{6}})(?:\\(|\\+\\(?+)?+{_GROUP}(?:[\\x20.()/+-]{{1,3}}+{_GROUP})*+"
ANY = f"{_EMAIL}|{_IBAN}|{_RUN}"
#: Groups, opening signs and other separators of a run: every value is a row of whole pieces.
_PIECE = "[0-9A-Za-z]++|[+(]|[^0-9A-Za-z+(]++"
#: Pieces and characters that the longest value may take.
_PIECES, _REACH = 48, 80
#: Readings at a place of a run, the character before it first; they end where a group ends.
_READINGS = {
    "date": "^(?:[^-][0-9]{4}-[0-9]{2}-[0-9]{2}(?!-?[0-9])|[^./-](?:[0-9]{1,2}\\.[0-9]{1,2}\\.|[0-9]{1,2}/[0-9]{1,2}/)[0-9]{4}(?![./-]?[0-9]))",
    "ssn": "^[^-][0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "ip": "^[^.][0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?!\\.?[0-9])",
}
_CARD_START = "^[^+][0-9](?:[\\x20-]?[0-9]){12}"
#: Numbers of digits in the order in which they are tried: a security code after a card is commoner than a longer card.
_DIGITS = (16, 15, 19, 18, 17, 14, 13)
_CARDS = tuple(f"^.[0-9](?:[\\x20-]?[0-9]){{{n - 1}}}(?![0-9])" for n in _DIGITS)
_PHONES = (
    "^.\\+1[\\x20.-]{0,2}\\(?[0-9]{3}\\)?[\\x20.-]{0,2}[0-9]{3}[\\x20.-]?[0-9]{4}(?![0-9])",
    *[f"^.\\+[2-9](?:[\\x20.()/-]{{0,3}}[0-9]){{{n - 1}}}(?![0-9])" for n in range(15, 8, -1)],
    "^[^+(](?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9])",
)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def permute_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0..a*b-1: halves in Z_a and Z_b, each round adding a digest of the other."""
    half = lambda value, r: F.conv(F.substring(_digest(F.lit(key), F.lit(kind), r.cast("string"), value.cast("string")), 1, 13), 16, 10).cast("bigint")
    start = F.struct(((x - F.pmod(x, F.lit(b))) / b).cast("bigint").alias("a"), F.pmod(x, F.lit(b)).cast("bigint").alias("b"))

    def step(s: Column, r: Column) -> Column:
        return _let((s["a"] + half(s["b"], r)) % a, lambda left: F.struct(left.alias("a"), ((s["b"] + half(left, r + ROUNDS)) % b).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * b + s["b"])


def permute_text(x: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape (up to 64 characters): digits stay
    digits, letters stay letters of their case, other characters stay themselves."""

    def shift(value: Column, other: Column, r: Column) -> Column:
        def over(stream: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                step = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
                moved = lambda low, n: F.char(F.lit(low) + (F.ascii(c) - low + step) % n)
                return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("A", "Z"), moved(65, 26)).when(c.between("a", "z"), moved(97, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(value, ""), char), "")

        return F.when(F.length(value) == 0, value).otherwise(_let(_digest(F.lit(key), F.lit(kind), r.cast("string"), other), over))

    half = (F.length(x) / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        return _let(shift(s["a"], s["b"], r), lambda left: F.struct(left.alias("a"), shift(s["b"], left, r + ROUNDS).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _strip(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _fill(shape: Column, chars: Column) -> Column:
    """`shape` with its letters and digits replaced in turn by `chars`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    fits = lambda c: F.rlike(c, F.lit("[0-9A-Za-z]"))
    step = lambda a, c: F.struct(F.concat(a["s"], F.when(fits(c), F.substring(chars, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + F.when(fits(c), 1).otherwise(0)).alias("i"))
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["s"])


def _luhn(digits: Column) -> Column:
    """The check digit that completes `digits`."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, d: a + d)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(chars: Column) -> Column:
    """The remainder by 97 of a string whose letters stand for 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(chars, ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    return _let(_strip(m), lambda d: _let(permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda new: _fill(m, F.concat(new, _luhn(new)))))


def _iban(m: Column, key: str) -> Column:
    country = F.substring(m, 1, 2)
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    return _let(_strip(m), lambda d: _let(permute_text(F.substring(d, F.lit(5), F.length(d)), key, "iban"), lambda b: _fill(m, F.concat(country, check(b), b))))


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, "\\."), F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.cast("bigint"))
    octet = lambda n, s: (F.shiftright(n, s) % 256).cast("string")
    return _let(permute_number(value, 1 << 16, 1 << 16, key, "ip"), lambda n: F.concat_ws(".", *[octet(n, s) for s in (24, 16, 8, 0)]))


def _ssn(m: Column, key: str) -> Column:
    # The valid numbers, counted without gaps: areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
    part = lambda at, n: F.substring(m, at, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    index = (area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def show(n: Column) -> Column:
        serial, rest = n % 9999 + 1, ((n - n % 9999) / 9999).cast("bigint")
        group, a = rest % 99 + 1, ((rest - rest % 99) / 99).cast("bigint") + 1
        pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
        return F.concat_ws("-", pad(F.when(a > 665, a + 1).otherwise(a), 3), pad(group, 2), pad(serial, 4))

    return _let(permute_number(index, 898 * 99, 9999, key, "ssn"), show)


#: The days of one whole Gregorian cycle, 400 years, are 189 * 773.
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)


def _date_parts(m: Column) -> Column:
    """struct<y, a, b, order>: the three numbers as text, and which of the readings is a date."""
    iso = F.rlike(m, F.lit("^[0-9]{4}-"))
    p = F.split(m, "[./-]")
    y, a, b = F.when(iso, p[0]).otherwise(p[2]), F.when(iso, p[1]).otherwise(p[0]), F.when(iso, p[2]).otherwise(p[1])
    return F.struct(y.alias("y"), a.alias("a"), b.alias("b"), iso.alias("iso"))


def _valid(y: Column, m: Column, d: Column) -> Column:
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= last)


def _day_first(p: Column) -> Column:
    return ~p["iso"] & _valid(p["y"], p["b"], p["a"])


def _is_date(m: Column) -> Column:
    return _let(_date_parts(m), lambda p: _valid(p["y"], p["a"], p["b"]) | _day_first(p))


def _date(m: Column, key: str) -> Column:
    def from_parts(p: Column) -> Column:
        day, month = F.when(_day_first(p), p["a"]).otherwise(p["b"]), F.when(_day_first(p), p["b"]).otherwise(p["a"])
        index = F.datediff(F.make_date(p["y"].cast("int"), month.cast("int"), day.cast("int")), F.lit(_FIRST_DAY).cast("date")).cast("bigint")
        new = permute_number(index, *_DAYS, key, "date")
        like = lambda n, old: F.when(F.length(old) == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))

        def show(t: Column) -> Column:
            d, mo = like(F.dayofmonth(t), day), like(F.month(t), month)
            sep = F.regexp_extract(m, "[./-]", 0)
            return F.when(p["iso"], F.concat_ws("-", F.year(t).cast("string"), mo, d)).when(_day_first(p), F.concat(d, sep, mo, sep, F.year(t).cast("string"))).otherwise(F.concat(mo, sep, d, sep, F.year(t).cast("string")))

        return _let(F.date_add(F.lit(_FIRST_DAY).cast("date"), new.cast("int")), show)

    return _let(_date_parts(m), from_parts)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted without regard to how they are grouped, and
    a number without country code is read as one of country 1."""

    def new(digits: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(digits, f"^(?:{_CALLING})", 0)).otherwise(F.lit(""))
        return F.concat(code, permute_text(F.substring(digits, F.length(code) + 1, F.length(digits)), key, "phone"))

    return _fill(m, _let(_strip(m), new))


def _email(m: Column, key: str) -> Column:
    """The name is permuted in lower case and gets its capitals back; the domain stays."""
    name = F.substring_index(m, "@", 1)
    cased = F.zip_with(F.split(name, ""), F.split(permute_text(F.lower(name), key, "email"), ""), lambda o, n: F.when(o.between("A", "Z"), F.upper(n)).otherwise(n))
    return F.concat(F.array_join(cased, ""), F.lit("@"), F.substring_index(m, "@", -1))


def _is_iban(m: Column) -> Column:
    return _let(_strip(m), lambda d: _mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1)


def _is_card(m: Column) -> Column:
    return _let(_strip(m), lambda d: _luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1))


_VALID = {
    "date": _is_date,
    "ssn": lambda m: ~F.rlike(m, F.lit("^(000|666|9)|-00-|0000$")),
    "ip": lambda m: F.forall(F.split(m, "\\."), lambda p: p.cast("int") < 256),
}
_NEW = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _part(kind: Column, value: Column) -> Column:
    """struct<kind, value, size>: kind is an index into KINDS or -1, size the number of pieces."""
    size = F.when(kind >= 0, F.size(F.regexp_extract_all(value, F.lit(_PIECE), F.lit(0)))).otherwise(1)
    return F.struct(kind.cast("int").alias("kind"), value.alias("value"), size.alias("size"))


def _if_any(check):
    return lambda v: F.when(v == "", False).otherwise(check(v))


def _strong(around: Column, piece: Column) -> Column:
    """The date, social security number, address or card that starts at a piece; `around` is the character before it and the text from it."""
    read = lambda pattern: F.regexp_extract(around, pattern, 0)
    value = lambda found: F.substring(found, F.lit(2), F.length(found))
    cards = F.filter(F.transform(F.array(*[read(p) for p in _CARDS]), value), _if_any(_is_card))
    none = _part(F.lit(-1), piece)
    found = F.when(F.rlike(around, F.lit(_CARD_START)), _let(cards, lambda c: F.when(F.size(c) > 0, _part(F.lit(KINDS.index("card")), F.try_element_at(c, F.lit(1)))).otherwise(none))).otherwise(none)
    for k, pattern in reversed(_READINGS.items()):
        valid = _let(value(read(pattern)), _if_any(_VALID[k]))
        found = F.when(F.rlike(around, F.lit(pattern)) & valid, _part(F.lit(KINDS.index(k)), value(read(pattern)))).otherwise(found)
    return F.when(F.rlike(piece, F.lit("^[0-9]")), found).otherwise(none)


def _chosen(parts: Column) -> Column:
    """The parts that are left when each takes its pieces from left to right; in blocks, so that long runs stay cheap."""
    none = F.array().cast("array<struct<kind:int,value:string,size:int>>")

    def step(a: Column, x: Column) -> Column:
        skip = a["skip"] > 0
        return F.struct(F.when(skip, a["skip"] - 1).otherwise(x["size"] - 1).alias("skip"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"))

    def block(a: Column, i: Column) -> Column:
        done = F.aggregate(F.slice(parts, i * 64 + 1, F.lit(64)), F.struct(a["skip"].alias("skip"), none.alias("out")), step)
        return _let(done, lambda d: F.struct(d["skip"].alias("skip"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 64).cast("int"))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<array<struct<kind:int,value:string,size:int>>>").alias("out"))
    return F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"]))


def _readings(m: Column) -> Column:
    """The parts of a run, from left to right: at each group the first valid reading as a date, social
    security number, address, card (by _DIGITS) or phone number; what has none stays. A phone
    number of unknown length ends before a group at which another value starts."""

    def read(p: Column) -> Column:
        around = lambda i: F.substring(F.concat(F.coalesce(F.substring(F.try_element_at(p, F.greatest(i, F.lit(1))), -1, 1), F.lit(" ")), F.array_join(F.slice(p, i + 1, F.lit(_PIECES)), "")), 1, _REACH)
        start = lambda i: F.when(i == 0, F.concat(F.lit(" "), F.substring(F.array_join(F.slice(p, F.lit(1), F.lit(_PIECES)), ""), 1, _REACH))).otherwise(around(i))
        opens = F.transform(p, lambda x, i: F.struct(x.alias("piece"), F.when(F.rlike(x, F.lit("^[0-9+(]")), start(i)).otherwise("").alias("around")))

        def with_strong(o: Column) -> Column:
            strong = F.transform(o, lambda x: _strong(x["around"], x["piece"]))

            def phones(s: Column) -> Column:
                def at(x: Column, i: Column) -> Column:
                    around = F.try_element_at(o, i + 1)["around"]
                    read = F.transform(F.array(*[F.regexp_extract(around, q, 0) for q in _PHONES]), lambda v: _part(F.lit(KINDS.index("phone")), F.substring(v, F.lit(2), F.length(v))))
                    free = lambda v: (v["value"] != "") & ~F.exists(F.slice(s, i + 2, F.greatest(v["size"] - 1, F.lit(0))), lambda y: y["kind"] >= 0)
                    found = lambda f: F.when(F.size(f) > 0, F.try_element_at(f, F.lit(1))).otherwise(x)
                    return F.when((x["kind"] < 0) & (F.length(around) > 8), _let(F.filter(read, free), found)).otherwise(x)

                return F.transform(s, at)

            return _let(_let(strong, phones), _chosen)

        return _let(opens, with_strong)

    return _let(F.regexp_extract_all(m, F.lit(_PIECE), F.lit(0)), read)


def _parts(m: Column) -> Column:
    """The parts of a match: the whole e-mail address or IBAN, or the readings of a run; an IBAN that fails its check is read as a run."""
    whole = lambda k: F.array(_part(F.lit(KINDS.index(k)), m))
    iban = F.when(F.rlike(m, F.lit(f"^(?:{_IBAN})$")), _is_iban(m)).otherwise(F.lit(False))
    return F.when(m.contains("@"), whole("email")).when(iban, whole("iban")).otherwise(_readings(m))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in `text` and add n_<kind>, the number of values replaced, per kind.

    One narrow pass over whole texts: no shuffle, no Python. A null text stays null with
    counts of 0; readings that fail their check (Luhn, mod 97, octets, calendar) stay as
    they are; all other columns pass through; repeated rows give repeated results. An empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn("_found", F.transform(F.regexp_extract_all(column, F.lit(ANY), F.lit(0)), _parts))

    def new(p: Column) -> Column:
        out = p["value"]
        for i, k in enumerate(KINDS):
            out = F.when(p["kind"] == i, _NEW[k](p["value"], key)).otherwise(out)
        return out

    gaps = F.split(column, ANY, -1)
    rebuilt = F.concat_ws("", F.flatten(F.zip_with(gaps, F.transform("_found", lambda p: F.concat_ws("", F.transform(p, new))), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))))
    some = F.exists("_found", lambda p: F.exists(p, lambda x: x["kind"] >= 0))
    step = step.withColumn("_kinds", F.flatten(F.transform("_found", lambda p: F.transform(p, lambda x: x["kind"]))))
    counts = {f"n_{k}": _count(i) for i, k in enumerate(KINDS)}
    return step.withColumns({text: F.when(some, rebuilt).otherwise(F.col(text)), **counts}).drop("_found", "_kinds")


def _count(i: int) -> Column:
    return F.size(F.filter("_kinds", lambda x: x == i)).cast("long")


def pii_digest(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_<kind>...), one row per input row."""
    return pseudonymise(docs.select("doc_id", "text"), key)
