"""Personal data replaced by format-preserving pseudonyms, in SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common as C

ROUNDS = 10
# For trying out; a real key is kept secret and passed in.
DEMO_KEY = "not-a-secret"
# A whole cycle of the calendar, 1800-01-01 to 2199-12-31: 146,097 days, 189 times 773.
FIRST_DAY, DAYS_L, DAYS_R = "date '1800-01-01'", 189, 773

# What a match looks like; each is bounded in length or, as secrets, takes all that it has read, so that a
# scan is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[^\s"']{6,}+"""
ACCESS_KEY = r"(?<![A-Za-z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9]|[./][0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
US_PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9][.-])[0-9]{3}[.-]|(?<=\+1[ .-]?)[0-9]{3} ?)[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+1[0-9]{10}(?![0-9])"
PHONE = r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])"
KINDS = [EMAIL, SECRET, ACCESS_KEY, IBAN, ISO_DATE, DAY_DATE, IPV4, SSN, US_PHONE, PHONE, CARD]
ANY = "|".join(KINDS)


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _is(kind: str) -> str:
    """SQL: the match ``m`` is of this kind, judged by itself."""
    alone = kind.replace(r"\2", r"\1").replace(r"\3", r"\2") if kind is CARD else kind
    return f"m rlike {_quoted('^(?:' + alone + ')$')}"


def feistel(kind: str, left: str, right: str, a: str, b: str, key: str) -> str:
    """SQL: a keyed permutation of the pairs [0, a) x [0, b), as a struct (l, r).

    In turn each half is shifted by a keyed hash of the other, modulo its range.  Every round can
    be undone, so different values keep different pseudonyms and equal ones meet.
    """
    def drawn(half: str) -> str:
        text = f"concat('{key}|{kind}|', i, '|', s.{half})"
        return f"cast(conv(substr(sha2({text}, 256), 1, 15), 16, 10) as bigint)"

    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)),"
        f" (s, i) -> named_struct("
        f"'l', if(i % 2 = 1, (s.l + {drawn('r')}) % ({a}), s.l),"
        f"'r', if(i % 2 = 0, (s.r + {drawn('l')}) % ({b}), s.r)))"
    )


def string_feistel(kind: str, value: str, key: str) -> str:
    """SQL: a keyed permutation of strings of one form: digits become digits and A to Z letters.

    As ``feistel``, with each half a number of mixed radix: its characters are shifted one by one,
    modulo 10 or 26, by four digits each of a keyed hash of the other half.  At most 32 characters.
    """
    def shifted(half: str, other: str) -> str:
        char, hashed = f"substr(s.{half}, p, 1)", f"sha2(concat('{key}|{kind}|', i, '|', s.{other}), 256)"
        by = "cast(conv(substr(<hash>, 4 * p - 3, 4), 16, 10) as int)"
        each = (
            f"if({char} between '0' and '9', cast((cast({char} as int) + {by}) % 10 as string), "
            f"if({char} between 'A' and 'Z', chr(65 + (ascii({char}) - 65 + {by}) % 26), {char}))"
        )
        moved = f"array_join(transform(sequence(1, length(s.{half})), p -> {each}), '')"
        return _with({"hash": hashed}, moved)

    k = f"cast(length({value}) div 2 as int)"
    halves = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({value}, 1, {k}), 'r', substr({value}, {k} + 1)),"
        f" (s, i) -> named_struct('l', if(i % 2 = 1, {shifted('l', 'r')}, s.l), 'r', if(i % 2 = 0, {shifted('r', 'l')}, s.r)))"
    )
    return _with({"halves": halves}, "concat(<halves>.l, <halves>.r)")


def _with(values: dict[str, str], then: str) -> str:
    """SQL ``let``: ``then`` sees each value under its name, computed once."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    name = "v" + "_".join(values)
    for k in values:
        then = then.replace(f"<{k}>", f"{name}.{k}")
    return f"transform(array(named_struct({fields})), {name} -> {then})[0]"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _filled(digits: str) -> str:
    """SQL: the match with its digits replaced one by one by ``digits``."""
    nth = _digits("substr(m, 1, p)")
    return (
        "array_join(transform(sequence(1, length(m)), p -> "
        f"if(substr(m, p, 1) between '0' and '9', substr({digits}, length({nth}), 1), substr(m, p, 1))), '')"
    )


def _two(kind: str, first: str, second: str, n: str, k: str, key: str) -> str:
    """SQL: two strings of digits, of k and n - k, permuted together, as one string again."""
    a, b = f"cast(power(10, {k}) as bigint)", f"cast(power(10, {n} - {k}) as bigint)"
    return _with(
        {"f" + kind: feistel(kind, first, second, a, b, key)},
        f"concat(lpad(<f{kind}>.l, {k}, '0'), lpad(<f{kind}>.r, {n} - {k}, '0'))",
    )


def _hashed(value: str, kind: str, key: str, size: str) -> str:
    return f"substr(repeat(sha2(concat('{key}|{kind}|', {value}), 256), cast(({size}) div 64 as int) + 1), 1, {size})"


def _date(shape: str, key: str) -> str:
    day = f"to_date(m, '{shape}')"
    at = f"datediff({day}, {FIRST_DAY})"
    return _with(
        {"fdate": feistel("date", f"{at} div {DAYS_R}", f"{at} % {DAYS_R}", str(DAYS_L), str(DAYS_R), key)},
        f"date_format(date_add({FIRST_DAY}, cast(<fdate>.l * {DAYS_R} + <fdate>.r as int)), '{shape}')",
    )


def _valid_date(shape: str) -> str:
    return (
        f"try_to_timestamp(m, '{shape}') is not null and "
        f"to_date(try_to_timestamp(m, '{shape}')) between date '1800-01-01' and date '2199-12-31'"
    )


def pseudonym(key: str) -> str:
    """SQL: what the match ``m`` is replaced by; what fails its kind's check stays."""
    octet = "cast(split(m, '[.]')[{}] as bigint)"
    ip = feistel(
        "ip", f"{octet.format(0)} * 256 + {octet.format(1)}", f"{octet.format(2)} * 256 + {octet.format(3)}",
        "65536", "65536", key,
    )
    area, group, serial = "substr(m, 1, 3)", "substr(m, 5, 2)", "substr(m, 8, 4)"
    place = f"(cast({area} as int) - 1 - if({area} > '666', 1, 0))"
    ssn = _with(
        {"fssn": feistel("ssn", place, f"(cast({group} as int) - 1) * 9999 + cast({serial} as int) - 1", "898", "989901", key)},
        "concat(lpad(<fssn>.l + 1 + if(<fssn>.l >= 665, 1, 0), 3, '0'), '-', "
        "lpad(<fssn>.r div 9999 + 1, 2, '0'), '-', lpad(<fssn>.r % 9999 + 1, 4, '0'))",
    )
    d = _digits("m")
    national = f"right({d}, 10)"
    us_digits = _with(
        {"fus": feistel("us", f"cast(substr({national}, 1, 3) as int) - 200", f"cast(substr({national}, 4, 7) as int) - 2000000", "800", "8000000", key)},
        f"concat(substr({d}, 1, length({d}) - 10), <fus>.l + 200, <fus>.r + 2000000)",
    )
    us_any = f"concat(substr({d}, 1, length({d}) - 10), " + _two(
        "usany", f"substr({national}, 1, 3)", f"substr({national}, 4, 7)", "10", "3", key
    ) + ")"
    # The country's code stays, and a first digit that isn't 0 isn't 0 afterwards.
    code = f"case when {d} like '7%' then 1 when {d} rlike '^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' then 2 else 3 end"
    k = "cast(length(<nat>) div 2 as int)"
    unit, lead = f"cast(power(10, {k} - 1) as bigint)", "if(<nat> like '0%', 0, 1)"
    moved = feistel(
        "abroad", f"cast(substr(<nat>, 1, {k}) as bigint) - {lead} * {unit}", f"substr(<nat>, {k} + 1)",
        f"if(<nat> like '0%', 1, 9) * {unit}", f"cast(power(10, length(<nat>) - {k}) as bigint)", key,
    )
    moved = _with({"moved": moved}, f"concat(lpad(<moved>.l + {lead} * {unit}, {k}, '0'), lpad(<moved>.r, length(<nat>) - {k}, '0'))")
    abroad = _with({"code": code}, f"concat(substr({d}, 1, <code>), " + _with({"nat": f"substr({d}, <code> + 1)"}, moved) + ")")
    body = _two(
        "card", f"substr({d}, 2, 6)", f"substr({d}, 8, length({d}) - 8)", f"(length({d}) - 2)", "6", key
    )
    card = _with(
        {"body": f"concat(substr({d}, 1, 1), {body})"},
        "concat(<body>, filter(sequence(0, 9), c -> luhn_check(concat(<body>, c)))[0])",
    )
    plain = "replace(m, ' ', '')"

    def mod97(s: str) -> str:
        return (
            f"aggregate(split({s}, ''), 0, (r, c) -> if(c between '0' and '9', (r * 10 + cast(c as int)) % 97, "
            "if(c between 'A' and 'Z', (r * 100 + ascii(c) - 55) % 97, r)))"
        )

    # Four letters in front name the bank and stay.
    bank = f"regexp_extract({plain}, '^.{{4}}([A-Z]{{4}})', 1)"
    iban_body = _with(
        {"bank": bank}, f"concat(<bank>, {_with({'account': f'substr({plain}, 5 + length(<bank>))'}, string_feistel('iban', '<account>', key))})"
    )
    iban = _with(
        {"bban": iban_body},
        "concat(substr(m, 1, 2), lpad(98 - "
        + mod97("concat(<bban>, substr(m, 1, 2), '00')")
        + ", 2, '0'), <bban>)",
    )
    spaced = _with(
        {"iban": iban},
        "array_join(transform(sequence(1, length(m)), p -> if(substr(m, p, 1) = ' ', ' ', "
        "substr(<iban>, length(replace(substr(m, 1, p), ' ', '')), 1))), '')",
    )
    email = (
        f"concat('u', {_hashed('lower(m)', 'email', key, '16')}, '@', "
        f"'d', {_hashed(r'lower(split(m, r'+chr(39)+'@'+chr(39)+')[1])', 'domain', key, '8')}, '.example.invalid')"
    )
    head = r"""regexp_extract(m, r'^((?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*["\x27]?)', 1)"""
    secret = _with(
        {"head": head},
        "concat(<head>, " + _hashed("substr(m, length(<head>) + 1)", "secret", key, "length(m) - length(<head>)") + ")",
    )
    # A value without digits isn't a secret, but may hold what needs none.
    inside = _quoted(EMAIL + "|" + ACCESS_KEY)
    plain_value = (
        f"array_join(transform(split(m, {inside}, -1), (b, i) -> concat(b, coalesce(get(transform("
        f"regexp_extract_all(m, {inside}, 0), m -> <inside>), i), ''))), '')"
    )
    access = f"concat(substr(m, 1, 4), upper({_hashed('m', 'access', key, '16')}))"
    octets = " and ".join(f"{octet.format(i)} <= 255" for i in range(4))
    return f"""case
      when {_is(EMAIL)} then {email}
      when {_is(ACCESS_KEY)} then {access}
      when {_is(SECRET)} then if(m rlike '[0-9]', {secret}, {plain_value.replace("<inside>", f"if({_is(EMAIL)}, {email}, {access})")})
      when {_is(ISO_DATE)} then if({_valid_date('yyyy-MM-dd')}, {_date('yyyy-MM-dd', key)}, m)
      when {_is(DAY_DATE)} and m like '%/%' then
        if({_valid_date('dd/MM/yyyy')}, {_date('dd/MM/yyyy', key)}, if({_valid_date('MM/dd/yyyy')}, {_date('MM/dd/yyyy', key)}, m))
      when {_is(DAY_DATE)} then if({_valid_date('dd.MM.yyyy')}, {_date('dd.MM.yyyy', key)}, m)
      when {_is(IPV4)} then if({octets}, {_with({'fip': ip}, "concat_ws('.', <fip>.l div 256, <fip>.l % 256, <fip>.r div 256, <fip>.r % 256)")}, m)
      when {_is(SSN)} then if({area} not in ('000', '666') and {area} < '900' and {group} <> '00' and {serial} <> '0000', {ssn}, m)
      when {_is(US_PHONE)} then {_with({'usd': f"if(substr({national}, 1, 1) >= '2' and substr({national}, 4, 1) >= '2', {us_digits}, {us_any})"}, _filled('<usd>'))}
      when {_is(PHONE)} then if(length({d}) between 8 and 15, {_with({'abd': abroad}, _filled('<abd>'))}, m)
      when {_is(IBAN)} then if(length({plain}) between 15 and 34
        and {mod97(f"concat(substr({plain}, 5), substr({plain}, 1, 4))")} = 1, {spaced}, m)
      when {_is(CARD)} then if(luhn_check({d}), {_with({'cd': card}, _filled('<cd>'))}, m)
      else m end"""


def pseudonymize(df: DataFrame, text: str = "text", key: str = DEMO_KEY, count: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced, and the number of replacements in ``count``.

    Replaced are mail addresses, IPv4 addresses, card numbers (Luhn), IBANs (mod 97), social
    security and phone numbers, dates, access keys and passwords or tokens that are assigned.
    Numbers and dates go through a keyed Feistel permutation inside their format (of a phone number
    all but the country's code, of an IBAN all but the country and four letters of a bank): valid stays
    valid, separators stay, equal values stay equal in all documents and different ones different.
    Addresses and secrets have no format to permute in; they become a keyed hash.  A number that
    fails its check isn't of the kind and stays as it is, but for phone numbers outside the US plan.
    A date of form 12/25/2020 that can't be read day first is read month first.

    Null and empty texts stay.  A text of any length is scanned once.  No rows are moved: there is
    no shuffle, so no key is hot.  A column of ``df`` named as ``count`` is replaced.
    """
    c = C.col(text)
    any_, found = F.lit(ANY), "regexp_extract_all"
    between = F.split(c, ANY, -1)
    matches = F.call_function(found, c, any_, F.lit(0))
    seen = F.when(c.rlike("[@0-9]"), F.struct(between.alias("b"), matches.alias("m")))
    names = df.columns
    staged = df.select(C.packed(df), seen.alias("seen"), c.alias("text"))
    swapped = staged.select(
        "row", "seen", "text", F.expr(f"transform(seen.m, m -> {pseudonym(key.replace(chr(39), ''))})").alias("p")
    )
    joined = F.expr("array_join(transform(seen.b, (b, i) -> concat(b, coalesce(get(p, i), ''))), '')")
    new = F.when(F.size("p") > 0, joined).otherwise(F.col("text"))
    changed = F.expr("coalesce(size(filter(arrays_zip(seen.m, p), x -> x.m <> x.p)), 0)")
    out = [
        new.alias(n) if n == text else F.col("row").getField(n).alias(n)
        for n in names
        if count is None or n.lower() != count.lower()
    ]
    return swapped.select(*out, *([] if count is None else [changed.cast("long").alias(count)]))
