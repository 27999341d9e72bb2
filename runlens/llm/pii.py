"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are replaced by the image of a
keyed permutation (a balanced Feistel network with cycle walking) of the set
of values of the same format, so equal values get equal pseudonyms in every
document, different values different ones, and the format stays:

- payment cards: 13 to 19 digits, grouped or not, with a valid Luhn check digit. All but the
  check digit are permuted, then the check digit is set again. Where digit groups stand side by
  side, the usual groupings of a card are tried first, then all of them, then every part.
- telephone numbers: a leading + and country code, an area code in parentheses, three groups 3-3-4 between equal
  dots or hyphens, or a leading 0; the digits after the country code or the 0 are permuted and all separators stay.
- US social security numbers (3-2-4) that were issued; IBANs with a valid check: digits are permuted, and the
  IBAN's check digits are set again.
- IPv4 addresses with four numbers up to 255: the 32 bits are permuted. IPv6 addresses: letters and digits are.
- calendar dates (yyyy-mm-dd, a time may follow, dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy where that is no
  mm/dd/yyyy, from 1900 to 2099, days and months of one or two digits): the day number is permuted among those
  that are written alike.
- e-mail addresses: letters and digits before the @ are permuted, each within its class.
- secrets: values that are assigned to a token, key, secret or password, and tokens with a known beginning; letters
  and digits are permuted, each within its class, hexadecimal ones among a to f.

The key comes from the caller or from the setting ``spark.runlens.pii.key``; without one, a random key holds for the
application. Whoever has it can restore the values.

Where a match is no valid value, its shorter and later parts are tried, then the other kinds, and the
search goes on after its first character. Which of several overlapping digit groups are the card can
look different once they are replaced, so restoring can miss a card that has other digit groups beside it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, slices

KEY_SETTING = "spark.runlens.pii.key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?|\(\d{3}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)"
_LOCAL_PHONE = r"(?<![\w.+-])(?:\d{3}([.-])\d{3}\1\d{4}|0\d{1,4}[ /-]\d{5,8})(?![\w-]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
_IPV6 = r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])"
_DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:?\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w-]))"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)"
_PATTERNS = {"date": _DATE, "ip": _IP, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "iban": _IBAN, "local": _LOCAL_PHONE, "ipv6": _IPV6}
_NUMBER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()).replace("\\1", "(?P=sep)").replace("([.-])", "(?P<sep>[.-])"))
#: An assignment to a name that says secret, or a token with a known beginning; its parts are what stays and what is replaced.
_SECRET = re.compile(
    r"""(?i:\b(?:\w*[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)([A-Za-z0-9+/_.-]{8,})|\b(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza)([A-Za-z0-9_-]{12,})"""
)
_HEX = re.compile(r"(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)\Z")
_EACH = {k: re.compile(p) for k, p in _PATTERNS.items()}
_MORE = re.compile(r"(?:[ -]\d+(?!\w|\.\d)){0,19}")
#: How cards are usually grouped.
_CARD_FORM = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}|\d{4}([ -])\d{6}\3\d{4,5}")
#: Letters and digits of an IBAN by country.
_IBAN_LENGTHS = {
    c: n for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for c in cs.split()
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
#: A text without any of these has nothing to replace.
_ANY = re.compile(r"[@=]|\d.?\d|\d\)|::|[\w\"']\s{0,3}:\s{0,3}\S{8}|sk-|xox|gh[po]_|AKIA|ASIA|AIza|_pat_|glpat-|_live_")


@lru_cache(maxsize=64)
def _subkey(key: str) -> bytes:
    """32 bytes that depend on all of a kind's name and key."""
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


@lru_cache(maxsize=20_000)
def permute(value: int, size: int, key: str, back: bool = False) -> int:
    """The image of ``value`` under a keyed permutation of 0 .. size - 1; ``back`` inverts it."""
    if size <= 1:
        return value
    half, own = max(1, ((size - 1).bit_length() + 1) // 2), _subkey(key)
    mask = (1 << half) - 1

    def mixed(x: int, i: int) -> int:
        h = hashlib.blake2b(f"{size}.{i}.{x}".encode(), digest_size=16, key=own).digest()
        return int.from_bytes(h, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mixed(left, i), left
            else:
                left, right = right, left ^ mixed(right, i)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _permuted_digits(digits: str, key: str, back: bool) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, back)).zfill(len(digits)) if digits else ""


def _luhn_ok(d: str) -> bool:
    return luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def _card(s: str, key: str, back: bool) -> str:
    d = re.sub(r"\D", "", s)
    if not _luhn_ok(d):
        return s
    if len(d) > 16 and s[4] in " -" and _CARD_FORM.fullmatch(s):  # 16 digits in fours are tried before these
        if _luhn_ok(d[:16]):
            return s
        while True:
            d = _permuted_digits(d[:-1], f"card{key}", back)
            d += luhn_digit(d)
            if _luhn_ok(d) and not _luhn_ok(d[:16]):
                return _refill(s, d)
    while True:  # a number of equal digits is no card, so the walk goes on
        d = _permuted_digits(d[:-1], f"card{key}", back)
        d += luhn_digit(d)
        if _luhn_ok(d):
            return _refill(s, d)


def _phone(s: str, key: str, back: bool) -> str:
    head = re.match(r"\+\d{1,3}(?=[ .(-])", s)  # without a separator all digits count as one number
    rest = s[head.end() :] if head else s
    d = re.sub(r"\D", "", rest)
    if not 7 <= len(d) <= 15:
        return s
    return (head[0] if head else "") + _refill(rest, _permuted_digits(d, f"phone{key}", back))


def _local_phone(s: str, key: str, back: bool) -> str:
    head, rest = ("0", s[1:]) if s[0] == "0" and s[3] not in ".-" else ("", s)
    d = re.sub(r"\D", "", rest)
    if head:
        return head + _refill(rest, _permuted_digits(d, f"phone{key}", back))
    # a number of ten digits that begins with 0 would be read as one with a leading 0
    return _refill(rest, _walk(d, f"phone{key}", back, lambda x: (x[0] == "0") == (d[0] == "0")))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _walk(d: str, key: str, back: bool, valid) -> str:
    """Permuted digits, again and again until they are valid: a permutation of the valid ones."""
    while True:
        d = _permuted_digits(d, key, back)
        if valid(d):
            return d


def _ssn(s: str, key: str, back: bool) -> str:
    d = s.replace("-", "")
    return _refill(s, _walk(d, f"ssn{key}", back, _ssn_ok)) if _ssn_ok(d) else s


def _ip(s: str, key: str, back: bool) -> str:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return s
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, f"ip{key}", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(s: str, key: str, back: bool) -> str:
    parts = re.split(r"[./-]", s)
    swapped = "/" in s and int(parts[0]) > 12  # no month, so the day comes first
    order = (2, 1, 0) if len(parts[0]) == 4 else (0, 1, 2) if "." in s or swapped else (1, 0, 2)  # day, month, year
    try:
        day = dt.date(*(int(parts[i]) for i in reversed(order))).toordinal()
    except ValueError:
        return s
    if not FIRST_DAY <= day <= LAST_DAY:
        return s
    widths = [len(parts[i]) for i in order[:2]]
    while True:
        day = permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, f"date{key}", back) + FIRST_DAY
        new = dt.date.fromordinal(day)
        alike = all(w == 2 or x < 10 for w, x in zip(widths, (new.day, new.month)))
        if alike and ("/" not in s or swapped == (order == (0, 1, 2) and new.day > 12)):
            for i, x, w in zip(order, (new.day, new.month, new.year), (*widths, 4)):
                parts[i] = str(x).zfill(w)
            return _refill(s, "".join(parts))


def _iban_check(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - n % 97:02d}"


def _iban(s: str, key: str, back: bool) -> str:
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
        return s
    digits = _permuted_digits(re.sub(r"\D", "", d[4:]), f"iban{key}", back)
    rest = _refill(d[4:], digits)
    it = iter(d[:2] + _iban_check(d[:2], rest) + rest)
    return "".join(" " if c == " " else next(it) for c in s)


def _parts(kind: str, s: str, more: str) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of a match, and of the digit groups ``more`` after it, that may be a value, in the order in which they are tried."""
    if kind == "card":
        size, s = len(s), s + more
        groups = [m.span() for m in re.finditer(r"\d+", s)]
        spans = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if 13 <= sum(c.isdigit() for c in s[a:b]) <= 19]
        yield from (x for x in spans if _CARD_FORM.fullmatch(s, *x))
        yield 0, size
        yield from sorted((x for x in spans if x != (0, size) and not _CARD_FORM.fullmatch(s, *x)), key=lambda x: (x[0], -x[1]))
    elif kind in ("iban", "phone"):
        ends = [m.end() for m in re.finditer(r"\w(?!\w)", s)]
        size = _IBAN_LENGTHS.get(s[:2]) if kind == "iban" else None
        yield from ((0, e) for e in sorted(ends, key=lambda e: (len(s[:e].replace(" ", "")) != size, -e)))
    else:
        yield 0, len(s)


def _ipv6(s: str, key: str, back: bool) -> str:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return s
    return _by_class(s, f"ip{key}", back, 6) if sum(c.isalnum() for c in s) >= 4 else s


def _by_class(s: str, key: str, back: bool, letters: int = 26) -> str:
    """ASCII letters and digits form one mixed-radix number, which is permuted; other characters stay."""
    bases = [10 if c.isdigit() else letters for c in s if c.isalnum()]
    value, size = 0, 1
    for c, base in zip((c for c in s if c.isalnum()), bases):
        value = value * base + (int(c) if c.isdigit() else ord(c.lower()) - 97)
        size *= base
    value = permute(value, size, key, back)
    out = []
    for c in reversed(s):
        if c.isalnum():
            value, x = divmod(value, 10 if c.isdigit() else letters)
            out.append(str(x) if c.isdigit() else chr(x + (65 if c.isupper() else 97)))
        else:
            out.append(c)
    return "".join(reversed(out))


def _secret(s: str, key: str, back: bool) -> str:
    if _HEX.match(s):
        return _by_class(s, f"secret{key}", back, 6)
    if not any(c.isalnum() for c in s):
        return s
    while True:
        s = _by_class(s, f"secret{key}", back)
        if not _HEX.match(s):
            return s


_KINDS = {"local": _local_phone, "ipv6": _ipv6, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "iban": _iban}


def _value(text: str, m: re.Match, key: str, back: bool) -> tuple[int, int, str] | None:
    """Start, end and pseudonym of the first valid value in a match, or in one of another kind from the same character."""
    for kind in (m.lastgroup, *(k for k in _EACH if k != m.lastgroup)):
        whole = m if kind == m.lastgroup else _EACH[kind].match(text, m.start())
        for a, b in _parts(kind, whole[0], _MORE.match(text, whole.end())[0]) if whole else ():
            start, end = whole.start() + a, whole.start() + b
            new = _KINDS[kind](text[start:end], key, back)
            if new != text[start:end]:
                return start, end, new
    return None


def pseudonymise(text: str, key: str, back: bool = False) -> tuple[str, int]:
    """The text with pseudonyms and the number of values replaced. ``back`` restores the values."""
    if not _ANY.search(text):
        return text, 0
    n = 0

    def numbers(part: str) -> str:
        nonlocal n
        done, at = [], 0
        m = _NUMBER.search(part)
        while m:
            found = _value(part, m, key, back)
            if found:
                start, end, new = found
                done += [part[at:start], new]
                at = end
                n += 1
            m = _NUMBER.search(part, max(at, m.start() + 1))
        return "".join(done) + part[at:]

    def plain(part: str) -> str:
        nonlocal n
        done, at = [], 0
        for m in _SECRET.finditer(part):
            start, end = m.span(m.lastindex)
            new = _secret(part[start:end], key, back)
            n += new != part[start:end]
            done += [numbers(part[at:start]), new]
            at = end
        return "".join(done) + numbers(part[at:])

    out, at = [], 0
    for m in _DOMAIN.finditer(text):
        first = m.start()
        while first > at and text[first - 1] in _LOCAL:
            first -= 1
        local = text[first : m.start()]
        if any(c.isalnum() for c in local):
            new = _by_class(local, f"mail{key}", back)
            n += new != local
            out += [plain(text[at:first]), new, m[0]]
            at = m.end()
    out.append(plain(text[at:]))
    return "".join(out), n


_own_keys: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key in spark.runlens.pii.key, else a random one for this application."""
    return spark.conf.get(KEY_SETTING, None) or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _replace_batches(batches: Iterator[pa.RecordBatch], key: str, back: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, counts = [], []
        for text in batch.column(batch.num_columns - 1):
            t = text.as_py()
            new, n = pseudonymise(t, key, back) if t else (t, 0)
            texts.append(new)
            counts.append(n)
        columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_replaced"])


def pseudonymise_documents(docs: DataFrame, key: str | None = None, text_col: str = "text", back: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text replaced, then n_replaced (int), for every row.

    Null and empty texts stay as they are with n_replaced 0. n_chars, where
    there is such a column, follows a text that changed. An input column named
    n_replaced is replaced. Repeated rows each get a row; an empty table gives
    an empty result.
    """
    if key == "":
        raise ValueError("the key is empty")
    key = key or key_of(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, "n_replaced")]
    one = docs.select(*kept, F.col(text_col).cast("string").alias(text_col))
    out = one.mapInArrow(partial(_replace_batches, key=key, back=back), extended(one.schema, n_replaced=T.IntegerType()))
    if "n_chars" in kept:
        changed = F.when(F.col("n_replaced") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*[c for c in docs.columns if c != "n_replaced"], "n_replaced")
