"""Format-preserving pseudonyms for personal data: values are found, validated and put through a keyed Feistel
permutation of their own format, so that equal values stay equal across documents and every format stays valid.

Card numbers keep their first digit and a right check digit, account numbers their country and check digits, phone
numbers their country code and layout, network addresses their layout. A date becomes a real day that is written in
the same layout and read in the same order, by cycle walking, so it comes back too. Ten-digit
numbers outside the American numbering plan become others outside of it. A card that stands next to other numbers is
found among the spans of whole digit groups. Whoever has the key can undo each permutation; without it a pseudonym
tells the format alone. To undo a whole text can misread a card that another replaced number follows directly.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import string

from pyspark.sql import DataFrame

from . import common

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# English month names.
MONTHS = "January February March April May June July August September October November December".split()
_SHORT = [m[:3] for m in MONTHS]
_MONTH = "|".join(dict.fromkeys([*MONTHS, *_SHORT]))
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_\-]{6,}))"
    r"|(?P<iban>\b(?:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:[ ]?[a-z0-9]{4}){2,7}(?:[ ]?[a-z0-9]{1,3})?)\b)"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iso>(?<![\w-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?:(?![\w-])|(?=T\d{2}(?!\d))))"
    r"|(?P<day>(?<![\w./-])(?:\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}|\d{1,2}/\d{1,2}/\d{2})(?![\w/-]))"
    rf"|(?P<named>(?<![\w./-])(?:(?i:\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})\.?,?\s+\d{{4}})|(?i:(?:{_MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}))(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){11,18}(?![\w-]))"
    r"|(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b)"
)
#: Without any of these characters or words a text can't hold a value.
_MAYBE = re.compile(r"[0-9@]|AKIA|ASIA|[=:]")
#: Digits in groups, and one group.
_RUN = re.compile(r"\d(?:[ -]?\d)*")
_GROUP = re.compile(r"\d+")


def _round(key: bytes, tweak: bytes, i: int, value: int) -> int:
    size = max(1, (value.bit_length() + 7) // 8)
    return int.from_bytes(hashlib.blake2b(tweak + bytes([i]) + value.to_bytes(size, "big"), key=key[:64], digest_size=16).digest(), "big")


def _feistel(key: bytes, tweak: bytes, x: int, a: int, b: int, back: bool = False) -> int:
    """Permutation of 0 .. a*b - 1: halves of radix a and b take turns in being shifted by a keyed function of the other."""
    left, right = divmod(x, b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            left = (left + sign * _round(key, tweak, i, right)) % a
        else:
            right = (right + sign * _round(key, tweak, i, left)) % b
    return left * b + right


def permuted(key: bytes, tweak: str, x: int, size: int, valid=lambda y: True, back: bool = False) -> int:
    """Keyed permutation of those of 0 .. size - 1 that are valid, of which x must be one; steps on until it meets a valid one."""
    a = max(1, int(size**0.5))
    b = -(-size // a)
    t = f"{tweak}:{size}:".encode()
    y = x
    while True:
        y = _feistel(key, t, y, a, b, back)
        if y < size and valid(y):
            return y


def permuted_text(key: bytes, tweak: str, text: str, back: bool = False) -> str:
    """Permutes the digits, the small and the capital letters of a text, each kind in the places that it has."""
    out = list(text)
    for kind, letters in (("0", string.digits), ("a", string.ascii_lowercase), ("A", string.ascii_uppercase)):
        places = [i for i, c in enumerate(text) if c in letters]
        if not places:
            continue
        value = 0
        for i in places:
            value = value * len(letters) + letters.index(text[i])
        value = permuted(key, f"{tweak}{kind}", value, len(letters) ** len(places), back=back)
        for i in reversed(places):
            value, r = divmod(value, len(letters))
            out[i] = letters[r]
    return "".join(out)


def _laid(layout: str, digits: str) -> str:
    """digits in the places of a layout's digits."""
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in layout)


def luhn_digit(body: str) -> str:
    """The check digit after body."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _is_card(text: str) -> bool:
    d = re.sub(r"\D", "", text)
    return 13 <= len(d) <= 19 and d[0] != "0" and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def _card(key: bytes, text: str, back: bool, valid=lambda new: True) -> str | None:
    """valid: tells of a text whether it may be the pseudonym; text has to be valid itself."""
    if not _is_card(text):
        return None
    d = re.sub(r"\D", "", text)
    n = len(d) - 2

    def laid(x: int) -> str:
        body = d[0] + str(x).zfill(n)
        return _laid(text, body + luhn_digit(body))

    return laid(permuted(key, "card", int(d[1:-1]), 10**n, lambda x: valid(laid(x)), back))


def _card_inside(key: bytes, text: str, at: int, end: int, back: bool) -> tuple[int, int, str] | None:
    """(first, last, pseudonym) of the first card of whole digit groups that begins in text[at:end], a run that is no card as a whole.

    The card may go on beyond the run's end. The pseudonym is one with which all spans tried before are still no cards.
    """
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, at, _RUN.match(text, at, end + 40).end())]
    tried = [(at, end)]
    for i, (first, _) in enumerate(groups):
        if first >= end:
            break
        for _, last in reversed(groups[i:]):
            if (first, last) == (at, end) or last - first > 40 or text[last : last + 1].isalnum() or text[last : last + 1] == "_":
                continue
            if _is_card(text[first:last]):
                still = lambda new: not any(_is_card((text[:first] + new + text[last:])[a:b]) for a, b in tried if b > first)  # noqa: E731,B023
                return first, last, _card(key, text[first:last], back, still)
            tried.append((first, last))
    return None


def _iban_rest(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _iban(key: bytes, text: str, back: bool) -> str | None:
    d = text.replace(" ", "").upper()
    if not 15 <= len(d) <= 34 or _iban_rest(d[:2], d[4:]) != d[2:4]:
        return None
    bban = permuted_text(key, "iban" + d[:2], d[4:], back)
    new = iter(d[:2] + _iban_rest(d[:2], bban) + bban)
    laid = "".join(c if c == " " else next(new) for c in text)
    return laid.lower() if text[0].islower() else laid


def _ipv6(key: bytes, text: str, back: bool) -> str | None:
    """Hexadecimal digits in their places; letters are all small or all capital."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    digits = text.replace(":", "")
    if len([g for g in text.split(":") if g]) < 3 or any(c.islower() for c in digits) and any(c.isupper() for c in digits):
        return None
    capital = any(c.isupper() for c in digits)
    laid = lambda x: f"{x:0{len(digits)}X}" if capital else f"{x:0{len(digits)}x}"
    # capital letters show only where there is one, and the pattern asks for a digit
    good = lambda x: any(c.isdigit() for c in laid(x)) and (not capital or any(c.isupper() for c in laid(x)))
    new = iter(laid(permuted(key, f"ipv6{capital}", int(digits, 16), 16 ** len(digits), good, back)))
    return "".join(c if c == ":" else next(new) for c in text)


def _ipv4(key: bytes, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permuted(key, "ipv4", x, 1 << 32, back=back).to_bytes(4, "big")))


def _ssn(key: bytes, text: str, back: bool) -> str | None:
    def valid(x: int) -> bool:
        s = str(x).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    x = int(text.replace("-", ""))
    return _laid(text, str(permuted(key, "ssn", x, 10**9, valid, back)).zfill(9)) if valid(x) else None


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _read_date(text: str) -> tuple[tuple, datetime.date] | None:
    """(layout, day) of a written date; None if it is no day of FIRST_DAY to LAST_DAY.

    Three numbers, year last: month first with slashes unless it can't be one, day first with dots and hyphens unless it
    can't. Years of two digits are those from 2000 on. A layout is what a date has besides its day: the order, what stands
    between the parts, the width of each and whether it is filled with a zero, and how a month's name is written.
    """
    parts = re.findall(r"\d+|[^\W\d_]+|[\W_]+", text)
    values, where, shape = {}, [], []
    numbers = [p for p in parts if p.isdigit()]
    name = next((p for p in parts if p[:3].title() in _SHORT), None)
    if name is not None:
        order = iter(("day", "year"))
    elif len(numbers[0]) == 4:
        order = iter(("year", "month", "day"))
    else:
        month_first = int(numbers[1]) > 12 or "/" in text and int(numbers[0]) <= 12
        order = iter(("month", "day", "year") if month_first else ("day", "month", "year"))
    for p in parts:
        if p.isdigit():
            kind = next(order)
            values[kind] = int(p) + (2000 if kind == "year" and len(p) == 2 else 0)
            # among days of two places those filled with a zero and those with two digits of their own differ where another part shows that it isn't filled
            where.append((kind, len(p)))
            shape.append((kind, len(p)))
        elif p is name:
            values["month"] = _SHORT.index(p[:3].title()) + 1
            style = "full" if p.title() in MONTHS else "short"
            case = "upper" if p.isupper() else "title" if p.istitle() else "lower" if p.islower() else None
            if case is None:
                return None
            shape.append(("name", style, case))
        elif p.lower() in ("st", "nd", "rd", "th"):
            if p != _ordinal(values["day"]):
                return None
            shape.append("ordinal")
        else:
            shape.append(p)
    widths = [n for kind, n in where if kind != "year"]
    filled = tuple(values[kind] < 10 for kind, n in where if kind != "year" and n == 2) if name is not None or 1 in widths else ()
    try:
        day = datetime.date(values["year"], values["month"], values["day"])
    except ValueError:
        return None
    return ((*shape, filled), day) if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _write_date(layout: tuple, day: datetime.date) -> str:
    """A day in a layout; it may be read as another where the layout doesn't suit it."""
    out = []
    for p in layout[:-1]:
        if p == "ordinal":
            out.append(_ordinal(day.day))
        elif isinstance(p, str):
            out.append(p)
        elif p[0] == "name":
            out.append(getattr((MONTHS if p[1] == "full" else _SHORT)[day.month - 1], p[2])())
        else:
            value = getattr(day, p[0])
            out.append(str(value % 100 if p == ("year", 2) else value).zfill(p[1]))
    return "".join(out)


def _date(key: bytes, text: str, back: bool) -> str | None:
    """Permutes the days that the text's layout can show and that are read from it again in the same layout."""
    read = _read_date(text)
    if read is None:
        return None
    layout, day = read
    of = lambda x: datetime.date.fromordinal(FIRST_DAY + x)
    suits = lambda x: _read_date(_write_date(layout, of(x))) == (layout, of(x))
    if not suits(day.toordinal() - FIRST_DAY):
        return None
    new = permuted(key, f"date{layout}", day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, suits, back)
    return _write_date(layout, of(new))


def _phone(key: bytes, text: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 7 <= len(d) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})(?=\D)|\+(1|7)", text)
    keep = len(code[1] or code[2]) if code else 0
    body = d[keep:]
    if len(body) < 5:
        return None
    american = len(body) == 10 and (not code or d[:keep] == "1")
    planned = lambda x: (s := str(x).zfill(10))[0] > "1" and s[3] > "1"
    # numbers outside the numbering plan are permuted among themselves, so that each kind comes back
    good = (lambda x, of=planned(int(body)): planned(x) == of) if american else (lambda x: True)
    return _laid(text, d[:keep] + str(permuted(key, "phone", int(body), 10 ** len(body), good, back)).zfill(len(body)))


def _email(key: bytes, text: str, back: bool) -> str:
    local, _, domain = text.partition("@")
    return f"{permuted_text(key, 'email', local, back)}@{domain}"


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """A value's pseudonym, or None if it isn't a valid value of its kind. back: the value of a pseudonym."""
    if kind == "email":
        return _email(key, text, back)
    if kind == "aws":
        return text[:4] + permuted_text(key, "aws", text[4:], back)
    if kind == "hex":
        return f"{permuted(key, 'hex', int(text, 16), 16 ** len(text), back=back):0{len(text)}x}"
    if kind in ("iso", "day", "named"):
        return _date(key, text, back)
    return {"card": _card, "iban": _iban, "ipv4": _ipv4, "ipv6": _ipv6, "ssn": _ssn, "phone": _phone}[kind](key, text, back)


def pseudonymized(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms in place of values, and the number of values by kind."""
    found: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, found

    def put(m: re.Match) -> tuple[int, int, str] | None:
        """(first, last, new text) of what is replaced of a match."""
        if m["secret"] is not None:
            kind, value = "secret", m["value"]
            at = m.start("value") - m.start()
            new = m[0][:at] + permuted_text(key, "secret", value, back) + m[0][at + len(value) :]
        else:
            kind = next(k for k in ("email", "aws", "iban", "ipv6", "ipv4", "ssn", "iso", "day", "named", "phone", "card", "hex") if m[k] is not None)
            new = pseudonym(kind, m[0], key, back)
            if new is None and kind in ("phone", "iban") and (as_card := _card(key, m[0], back)) is not None:
                kind, new = "card", as_card
            if new is None:
                inside = _card_inside(key, text, m.start(), m.end(), back) if kind == "card" else None
                if inside:
                    found["card"] = found.get("card", 0) + 1
                return inside
        found[kind] = found.get(kind, 0) + 1
        return m.start(), m.end(), new

    out, at = [], 0  # a card's end may lie before or after that of its match, so the search goes on from there
    where = 0
    while m := _PATTERN.search(text, where):
        where = m.end()
        if (done := put(m)) is not None:
            first, where, new = done
            out += (text[at:first], new)
            at = where
    return "".join((*out, text[at:])), found


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_values (long) and kinds (kind:count, by kind) of every row of docs(doc_id, text, ...).

    The key is the caller's; values are linked across all tables that are treated with the same one. A null text stays null
    and an empty one empty, both with no values; texts without values stay as they are; a very long text is searched
    whole; repeated rows give repeated results; extra columns are ignored; an empty table gives no rows. Rows are
    independent, so nothing is shuffled.
    """

    def write(batches):
        import pyarrow as pa

        for b in batches:
            texts, counts, kinds = [], [], []
            for t in b.column(1).to_pylist():
                new, found = (t, {}) if t is None else pseudonymized(t, key)
                texts.append(new)
                counts.append(sum(found.values()))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(found.items())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_values", "kinds"])

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, text string, n_values long, kinds string")
