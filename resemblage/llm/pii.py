"""Personal data, by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, digits
that could start or join a number, and cues such as "password". At each anchor
a small parser expands left and right to the bounds of what it could be, and
validates it: an e-mail address's labels, four octets, a card's issuer and check digit, a
bank account's remainder, a phone number's groups, a key's length. What is valid
is replaced by a placeholder; all else stays, byte for byte.

Each maximal run (of joined digits, of dotted digits, of letters and digits, of an address's
characters) is expanded once, whatever anchors are in it, and a number has nineteen
digits at most, so the time is linear in the text.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import DOCUMENT_COLUMNS, pick

_DIGIT, _LETTER = frozenset(string.digits), frozenset(string.ascii_letters)
_ALNUM = _DIGIT | _LETTER
_DOTTED = _DIGIT | {"."}
_HEX = frozenset("0123456789abcdefABCDEF")
_LOCAL = _ALNUM | frozenset("._%+-")
_DOMAIN = _ALNUM | frozenset(".-")
_VALUE = _ALNUM | frozenset("_-+/.~")
_JOINS = frozenset(" -.()")
#: What precedes a secret, and what precedes a number that needs a cue to count.
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key")
NUMBER_CUES = {"phone": "phone", "tel": "phone", "mobile": "phone", "fax": "phone", "card": "card", "account": "account", "acct": "account", "ssn": "ssn"}
KINDS = ("email", "url", "ip", "card", "iban", "account", "ssn", "phone", "secret")

#: Groups of digits of a card.
_CARD = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)})
#: The numbers that issuers begin cards with (least, greatest), and how many digits such cards have.
_ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)), ("300", "305", (14, 16, 19)),
    ("36", "36", (14, 16, 19)), ("38", "39", (14, 16, 19)), ("3528", "3589", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("2200", "2204", (16, 17, 18, 19)), ("60", "60", (16,)), ("81", "82", (16,)), ("508", "508", (16,)),
    ("50", "50", (13, 14, 15, 16, 17, 18, 19)), ("56", "58", (13, 14, 15, 16, 17, 18, 19)), ("63", "63", (13, 14, 15, 16, 17, 18, 19)), ("67", "67", (13, 14, 15, 16, 17, 18, 19)),
)
#: Digits of the longest number, and characters of it with what joins its groups.
_DIGITS, _SPAN = 19, 64

#: How long each country's international accounts are.
_ACCOUNTS = {
    k[:2]: int(k[2:]) for k in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_GROUPS = re.compile("[0-9]+").findall
#: Letters of an account as the numbers that its check digits are made of.
_NUMBERS = {ord(c): str(int(c, 36)) for c in string.ascii_uppercase}

Span = tuple[int, int, str]


def _grow(t: str, a: int, b: int, left: frozenset, right: frozenset) -> tuple[int, int]:
    while a > 0 and t[a - 1] in left:
        a -= 1
    while b < len(t) and t[b] in right:
        b += 1
    return a, b


def _back(t: str, i: int, over: str) -> int:
    while i > 0 and t[i - 1] in over:
        i -= 1
    return i


def _word_before(t: str, a: int) -> bool:
    return a > 0 and (t[a - 1].isalnum() or t[a - 1] == "_")


def _word_after(t: str, b: int) -> bool:
    return b < len(t) and (t[b].isalnum() or t[b] == "_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    """Whether an issuer gives out such numbers, and the check digit is right."""
    return any(a <= digits[: len(a)] <= b and len(digits) in sizes for a, b, sizes in _ISSUERS) and luhn(digits) and len(set(digits)) > 1


def parse_email(t: str, at: int) -> Span | None:
    """From an at-sign: the local part to its left, dotted labels to its right, the last of two letters at least."""
    a, b = _grow(t, at, at + 1, _LOCAL, _DOMAIN)
    while a < at and t[a] in ".%+-":
        a += 1
    while b > at + 1 and t[b - 1] in ".-":
        b -= 1  # a full stop or hyphen that ends the sentence
    local, labels = t[a:at], t[at + 1 : b].split(".")
    # labels that follow without being part of the address, as in "a@b.example.com.Next", can't be told apart
    if not local or len(local) > 64 or local[-1] == "." or ".." in local or len(labels) < 2 or b < len(t) and t[b] == "@":
        return None
    if any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    last = labels[-1]
    return (a, b, "email") if len(last) >= 2 and all(c in _LETTER for c in last) else None


def _address_end(t: str, at: int) -> int:
    while at < len(t) and not t[at].isspace() and t[at] not in "\"'<>":
        at += 1
    return at


def parse_url(t: str, at: int, end: int | None = None) -> Span | None:
    """From "://": only an address that carries credentials (user:word@host) is personal. ``end`` is where the address's characters end, if that is known."""
    a, _ = _grow(t, at, at, _ALNUM, frozenset())
    b = _address_end(t, at + 3) if end is None else end
    slash = t.find("/", at + 3, b)
    user, sign, rest = t[at + 3 : b if slash < 0 else slash].rpartition("@")
    if a == at or not sign or ":" not in user or not rest:
        return None
    while t[b - 1] in ".,;:!?)":
        b -= 1  # what ends the sentence
    return a, b, "url"


def parse_ip(t: str, at: int) -> Span | None:
    """Around a digit and a dot: four octets, not a longer dotted number and not a version."""
    return _octets(t, *_grow(t, at, at, _DOTTED, _DOTTED))


def _octets(t: str, a: int, b: int) -> Span | None:
    """The address that a run of digits and dots is."""
    while b > a and t[b - 1] == ".":
        b -= 1
    while a < b and t[a] == ".":
        a += 1
    if b - a > 15:
        return None
    parts = t[a:b].split(".")
    if len(parts) != 4 or any(not p or len(p) > 3 or int(p) > 255 for p in parts) or _word_before(t, a) or _word_after(t, b):
        return None
    i = _back(t, a, " \t\n")
    version = t[max(0, i - 7) : i].lower() == "version" or i > 0 and t[i - 1] in "vV" and not _word_before(t, i - 1)
    return None if version else (a, b, "ip")


def _run(t: str, at: int, floor: int) -> tuple[int, int]:
    """The bounds of the longest run of digits around ``at`` that single spaces, dots, hyphens or brackets join, from ``floor`` on."""
    a = b = at
    while True:
        if a > floor and t[a - 1] in _DIGIT:
            a -= 1
        elif a > floor + 1 and t[a - 1] in " -.)" and (t[a - 2] in _DIGIT or t[a - 2] == ")"):
            a -= 1
        elif a > floor and t[a - 1] == "(":
            a -= 1
            if a > floor + 1 and t[a - 1] == " " and t[a - 2] in _DIGIT:
                a -= 1
        else:
            break
    n = len(t)
    while b < n:
        c = t[b]
        if c in _DIGIT:
            b += 1
        elif c not in _JOINS:
            break
        elif b + 1 < n and t[b + 1] in _DIGIT:
            b += 1
        elif b + 2 < n and c != "(" and t[b + 1] in "( -" and t[b + 2] in _DIGIT:
            b += 2
        else:
            break
    if a > floor and t[a - 1] == "+":
        a -= 1
    return a, b


def _cue(t: str, a: int) -> str | None:
    """The kind that a cue word just before ``a`` tells of, however many blanks are between."""
    i = _back(t, a, " :=#.\t")
    if not i or not t[i - 1].isalpha():
        return None
    for end in (" number", " no", " nr", "_number", "_no"):
        if i >= len(end) and t[i - len(end) : i].lower() == end:
            i = _back(t, i - len(end), " \t")
    before = t[max(0, i - 8) : i].lower()
    for word, kind in NUMBER_CUES.items():
        if before.endswith(word) and not _word_before(t, i - len(word)):
            return kind
    return None


def _phone(s: str, cued: bool) -> bool:
    digits = _GROUPS(s)
    n = sum(map(len, digits))
    if s[0] == "+":
        if digits[0] == "1":
            return n == 11
        return 8 <= n <= 15 and len(digits[0]) <= 15
    sizes = tuple(map(len, digits))
    if sizes in ((3, 3, 4), (1, 3, 3, 4)) and (sizes[0] == 3 or digits[0] == "1"):
        return True
    return sizes == (3, 4) and "-" in s or cued and 7 <= n <= 15


def _before(t: str, a: int) -> bool:
    """Whether a number that begins at ``a`` belongs to what is before it."""
    return _word_before(t, a) or a > 0 and t[a - 1] in "@."


def _after(t: str, b: int) -> bool:
    return _word_after(t, b) or b + 1 < len(t) and t[b] in "@"


def parse_run(t: str, a: int, b: int) -> list[Span]:
    """Of a run of digits ``a`` to ``b``: the cards, the account that a cue announces, social security and phone numbers.

    A run that could be one number is looked at as a whole first, then without the groups at its
    ends that belong to other words; then come its parts, from left to right, the longest first.
    """
    before, after = _before(t, a), _after(t, b)
    if not before and not after and b - a <= _SPAN and (found := _whole(t, a, b)):
        return [found]
    pieces = _pieces(t, a, b)
    if before and pieces and pieces[0][0] == a:
        pieces = pieces[1:]
    if after and pieces and pieces[-1][1] == b:
        pieces = pieces[:-1]
    if (before or after) and pieces and pieces[-1][1] - pieces[0][0] <= _SPAN and (found := _whole(t, pieces[0][0], pieces[-1][1])):
        return [found]
    return _parts(t, pieces)


def _pieces(t: str, a: int, b: int) -> list[tuple[int, int]]:
    """The bounds of what spaces divide in a run, each from a digit, bracket or plus to a digit."""
    out, i = [], a
    for piece in t[a:b].split(" "):
        parts = piece.split(".") if "." in piece and ("-" in piece or ")" in piece) else [piece]  # a number that a full stop joins
        for part in parts:
            head, tail = len(part) - len(part.lstrip(" -.)")), len(part.rstrip(" -.()"))
            if head < tail:
                out.append((i + head, i + tail))
            i += len(part) + 1
    return out


def _parts(t: str, pieces: list[tuple[int, int]]) -> list[Span]:
    """Cards, accounts, social security and phone numbers among neighbouring pieces, by stricter forms than a whole run's."""
    looked = [_looked(t, x, y) for x, y in pieces]
    n, out, i = len(pieces), [], 0
    near = [n] * (n + 1)  # the next piece that has more than digits
    for k in range(n - 1, -1, -1):
        near[k] = k if looked[k][2] else near[k + 1]
    while i < n:
        total, groups, marked = looked[i]
        if total > _DIGITS:
            i += 1
            continue
        x = pieces[i][0]
        cue = None if x > 1 and t[x - 1] == " " and t[x - 2] in _DIGIT else _cue(t, x)
        free, ends = cue is not None or t[x] == "+", []
        if marked or cue or total >= 7:
            ends.append(i)
        if marked or free or total == 4 or total in (1, 3) and near[i] - i <= 3:  # else no form begins so
            for j in range(i + 1, n):
                total, groups, marked = total + looked[j][0], groups + looked[j][1], marked or looked[j][2]
                if total > _DIGITS or groups > 5 and not free:
                    break
                if free or (marked and total in (7, 9, 10, 11)) or (1 < j - i < 5 and total >= 14 and tuple(looked[k][0] for k in range(i, j + 1)) in _CARD):
                    ends.append(j)
        found = next((f for j in reversed(ends) if (f := _part(t, x, pieces[j][1], cue))), None)
        i += 1
        if found:
            out.append(found)
            while i < n and pieces[i][0] < found[1]:
                i += 1
    return out


def _looked(t: str, x: int, y: int) -> tuple[int, int, bool]:
    """Of a piece how many digits and groups of them it has, and whether there is more than digits; no number has so many digits as an address, or what is longer than numbers are, counts."""
    s = t[x:y]
    if y - x <= _DIGITS and s.isdigit():
        return y - x, 1, False
    if y - x > _SPAN or "." in s and parse_ip(t, x) is not None:
        return _DIGITS + 1, 1, True
    groups = _GROUPS(s)
    return sum(map(len, groups)), len(groups), True


def _part(t: str, x: int, y: int, cue: str | None) -> Span | None:
    s = t[x:y]
    groups = _GROUPS(s)
    sizes, digits = tuple(map(len, groups)), "".join(groups)
    if not 7 <= len(digits) <= _DIGITS or _before(t, x) and t[x - 1] != "." or _after(t, y):
        return None
    plain = not any(c in s for c in "(.+")
    if plain and (len(sizes) == 1 or sizes in _CARD) and is_card(digits):
        return x, y, "card"
    if cue in ("card", "account") and 8 <= len(digits):
        return x, y, "account"
    if sizes == (3, 2, 4) and s.count("-") == 2 and groups[0] not in ("000", "666") and groups[1] != "00" or cue == "ssn" and len(digits) == 9:
        return x, y, "ssn"
    if (cue == "phone" or any(c in s for c in "+-(.")) and _phone(s, cue == "phone"):
        return x, y, "phone"
    return None


def _whole(t: str, a: int, b: int) -> Span | None:
    """What a run of digits is as a whole."""
    s = t[a:b]
    digits = "".join(c for c in s if c in _DIGIT)
    cue = _cue(t, a)
    if len(digits) > _DIGITS:
        return None
    if "(" not in s and "." not in s and s[0] != "+" and is_card(digits):
        return a, b, "card"
    if cue in ("card", "account") and 8 <= len(digits):
        return a, b, "account"
    groups = s.split("-")
    if tuple(map(len, groups)) == (3, 2, 4) and s.replace("-", "").isdigit() and groups[0] not in ("000", "666") and groups[1] != "00" or cue == "ssn" and len(digits) == 9:
        return a, b, "ssn"
    return (a, b, "phone") if _phone(s, cue == "phone") else None


def parse_code(t: str, a: int, b: int) -> Span | None:
    """Of letters and digits from ``a`` to ``b``: an international bank account, whose groups may go on after it, or a long hexadecimal key."""
    if a > 0 and (t[a - 1].isalnum() or t[a - 1] in "_@") or b < len(t) and (t[b].isalnum() or t[b] in "_@"):
        return None
    left = _ACCOUNTS.get(t[a : a + 2].upper(), 0)
    if 4 <= b - a <= left and t[a + 2] in _DIGIT and t[a + 3] in _DIGIT:
        e = a
        while left and e < len(t):
            if t[e] in _ALNUM:
                left, e = left - 1, e + 1
            elif t[e] == " " and t[e - 1] != " ":
                e += 1
            else:
                break
        flat = t[a:e].replace(" ", "").upper()
        if not left and not _word_after(t, e) and int((flat[4:] + flat[:4]).translate(_NUMBERS)) % 97 == 1:
            return a, e, "iban"
    if b - a >= 32 and all(c in _HEX for c in t[a:b]) and not t[a:b].isdigit() and not t[a:b].isalpha():
        return a, b, "secret"
    return None


def parse_secret(t: str, start: int, end: int) -> Span | None:
    """From a cue: an equals sign or colon, then a value, perhaps quoted, of six characters with a digit among them. Blanks may be beside the sign, any number."""
    i, n = end, len(t)
    if i < n and t[i] in "\"'":
        i += 1
    while i < n and t[i] in " \t":
        i += 1
    if i >= n or t[i] not in "=:":
        return None
    i += 1
    while i < n and t[i] in " \t=>":
        i += 1
    quote = t[i] if i < n and t[i] in "\"'" else ""
    i += len(quote)
    _, b = _grow(t, i, i, frozenset(), _VALUE)
    if quote:
        close = b
        while close < n and t[close] != quote and not t[close].isspace():
            close += 1
        if close > i and close < n and t[close] == quote:
            b = close
    if b < n and t[b] != quote or not quote:
        while b > i and t[b - 1] in ".-~":
            b -= 1
    value = t[i:b]
    return (i, b, "secret") if len(value) >= 6 and any(c in _DIGIT for c in value) else None


def parse_access_key(t: str, a: int) -> Span | None:
    """From "AKIA": sixteen more capitals or digits, and no more."""
    b = a + 20
    s = t[a:b]
    return (a, b, "secret") if len(s) == 20 and s.upper() == s and s.isascii() and s.isalnum() and not _word_before(t, a) and not _word_after(t, b) else None


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    table = ahocorasick.Automaton()
    for word in SECRET_CUES:
        table.add_word(word, ("cue", len(word)))
    table.add_word("akia", ("key", 4))
    table.add_word("@", ("at", 1))
    table.add_word("://", ("scheme", 3))
    for x in string.digits:
        table.add_word(x + ".", ("dot", 2))
        for y in string.digits:
            table.add_word(x + y, ("digits", 2))
    table.make_automaton()
    return table


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def find(t: str) -> list[Span]:
    """Spans ``(start, end, kind)`` without overlap, in order; of overlapping ones the earlier, then the longer."""
    spans: set[Span] = set()
    run = dotted = code = address = 0  # where the last run of each kind ends: what is before was looked at
    for end, (kind, n) in _anchors().iter(_lower(t)):
        a = end + 1 - n
        found = None
        if kind == "digits":
            if a < run or t[a] not in _DIGIT:
                continue
            x, run = _run(t, a, run)
            spans.update(parse_run(t, x, run))
            # digits at the ends of a run may be part of letters and digits
            for i, word in ((x, _word_before(t, x)), (run - 1, _word_after(t, run))):
                if word and i >= code:
                    y, code = _grow(t, i, i, _ALNUM, _ALNUM)
                    if found := parse_code(t, y, code):
                        spans.add(found)
            continue
        if kind == "dot":
            if a < dotted or t[a] not in _DIGIT:
                continue
            x, dotted = _grow(t, a, a, _DOTTED, _DOTTED)
            found = _octets(t, x, dotted)
        elif kind == "at":
            found = parse_email(t, a)
        elif kind == "scheme":
            address = address if a + 3 <= address else _address_end(t, a + 3)
            found = parse_url(t, a, address)
        elif kind == "cue":
            found = parse_secret(t, a, end + 1)
        else:
            found = parse_access_key(t, a)
        if found:
            spans.add(found)
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact(t: str) -> tuple[str, list[Span]]:
    spans = find(t)
    if not spans:
        return t, spans
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [t[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, t[at:]]), spans


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("text")
        texts, found, kinds = [], [], []
        for t in batch.column(i).to_pylist():
            if t is None:
                texts.append(None), found.append(0), kinds.append("")
                continue
            clean, spans = redact(t)
            texts.append(clean)
            found.append(len(spans))
            names = [k for _, _, k in spans]
            kinds.append(",".join(f"{k}:{names.count(k)}" for k in KINDS if k in names))
        columns = list(batch.columns)
        columns[i] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64()), pa.array(kinds, pa.string())], names=[*batch.schema.names, "found", "kinds"])


def _cleaned(rows: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_redact, f"{fields}, found long, kinds string")


def redacted(docs: DataFrame) -> DataFrame:
    """``documents`` -> ``(doc_id, text, found, kinds)`` for each row.

    ``text`` has placeholders such as [EMAIL] for what was found, ``found`` counts
    them and ``kinds`` counts each kind ("email:1,ip:2"). A null text stays null, an
    empty one empty, both with nothing found; a text without findings is unchanged.
    Repeated rows give repeated results, an empty table none. Texts are read whole, in time linear in their
    length. Of other columns none is read, whatever their names.
    """
    return _cleaned(pick(docs, "doc_id", "text"))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The five columns of ``documents`` with redacted texts, a row for each row; ``n_chars`` is counted anew where a text changed.

    Nulls of any column, empty and very long texts, repeated rows, empty tables and further columns are dealt with as in ``redacted``.
    """
    rows = _cleaned(pick(docs, *DOCUMENT_COLUMNS))
    return rows.withColumn("n_chars", F.when(F.col("found") > 0, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)
