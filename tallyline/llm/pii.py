"""Personal data replaced by keyed surrogates.

Entities are found by their form: e-mail addresses, phone numbers, card numbers that pass their
checksum and have an issuer's first digits and length, account and
social security numbers, IP addresses, secrets, and names behind a title. An entity's
canonical form (digits of a number, lower case of an address) is put through a keyed
permutation of all forms of its shape, letter for letter of the same script and digit
for digit. Surrogates are of the same type: cards keep issuer and length and have a right
check digit, account numbers keep their country and have right check digits, private
addresses stay private and public ones public, valid social security numbers stay valid.
Names are drawn by key from some thousand made-up ones by gender and script. The same entity thus
gets the same surrogate in every document and spelling. A name is a word of a script; a
given name's gender comes from all its titled mentions, and is handed on as below. A
document's capitalised words that a titled name in it has, too, are names without a title.

A surrogate could still be somebody's real entity, or two names could draw the same one.
So the distinct entities of all documents are checked with joins: whoever collides draws
again, with longer forms after some draws, until none does. Only these exceptions are
handed to the pass that rewrites the texts.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tallyline.llm.common import trimmed, written

#: Exceptions that are broadcast, at most; beyond, they are joined per text.
MAX_BROADCAST_EXCEPTIONS = 100_000
#: Draws of one length.
DRAWS = 3
ROUNDS = 8

# Titles by gender, and names to draw by script and gender.
_TITLES = {
    "m": "Mr Mister Herr Monsieur Señor господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita госпожа".split(),
    "n": "Dr Doctor Prof Professor".split(),
}
# Parts that names to draw are put together from: a beginning, a middle and an ending.
_NAME_PARTS = {
    "latin": (
        "Al Bar Cor Dan El Fer Gar Hel Is Jar Kal Lor Mar Nor Os Per Ros Sal Tor Ul Var Wil Yan Zel".split(),
        "b d f l m n r s t v".split(),
        {"m": "an ardo ek in ius o on us".split(), "f": "a ea ella ia ina issa une yra".split(), "n": "ay en ey is it or ul yn".split()},
    ),
    "cyrillic": (
        "Ал Бор Вар Гор Дан Ел Жар Зар Ил Кор Лев Мир Нор Ор Пав Рад Сав Тим Уль Фад Яр".split(),
        "б в д л м н р с т".split(),
        {"m": "ан ек ен ий ин ор ослав".split(), "f": "а ана ева ина ия ослава уша".split(), "n": "ау и ичи о у ы эль".split()},
    ),
    "greek": (
        "Αλ Βαρ Γιωρ Δαν Ελ Ζαφ Ηλ Θαλ Καλ Λαμ Μαρ Νικ Ορ Παν Ροδ Σταμ Τιμ Φαν Χαρ".split(),
        "δ κ λ μ ν ρ τ".split(),
        {"m": "άκης έας ίος ος ων ώτης".split(), "f": "έα ή ία ίνα ούλα ώ".split(), "n": "ι ιού άρι έλι ού".split()},
    ),
}
_NAMES = {
    (script, gender): [a + b + c for a in first for b in middle for c in endings]
    for script, (first, middle, last) in _NAME_PARTS.items()
    for gender, endings in last.items()
}
_SCRIPTS = {"latin": r"A-Za-zÀ-ÖØ-öø-ɏ", "cyrillic": r"Ѐ-ӿ", "greek": r"Ͱ-Ͽἀ-῿"}

#: First and last lower-case letter of alphabets whose letters stand for each other.
_ALPHABETS = [("0", "9"), ("a", "z"), ("à", "ö"), ("ø", "ÿ"), ("α", "ω"), ("а", "я"), ("א", "ת"), ("ء", "ي"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "龥"), ("가", "힣")]
_RANGES = [(ord(a), ord(b) - ord(a) + 1) for a, b in _ALPHABETS]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
_LETTERS = "".join(_SCRIPTS.values())
_NAME = rf"[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆ-Ώ](?:[{_LETTERS}]|-(?=[{_LETTERS}])|[’'](?=[{_LETTERS}])(?![sS](?!\w)))+"
# A name that says that its value is secret, and a value of eight characters or more: in
# quotes, or up to a blank, quote, bracket or separator.
_SECRET_WORD = r"""(?i:pass(?:word|wd|phrase|code|wort)|pwd|kennwort|contraseña|mot\ de\ passe|пароль|secret|token|credentials?)
    |(?:(?<![^\W_\d])(?i:key)|(?<=[a-z])Key|(?i:(?<=api|pwd)key|(?<=auth)key|(?<=access)key|(?<=secret|master)key|(?<=private|signing)key))"""
_ASSIGNED = rf"""(?:{_SECRET_WORD})(?:_(?i:id|base|hash|value))?\d*(?:\\?["'`]\]?)?[ \t]*(?:={{1,3}}>?|:=|:)
    (?P<gap>[ \t]*)(?:(?P<escape>\\?)(?P<quote>["'`])(?P<quoted>(?:(?!(?P=quote))[^\s\\]){{8,}}|(?:(?!(?P=quote))\S){{8,}})(?=(?P=escape)(?P=quote))
    |(?P<bare>(?!//|\$[{{(]|\{{\{{|\*\*)[^\s"'`<>()\[\]{{}},;&]{{8,}}+)(?![(\[{{]))"""
#: What stands in prose behind a word with a colon, too.
_PROSE = re.compile(r"(?i:key|secret|token|credentials?)(?!\w)[^:=]*:[ \t]+[^\W\d_]+")
_PHONE = r"""(?<![\w.+-])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])
       |(?<![\w.+-])(?:\+\d{1,3}|00[1-9]\d{0,2}(?=[ .-]))(?:[ .-]?\d){6,12}(?![\w-])"""
#: A number with its thousands apart isn't a phone number.
_THOUSANDS = re.compile(r"[1-9]\d?([ .])\d{3}(?:\1\d{3})+|[1-9]\d\d([ .])(?:\d{3}\2)*000")
FOUND_PHONE = re.compile(_PHONE, re.X)
_FOUND = rf"""
    (?P<email>(?<![\w.+%-])\w(?:[\w.+%-]*\w)?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}})
    |(?P<secret>(?<![^"'`=:\s])[0-9A-Fa-f]{{32,}}(?!\w))
    |(?P<iban>(?<!\w)[A-Z]{{2}}\d\d(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))
    |(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![\w:]|\.\d))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d\d-\d{{4}}(?![\w-]))
    |(?P<card>(?<![\w.+-])(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -]\d{{1,3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?![\w-]))
    |(?P<phone>{_PHONE})
    |(?P<name>(?<!\w)(?:{_TITLE})\.?\ {_NAME}(?:\ {_NAME}){{0,2}})
    """
#: Assignments are read only in texts with a word for a secret, as they are slow to look for.
FOUND = re.compile(rf"{_FOUND}|(?P<assigned>{_ASSIGNED})", re.X)
FOUND_UNASSIGNED = re.compile(_FOUND, re.X)
_SECRET_PARTS = "pass pwd kennwort contraseña пароль secret token credential key".split()
_WORD = re.compile(rf"(?<!\w){_NAME}")
#: First digits and lengths of the cards of all large issuers.
_ISSUED = re.compile(
    r"""4(?:\d{12}|\d{15}|\d{18})  # Visa
    |(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}  # Mastercard
    |3[47]\d{13}|1\d{14}  # American Express, UATP
    |3(?:0[0-5]\d|095|[689]\d\d)\d{10}|3(?:0[0-5]|[689]\d)\d{13,16}  # Diners
    |35(?:2[89]|[3-8]\d)\d{12,15}  # JCB
    |(?:5[0678]|6\d)\d{11,17}  # Maestro, Discover, UnionPay, RuPay, Elo
    |8[12]\d{14,17}|220[0-4]\d{12,15}|9792\d{12}  # UnionPay, RuPay, Mir, Troy""",
    re.X,
)
#: What any entity must contain; texts without it are passed on unread.
_HINT = re.compile(rf"[@\d]|(?<!\w)(?:{_TITLE})(?!\w)|(?:[0-9a-fA-F]{{32}})")
_COUNTRY = re.compile(r"(?:\+|00)(\d{1,3}?)(?=[ .(-])|(?:\+|00)(1|7|\d\d)")


def _alphabet(c: str) -> tuple[int, int] | None:
    o = ord(c)
    return next(((first, size) for first, size in _RANGES if first <= o < first + size), None)


def _number(digits: list[int], sizes: list[int]) -> int:
    n = 0
    for d, size in zip(digits, sizes):
        n = n * size + d
    return n


def _digits(n: int, sizes: list[int]) -> list[int]:
    out = []
    for size in reversed(sizes):
        n, d = divmod(n, size)
        out.append(d)
    return out[::-1]


def permuted(key: bytes, tweak: str, symbols: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of the lists of symbols below ``sizes``: a Feistel network.

    The halves are changed in turn, each by adding a digest of the other.
    """
    half = len(symbols) // 2
    a, b, sa, sb = symbols[:half], symbols[half:], sizes[:half], sizes[half:]
    na, nb = 1, 1
    for s in sa:
        na *= s
    for s in sb:
        nb *= s
    x, y = _number(a, sa), _number(b, sb)
    for r in range(ROUNDS):
        other = y if r % 2 else x
        digest = hmac.digest(key, f"{tweak}|{sizes}|{r}|{other}".encode(), "sha512")
        if r % 2:
            x = (x + int.from_bytes(digest, "big")) % na
        else:
            y = (y + int.from_bytes(digest, "big")) % nb
    return _digits(x, sa) + _digits(y, sb)


def same_shape(key: bytes, tweak: str, text: str) -> str:
    """Letters and digits of ``text`` (lower case) exchanged for others of their alphabet."""
    places = [(i, a) for i, c in enumerate(text) if (a := _alphabet(c))]
    if not places:
        return text
    symbols = [ord(text[i]) - first for i, (first, _) in places]
    shape = "".join("x" if _alphabet(c) else c for c in text)
    out = list(text)
    for (i, (first, _)), d in zip(places, permuted(key, f"{tweak}|{shape}", symbols, [s for _, (_, s) in places])):
        out[i] = chr(first + d)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _is_card(digits: str) -> bool:
    return bool(_ISSUED.fullmatch(digits)) and _luhn(digits[:-1]) == int(digits[-1])


def _script(word: str) -> str:
    return next((s for s, letters in _SCRIPTS.items() if re.match(f"[{letters}]", word)), "latin")


def entity(kind: str, found: str) -> list[tuple[str, str]]:
    """(kind, canonical form) of what was found; several for the parts of a name."""
    if kind == "phone":
        m = _COUNTRY.match(found)
        country = (m[1] or m[2]) if m else ""
        digits = re.sub(r"\D", "", found[m.end() :] if m else found)
        return [("phone", f"{country}|{digits}")]
    if kind in ("card", "ssn"):
        return [(kind, re.sub(r"\D", "", found))]
    if kind == "iban":
        return [(kind, found.replace(" ", ""))]
    if kind == "ip6":
        return [(kind, f"{int(ipaddress.IPv6Address(found)):032x}")]
    if kind == "secret":
        return [(kind, found)]
    if kind == "name":
        return [(f"name {_script(w)}", w.lower()) for w in found.split(" ")[1:]]
    if kind == "repeat":
        return [(f"name {_script(found)}", found.lower())]
    return [(kind, found.lower())]


def _gender(kind: str, found: str, place: int) -> str | None:
    """What a title tells of the given name at ``place``; the last name has no gender."""
    if kind != "name":
        return None
    title, *words = found.split(" ")
    gender = next(g for g, titles in _TITLES.items() if title.rstrip(".") in titles)
    return gender if gender != "n" and place < len(words) - 1 else None


def _mod97(account: str) -> int:
    """The remainder that tells whether an account number's check digits are right: 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


#: Areas that social security numbers don't have.
_NO_AREAS = (0, 666, *range(900, 1000))


def _other_ssn(key: bytes, tweak: str, digits: str) -> str:
    """Another number, as valid as this one."""
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in _NO_AREAS or not group or not serial:
        return same_shape(key, tweak + "invalid", digits)
    place = area - 1 - (area > 666)
    place, group, serial = permuted(key, tweak, [place, group - 1, serial - 1], [898, 99, 9_999])
    return f"{place + 1 + (place >= 665):03}{group + 1:02}{serial + 1:04}"


#: Addresses that stand for themselves.
_NOBODY = ("0.0.0.0", "255.255.255.255")


def _kind_of_address(octets: list[int]) -> int:
    """Octets and bits that tell private, own, link-local and group addresses from public ones."""
    first, second = octets[:2]
    if first in (0, 10, 127):
        return 8
    if (first, second) in ((192, 168), (169, 254)):
        return 16
    if first == 172 and 16 <= second < 32:
        return 12
    return 4 if first >= 224 else 0


def _other_address(key: bytes, tweak: str, address: str, draw: int) -> str:
    """An address of the same kind; private networks that are full go on in the largest one."""
    octets = [int(o) for o in address.split(".")]
    bits = _kind_of_address(octets)
    if bits in (12, 16) and draw >= 2 * DRAWS:
        octets, bits = [10, *octets[1:]], 8
    number = _number(octets, [256] * 4)
    kept, free = number >> (32 - bits), 32 - bits
    tweak = f"{tweak}|{bits}|{kept if bits else ''}"
    while True:  # a permutation walked until it is back among addresses of its kind
        symbols = permuted(key, tweak, [number >> i & 1 for i in range(free - 1, -1, -1)], [2] * free)
        number = kept << free | _number(symbols, [2] * free)
        found = _digits(number, [256] * 4)
        if _kind_of_address(found) == bits:
            return ".".join(map(str, found))


def surrogate(key: bytes, kind: str, canonical: str, draw: int, gender: str = "n") -> str:
    """Canonical form of the surrogate; later draws are of other, in time longer, forms."""
    tweak, longer = f"{kind}|{draw}", draw // DRAWS
    if kind == "phone":
        country, digits = canonical.split("|")
        more = "".join(str(d) for d in hmac.digest(key, (tweak + canonical).encode(), "sha256")[:longer])[:longer]
        return f"{country}|{same_shape(key, tweak + country, digits)}{more}"
    if kind == "card":  # four digits tell the issuer
        body = canonical[:4] + same_shape(key, tweak + canonical[:4], canonical[4:-1])
        return body + str(_luhn(body))
    if kind == "ssn":
        return _other_ssn(key, tweak, canonical)
    if kind == "ip":
        return _other_address(key, tweak, canonical, draw)
    if kind == "ip6":  # the first group tells what kind of address it is
        symbols = permuted(key, tweak + canonical[:4], [int(c, 16) for c in canonical[4:]], [16] * 28)
        return canonical[:4] + "".join("0123456789abcdef"[s] for s in symbols)
    if kind == "iban":
        account = same_shape(key, tweak + canonical[:2], canonical[4:].lower()).upper()
        return f"{canonical[:2]}{98 - _mod97(canonical[:2] + '00' + account):02}{account}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+|[0-9A-Fa-f]{32,}", canonical):
            symbols = permuted(key, tweak, [int(c, 16) for c in canonical], [16] * len(canonical))
            text = "".join("0123456789abcdef"[s] for s in symbols)
            if canonical.upper() == canonical:
                return text.upper()
            return "".join(n.upper() if c.isupper() else n for c, n in zip(canonical, text))
        swapped = same_shape(key, tweak, canonical.lower())
        return "".join(n.upper() if c.isupper() else n for c, n in zip(canonical, swapped))
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        host, _, top = domain.rpartition(".")
        whole = same_shape(key, tweak + top, f"{local}@{host}")
        more = same_shape(key, tweak + canonical, "a" * longer)
        return whole.replace("@", more + "@", 1) + "." + top
    if kind.startswith("name"):
        script = kind.split(" ")[1]
        names = _NAMES[(script, gender)]
        digest = int.from_bytes(hmac.digest(key, f"{tweak}|{canonical}".encode(), "sha256"), "big")
        drawn = []
        for _ in range(1 + longer):
            digest, place = divmod(digest, len(names))
            drawn.append(names[place])
        return "-".join(drawn).lower()
    return same_shape(key, tweak, canonical)


def _cased(pattern: str, text: str) -> str:
    """``text`` in the case of ``pattern``."""
    if pattern.isupper():
        return text.upper()
    if pattern[:1].isupper() and pattern[1:].islower():
        return "-".join(w[:1].upper() + w[1:] for w in text.split("-"))
    return "".join(n.upper() if c.isupper() else n for c, n in zip(pattern, text)) + text[len(pattern) :]


def _formatted(kind: str, found: str, forms: list[str]) -> str:
    """The surrogates' canonical forms written as the entity was."""
    if kind in ("email", "ip"):
        return _cased(found, forms[0])
    if kind == "ip6":
        address = ipaddress.IPv6Address(int(forms[0], 16))
        text = address.exploded if re.search(r"(?<![^:])0\w{3}", found) else address.compressed
        return text.upper() if found.upper() == found and not found.isdigit() else text
    if kind == "secret":
        return forms[0]
    if kind == "repeat":
        return _cased(found, forms[0])
    if kind == "name":
        title, *words = found.split(" ")
        return " ".join([title, *(_cased(w, f) for w, f in zip(words, forms))])
    m = _COUNTRY.match(found) if kind == "phone" else None
    head, rest = (found[: m.end()], found[m.end() :]) if m else ("", found)
    symbols = iter(forms[0].split("|")[-1])
    body = "".join(next(symbols, c) if c.isalnum() else c for c in rest)
    return head + body + "".join(symbols)


def _card(m: re.Match) -> tuple[int, str] | None:
    """End and kind of the card that a match begins with, or of a phone number of its form."""
    groups = [g.end() + m.start() for g in re.finditer(r"\d+", m[0])]
    for end in [groups[-1], *groups[3:-1]]:  # a card may be followed by its check number
        if _is_card(re.sub(r"\D", "", m.string[m.start() : end])):
            return end, "card"
    phone = FOUND_PHONE.fullmatch(m[0])
    return (m.end(), "phone") if phone else None


def _iban(m: re.Match) -> int | None:
    """End of the account number that a match begins with: the longest with right check digits."""
    for part in range(len(m[0]), 14, -1):
        if part < len(m[0]) and m[0][part].isalnum() or not m[0][part - 1].isalnum():
            continue
        account = m[0][:part].replace(" ", "")
        if len(account) >= 15 and _mod97(account) == 1:
            return m.start() + part
    return None


def _is_address(found: str) -> bool:
    """Whether this is an IPv6 address of at least three groups, and not a time or a name."""
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return len([g for g in found.split(":") if g]) >= 3


def _value(m: re.Match) -> tuple[int, int] | None:
    """Where the secret of an assignment is; none if its value is prose or of another kind."""
    start, end = m.span("quoted")
    if start < 0:
        start, end = m.span("bare")
        end = start + len(m["bare"].rstrip(".:!?"))
        before = m.string[: m.start()][-1:]
        if end - start < 8 or not (before == "_" or before == "-") and _PROSE.fullmatch(m.string, m.start(), end):
            return None
    other = FOUND.fullmatch(m.string, start, end)
    if other and other.lastgroup not in ("secret", "assigned"):
        return None
    return start, end


def _titled(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what is found by its form, in order."""
    small = text.lower()
    told = ("=" in text or ":" in text) and any(w in small for w in _SECRET_PARTS)
    find = (FOUND if told else FOUND_UNASSIGNED).search
    at = 0 if told or _HINT.search(text) else len(text)
    while m := find(text, at):
        end, kind = m.end(), m.lastgroup
        if kind == "card":
            if (card := _card(m)) is None:
                at = end
                continue
            end, kind = card
        if kind == "iban":
            if (end := _iban(m)) is None:
                at = m.start() + 4
                continue
        if (
            kind == "phone" and _THOUSANDS.fullmatch(m[0])
            or kind == "ip" and m[0] in _NOBODY
            or kind == "ip6" and not _is_address(m[0])
        ):
            at = m.start() + 1 if kind == "ip6" else end
            continue
        if kind == "assigned":
            if (value := _value(m)) is None:
                at = max(m.start("quoted"), m.start("bare"))
                continue
            yield *value, "secret"
            at = value[1]
            continue
        yield m.start(), end, kind
        at = end


def _repeats(text: str, names: set[str], at: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Words of ``names`` in a part of the text; of a compound, those it is made of."""
    for m in _WORD.finditer(text, at, end):
        if m[0].lower() in names:
            yield m.start(), m.end(), "repeat"
        elif not m[0].isalpha():
            for part in re.finditer(r"[^\W\d_]+", m[0]):
                if part[0][0].isupper() and part[0].lower() in names:
                    yield m.start() + part.start(), m.start() + part.end(), "repeat"


def mentions(text: str) -> Iterator[tuple[int, int, str, list[tuple[str, str]]]]:
    """(start, end, kind, entities) of what is found in ``text``, in order."""
    found = list(_titled(text))
    names = {w.lower() for start, end, kind in found if kind == "name" for w in text[start:end].split(" ")[1:]}
    at = 0
    for place in [*found, (len(text), len(text), "")]:
        if names:
            for start, end, kind in _repeats(text, names, at, place[0]):
                yield start, end, kind, entity(kind, text[start:end])
        if place[2]:
            yield *place, entity(place[2], text[place[0] : place[1]])
        at = place[1]


def _entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, form) of all texts, and the gender that all its titles agree on, or "n"."""
    schema = StructType([StructField(c, StringType()) for c in ("kind", "form", "gender")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                found = {
                    (*e, _gender(kind, t[start:end], i))
                    for t in whole.slice(at, 256).column(0).to_pylist()
                    if t
                    for start, end, kind, es in mentions(t)
                    for i, e in enumerate(es)
                }
                columns = [pa.array([e[i] for e in found], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    told = docs.select("__text").mapInArrow(trimmed(run), schema)
    least, most = F.min("gender"), F.max("gender")
    return told.groupBy("kind", "form").agg(F.when(least == most, least).otherwise("n").alias("gender"))


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, gender, draw) of the entities whose first surrogate is another's or
    real, and of names with a gender.

    Of those that draw the same surrogate, the first in order of form keeps it.
    """
    schema = StructType([*entities.schema.fields, StructField("draw", IntegerType()), StructField("new", StringType())])

    def drawn(rows: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                new = [surrogate(key, k, f, d, g) for k, f, g, d in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=schema.names)

        return rows.select("kind", "form", "gender", "draw").mapInArrow(trimmed(run), schema)

    real = entities.select("kind", F.col("form").alias("new"))
    waiting = entities.withColumn("draw", F.lit(0))
    settled = None
    while True:
        now = written(drawn(waiting), "surrogates")
        free = now.join(real, ["kind", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min("form").alias("form"))
        first = written(first, "settled")
        waiting = now.join(first, ["kind", "new", "form"], "left_anti")
        waiting = written(waiting.select("kind", "form", "gender", (F.col("draw") + 1).alias("draw")), "colliding")
        draws = now.join(first, ["kind", "new", "form"], "left_semi").where("draw > 0 or gender != 'n'").select("kind", "form", "gender", "draw")
        late = draws if settled is None else late.unionByName(draws)
        settled = first if settled is None else settled.unionByName(first)
        if not waiting.limit(1).count():
            return written(late, "exceptions")


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text, and the number of replacements in ``count_col``.

    Texts without entities, empty and null ones stay as they are (0 replacements). Equal
    entities get equal surrogates in all rows, different ones different ones; none gets
    a form that is real anywhere in ``docs``. Repeated rows stay equal; an empty table
    gives an empty result; all other columns come out unchanged, whatever their names
    (``count_col`` must not be among them). A text is read whole, however long, by one task.
    """
    if count_col in docs.columns:
        raise ValueError(f"there is a column {count_col!r} already")
    spark = docs.sparkSession
    named = docs.select(F.col(text_col).cast("string").alias("__text"))
    late = exceptions(written(_entities(named), "entities"), key)
    few = late.count() <= MAX_BROADCAST_EXCEPTIONS
    known = {(r["kind"], r["form"]): (r["draw"], r["gender"]) for r in late.toArrow().to_pylist()} if few else {}
    sent = spark.sparkContext.broadcast(known)
    place, width = docs.columns.index(text_col), len(docs.columns)
    work = docs
    if not few:  # each text's own exceptions, joined by the text's digest
        work = docs.withColumn("__md5", F.md5(F.col(text_col).cast("string")))
        work = work.join(_per_text(named, late), "__md5", "left").select(*docs.columns, "__late")
    extra = [StructField(count_col, LongType())] if count_col else []
    schema = StructType([*docs.schema.fields, *extra])

    def rewritten(text: str, draws: dict) -> tuple[str, int]:
        out, at, n = [], 0, 0
        for start, end, found, parts in mentions(text):
            forms = [surrogate(key, kind, form, *draws.get((kind, form), (0,))) for kind, form in parts]
            out += [text[at:start], _formatted(found, text[start:end], forms)]
            at, n = end, n + 1
        return ("".join([*out, text[at:]]), n) if n else (text, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(place).to_pylist()
                if few:
                    draws = [sent.value] * len(texts)
                else:
                    own = batch.column(width).to_pylist()
                    draws = [{(x["kind"], x["form"]): (x["draw"], x["gender"]) for x in xs or []} for xs in own]
                new = [rewritten(t, d) if t is not None else (None, 0) for t, d in zip(texts, draws)]
                columns = list(batch.columns[:width])
                columns[place] = pa.array([t for t, _ in new], columns[place].type)
                if count_col:
                    columns.append(pa.array([n for _, n in new], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return work.mapInArrow(trimmed(run), schema)


def _per_text(named: DataFrame, late: DataFrame) -> DataFrame:
    """(__md5, __late): the exceptions that each text mentions."""
    schema = StructType([StructField(c, StringType()) for c in ("__md5", "kind", "form")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [
                    (digest, *e)
                    for digest, text in zip(*(c.to_pylist() for c in batch.columns))
                    for e in {e for *_, es in mentions(text or "") for e in es}
                ]
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = named.select(F.md5("__text"), "__text").toDF("__md5", "__text").mapInArrow(trimmed(run), schema).distinct()
    joined = found.join(late, ["kind", "form"])
    return joined.groupBy("__md5").agg(F.collect_list(F.struct("kind", "form", "gender", "draw")).alias("__late"))
