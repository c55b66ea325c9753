"""PII surrogates: keyed, type-consistent replacements that keep form, distinctness and coreference.

Detected: e-mail addresses, IPv4 addresses, phone numbers, card numbers (13 to 19 digits),
social security numbers, IBANs, long hexadecimal secrets, quoted secrets behind a word such
as ``token =``, names behind a title, and listed first names before another name.  Not
detected: IPv6 addresses, dates of birth, and other names without a title.

A surrogate comes from a keyed Feistel permutation over the entity's own format: digits,
upper-case and lower-case letters of a script and hexadecimal digits turn into symbols of
the same class, all other characters stay.  Letters and digits outside ``_ALPHABETS`` have
the like ones of their script and of the same 256 code points as their class.  A permutation
never maps two entities to one, and one entity always has one surrogate, in every document.
The key is the caller's: who has it can undo the replacement, so it is kept apart from the
data (``key_of`` takes it from ``spark.docloom.pii.key``).

Names and addresses are mapped by parts, each with its own surrogate: first names, initials,
surname, mailbox and domain.  So ``John Smith`` and ``Dr Smith``, or two mailboxes of a
domain, stay together.  A name has all words with a capital behind its title, up to six, with
initials, apostrophes and particles such as ``von``; where a script has no capitals, up to
four words, as nothing tells where the name ends.  The last word is the surname; particles
and titles stay.  Names in capitals have the surrogates that they have otherwise.  A word
that stands alone is a surname, unless it is listed as a first name, or the corpus has it as a
first name and not as a surname.  Listed first names are permuted within the list of their
gender; others keep their last letter, which often tells it.  Card numbers keep the validity
of their check digit, IBANs their country and the validity of their check digits, telephone
numbers their country or the 0 before an area code, IP addresses stay IP addresses.

Collision check: a surrogate must not be real.  Whole entities, surnames and domains are
joined with their surrogates; those that hit a real one, or that another one has too, try
the permutation of the next key, and are accepted where the result is not real, not accepted
before and not wanted by another in the same round (the least goes first).  As no surname or
domain of a surrogate is real, no name or address is.  What ``MAX_TRIES`` keys leave over
(its format is full) is drawn from a keyed digest under the same check, longer where the
format allows, until all are placed.  These exceptions are few; up to ``EXCEPTION_ROWS`` they
are broadcast after a count, beyond that they are joined to their documents.

Null texts stay null, empty ones empty; both have no entities.  Repeated rows give a row
each, ties (overlapping finds) go to the earlier pattern.  Texts may have any length and are
read as a whole; an empty table gives no rows.  Texts without entities come back unchanged,
as do all other columns, whatever their names; those named ``pii_n`` or ``pii_spans`` are
replaced by the results.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import textbatch as tb
from docloom.llm.tables import quoted, table, written

KEY_CONF = "spark.docloom.pii.key"
_OPEN_KEY = b"no key was set: these surrogates are for tests only"
EXCEPTION_ROWS = 100_000
ROUNDS = 8
MAX_TRIES = 32
SAME_LENGTH_DRAWS = 8
UNCHECKED = ("first", "local", "initial")
ROLES = ("lone", "given", "last")

FEMALE = ("Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Helen", "Ines", "Irene", "Julia", "Laura", "Lucia", "Marie", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera")
MALE = ("Adam", "Albert", "Anton", "Bruno", "Carlos", "Daniel", "David", "Eric", "Felix", "Frank", "Hugo", "Ivan", "James", "John", "Jorge", "Karl", "Leo", "Louis", "Mark", "Martin", "Oscar", "Paul", "Peter", "Thomas")
_TITLES = r"Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr|Doña|Don"
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1E000)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTERS = rf"(?:[^\W\d_]|[{_MARKS}])+"


def _ranges(chars: list[str]) -> str:
    """A character class of these characters, in order."""
    out, at = [], 0
    while at < len(chars):
        end = at
        while end + 1 < len(chars) and ord(chars[end + 1]) == ord(chars[end]) + 1:
            end += 1
        out.append(chars[at] if end == at else f"{chars[at]}-{chars[end]}")
        at = end + 1
    return "".join(out)


_ALPHA = [c for c in map(chr, range(0x41, 0x20000)) if c.isalpha()]
_UPPER = _ranges([c for c in _ALPHA if c.isupper() or c.istitle()])
_CASELESS = _ranges([c for c in _ALPHA if unicodedata.category(c) == "Lo"])
# Words that stand within names and are kept as they are.
PARTICLES = tuple("von van vom der den de del della di da do dos das du la le zu zur zum ter ten bin ibn bint al el ben y e af av".split())
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )"
_INITIAL = rf"[{_UPPER}]\.(?:-?[{_UPPER}]\.)*|[{_UPPER}](?= {_PARTICLE}*[{_UPPER}])"
_FULL = rf"[{_UPPER}][{_MARKS}]*['’]?{_LETTERS}(?:-{_LETTERS}|['’](?!s(?!\w)){_LETTERS})*"
#: words that begin with a capital, with initials and particles; or up to four words of a script without capitals
_CASED = rf"(?:{_PARTICLE})*(?:(?:{_INITIAL}) )*(?:{_PARTICLE})*{_FULL}(?: (?:{_PARTICLE})*(?:{_FULL}|{_INITIAL})){{0,5}}"
_UNCASED = rf"[{_CASELESS}]{_LETTERS}(?:[-'’]{_LETTERS})?(?: [{_CASELESS}]{_LETTERS}(?:[-'’]{_LETTERS})?){{0,3}}"
_NAME = rf"(?:{_CASED}|{_UNCASED})"

_PATTERNS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("secret", "=:", re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']")),
    ("email", "@", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", "0123456789", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("hex", "0123456789", re.compile(r"(?<!\w)(?=[A-Fa-f]*\d)[0-9A-Fa-f]{24,}(?!\w)")),
    ("ip", "0123456789", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")),
    ("ssn", "0123456789", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", "0123456789", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("phone", "0123456789", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.])\+\d{8,14}(?!\w)|(?<![\w.])0\d{2,4}[ /]\d{6,8}(?!\w|\.\d)")),
    ("name", "", re.compile(rf"\b(?:{_TITLES}|{_TITLES.upper()})\b\.? ({_NAME})")),
    ("name", "", re.compile(rf"\b((?:{'|'.join(FEMALE + MALE)})(?: (?:{_PARTICLE})*(?:{_INITIAL}))*(?: (?:{_PARTICLE})*{_FULL}){{1,3}})")),
)
_FEMALE_TITLE = re.compile(r"(?i:\b(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña))\b\.? $")
_MALE_TITLE = re.compile(r"(?i:\b(?:Mr|Herr|Monsieur|Señor|Sr|Don))\b\.? $")
# Country codes of telephone numbers (all others have three digits), and the 0 before an area code.
_COUNTRY = re.compile(r"0(?=\d{2,4}[ /]\d{6,8}$)|\+(?:\d{1,3}(?=[ .(-])|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
_ANY = re.compile("[0-9@=:]")
_LISTED = frozenset(FEMALE + MALE)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and without overlap; earlier patterns win."""
    found: list[tuple[int, int, str]] = []
    hints = {h: any(c in text for c in h) for h in ("=:", "@", "0123456789")} if _ANY.search(text) else {}
    for kind, hint, pattern in _PATTERNS:
        if hint and not hints.get(hint):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if pattern.groups else m.span()
            if not any(a < y and x < b for x, y, _ in found):
                if kind == "name":
                    before = text[max(0, a - 12) : a]
                    kind_ = "name_f" if _FEMALE_TITLE.search(before) else "name_m" if _MALE_TITLE.search(before) else "name"
                    found.append((a, b, kind_))
                else:
                    found.append((a, b, kind))
    found.sort()
    return found


# --- permutations -----------------------------------------------------------------------

_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"
_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    _ACCENTED,
    _ACCENTED.upper().replace("SS", "ẞ"),
    "".join(map(chr, range(0x430, 0x450))),
    "".join(map(chr, range(0x410, 0x430))),
    "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2),
    "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
    "".join(map(chr, range(0x4E00, 0x9FA6))),
    "".join(map(chr, range(0x3041, 0x3097))),
    "".join(map(chr, range(0x30A1, 0x30FB))),
    "".join(map(chr, range(0xAC00, 0xD7A4))),
)
_OF = {c: (k, i) for k, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}


@lru_cache(1)
def _other_alphabets() -> dict[str, tuple[str, int]]:
    """(alphabet, position) of the letters and digits that ``_ALPHABETS`` lacks; each alphabet has two symbols or more."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if (c.isalpha() or c.isdecimal()) and c not in _OF:
            paired = c.swapcase().swapcase() == c  # letters whose other case is one letter, and goes back
            groups[unicodedata.category(c), unicodedata.name(c, "").partition(" ")[0], ord(c) >> 8, paired].append(c)
    # digits have alphabets of exactly ten, in order
    alone = [c for g in groups.values() if len(g) < 2 for c in g]
    tens = [g[i : i + 10] for k, g in groups.items() if k[0] == "Nd" for i in range(0, len(g), 10)]
    letters = [g for k, g in groups.items() if k[0] != "Nd" and len(g) > 1]
    return {c: (a, i) for a in map("".join, [*letters, *tens, alone]) for i, c in enumerate(a)}


def _class(c: str) -> tuple[str, int] | None:
    """(alphabet, position) of a character that is to be replaced; None of one that stays."""
    if c in _OF:
        k, i = _OF[c]
        return _ALPHABETS[k], i
    return None if c < "\x80" else _other_alphabets().get(c)


_HEX = {True: "0123456789ABCDEF", False: "0123456789abcdef"}


def _number(key: bytes, tweak: str, rnd: int, value: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}|{rnd}|{value}".encode(), hashlib.sha256).digest() * 2, "big")


def _feistel(digits: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """Keyed permutation of the mixed-radix numbers with these radices."""
    mid = (len(digits) + 1) // 2
    halves, sizes = [], []
    for part, rad in ((digits[:mid], radices[:mid]), (digits[mid:], radices[mid:])):
        v, size = 0, 1
        for d, r in zip(part, rad):
            v, size = v * r + d, size * r
        halves.append(v)
        sizes.append(size)
    tweak = f"{tweak}|{radices}"
    for rnd in range(ROUNDS):
        a, b = rnd & 1, 1 - (rnd & 1)
        halves[a] = (halves[a] + _number(key, tweak, rnd, halves[b])) % sizes[a]
    out: list[int] = []
    for v, rad in zip(halves, (radices[:mid], radices[mid:])):
        part = []
        for r in reversed(rad):
            part.append(v % r)
            v //= r
        out += part[::-1]
    return out


def _permute(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """A string of the same pattern of character classes."""
    chars = list(text)
    if hexadecimal:
        upper = text.upper() == text
        at = list(range(len(chars)))
        sets = [_HEX[upper]] * len(chars)
        digits = [int(c, 16) for c in chars]
    else:
        known = [(i, got) for i, c in enumerate(chars) if (got := _class(c))]
        at = [i for i, _ in known]
        sets = [a for _, (a, _) in known]
        digits = [d for _, (_, d) in known]
    for i, a, d in zip(at, sets, _feistel(digits, [len(a) for a in sets], key, tweak)):
        chars[i] = a[d]
    return "".join(chars)


def _luhn(digits: str) -> int:
    """The check digit that would follow."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(text: str, key: bytes) -> str:
    digits = [c for c in text if c.isdigit()]
    body = "".join(digits[:-1])
    off = int(digits[-1]) - _luhn(body)
    body = _permute(body, key, "card")
    new = iter(body + str((_luhn(body) + off) % 10))
    return "".join(next(new) if c.isdigit() else c for c in text)


@lru_cache(64)
def _shuffled(names: tuple[str, ...], key: bytes) -> dict[str, str]:
    order = sorted(names, key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
    return dict(zip(order, [*order[1:], order[0]]))


def _first_name(text: str, key: bytes) -> str:
    for names in (FEMALE, MALE):
        if text in names:
            return _shuffled(names, key)[text]
    new = _permute(text[:-1], key, "first") + text[-1]
    while new in FEMALE or new in MALE:  # walks on: listed names are the images of listed names only
        new = _permute(new[:-1], key, "first") + new[-1]
    return new


def _iban(text: str, key: bytes) -> str:
    """Another account of the country; its check digits are as far from the right ones as they were."""
    signs = text.replace(" ", "")

    def right(country: str, account: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97

    country, account = signs[:2], signs[4:]
    new = _permute(account, key, f"iban|{country}")
    check = 2 + (right(country, new) - 2 + int(signs[2:4]) - right(country, account)) % 97
    out = iter(f"{country}{check:02d}{new}")
    return "".join(c if c == " " else next(out) for c in text)


def family(kind: str) -> str:
    return "name" if kind.startswith("name") else kind


def _upper(text: str) -> str:
    return "".join("ẞ" if c == "ß" else u if len(u := c.upper()) == 1 else c for c in text)


def _told(word: str) -> str:
    """A name in capitals as it is written otherwise, so that both have one surrogate; other words as they are."""
    if len(word) > 1 and word.isupper():
        low = re.sub(_LETTERS, lambda m: m[0][0] + m[0].lower()[1:], word)
        return low if _upper(low) == word else word
    return word


def _words(entity: str) -> list[tuple[str | None, str]]:
    """(kind, word) of the words of a name: the last full one is the surname, those before are first names; particles have no kind."""
    words = entity.split(" ")
    whole = [i for i, w in enumerate(words) if w not in PARTICLES and not w.endswith(".") and len(w) > 1] or [len(words) - 1]
    out: list[tuple[str | None, str]] = []
    for i, w in enumerate(words):
        if w in PARTICLES:
            out.append((None, w))
        elif i == whole[-1]:
            alone = all(k is None for k, _ in out) and i == len(words) - 1
            out.append(("first" if alone and _told(w) in _LISTED else "lone" if alone else "surname", w))
        else:
            out.append(("first" if i in whole else "initial", w))
    return out


def parts_of(kind: str, entity: str) -> list[tuple[str, str]]:
    """The parts of an entity that are replaced by themselves, with the kind of each; a name of one word is a surname."""
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        return [("local", local), ("domain", domain.rpartition(".")[0])]
    if kind.startswith("name"):
        return [("surname" if k == "lone" else k, _told(w)) for k, w in _words(entity) if k]
    return [(kind, entity)]


def roles_of(kind: str, entity: str) -> list[tuple[str, str]]:
    """(lone, given or last; name) of a name's words: what tells the first names of a corpus."""
    if not kind.startswith("name"):
        return []
    roles = {"lone": "lone", "first": "given", "surname": "last"}
    return [(roles[k], _told(w)) for k, w in _words(entity) if k in roles]


def composed(kind: str, entity: str, replace: Callable[[str, str], str]) -> str:
    """The entity with its parts replaced; a name of one word is asked for as ``lone``."""
    if kind == "email":
        new = [replace(k, x) for k, x in parts_of(kind, entity)]
        return f"{new[0]}@{new[1]}.{entity.rpartition('.')[2]}"
    if kind.startswith("name"):
        out = []
        for k, w in _words(entity):
            told = _told(w)
            new = replace(k, told) if k else w
            out.append(new if told == w else _upper(new))
        return " ".join(out)
    return replace(kind, entity)


def part_surrogate(kind: str, part: str, key: bytes) -> str:
    """The permutation of this kind of part."""
    if kind == "ip":
        n = _feistel([int(x) for x in part.split(".")], [256] * 4, key, "ip")
        return ".".join(map(str, n))
    if kind == "card":
        return _card(part, key)
    if kind == "iban":
        return _iban(part, key)
    if kind == "hex" and part in (part.upper(), part.lower()):
        return _permute(part, key, "hex", True)
    if kind == "first":
        return _first_name(part, key)
    if kind == "lone":
        return part_surrogate("surname", part, key)
    if kind == "phone" and (country := _COUNTRY.match(part)):
        return country[0] + _permute(part[country.end() :], key, country[0])
    return _permute(part, key, kind)


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The entity's surrogate where no collision moves it."""
    return composed(kind, entity, lambda k, x: part_surrogate(k, x, key))


class _Draws:
    """Numbers from a keyed digest."""

    def __init__(self, key: bytes, what: str):
        self.key, self.what, self.n = key, what, 0

    def __call__(self, below: int) -> int:
        self.n += 1
        return _number(self.key, self.what, self.n, 0) % below

    def like(self, text: str, more: int) -> str:
        """Drawn symbols of the classes of these characters, and ``more`` of the last letter's or digit's class behind it."""
        out, last = [], None
        for c in text:
            got = _class(c)
            out.append(got[0][self(len(got[0]))] if got else c)
            last = (len(out), got[0]) if got else last
        at, alphabet = last or (len(out), _ALPHABETS[1])
        return "".join([*out[:at], *[alphabet[self(len(alphabet))] for _ in range(more)], *out[at:]])


def drawn(kind: str, entity: str, turn: int, key: bytes) -> str:
    """A replacement of a part whose letters and digits come from a keyed digest only, of the part's format.

    Surnames, domains and secrets grow from the first turn on, other kinds only after
    ``SAME_LENGTH_DRAWS`` turns, as their formats have a fixed length.
    """
    draw = _Draws(key, f"drawn|{turn}|{kind}|{entity}")
    free, late = 8 + turn, max(0, turn - SAME_LENGTH_DRAWS)
    if kind in ("surname", "domain"):
        return draw.like(entity, free)
    if kind == "iban":
        signs = entity.replace(" ", "")
        like = iter(signs[:4] + draw.like(signs[4:], 0))
        return _iban("".join(c if c == " " else next(like) for c in entity), key)
    if kind == "secret":
        return draw.like("a" * max(len(entity), 16), turn)
    if kind == "ip" and not late:
        return ".".join(str(draw(256)) for _ in range(4))
    if kind == "hex":
        return "".join(_HEX[entity.upper() == entity][draw(16)] for _ in range(len(entity) + late))
    if kind == "card":
        body = [c for c in entity if c.isdigit()]
        off = int(body[-1]) - _luhn("".join(body[:-1]))
        new = draw.like("".join(body[:-1]), late)
        digits = iter(new + str((_luhn(new) + off) % 10))
        return "".join(next(digits) if c.isdigit() else c for c in entity) + "".join(digits)
    if kind == "phone" and (country := _COUNTRY.match(entity)):
        return country[0] + draw.like(entity[country.end() :], late)
    return draw.like(entity, late)


# --- Spark ------------------------------------------------------------------------------


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's configuration, else one that protects nothing."""
    own = spark.conf.get(KEY_CONF, None)
    if own is None:
        warnings.warn(f"{KEY_CONF} is not set: the surrogates can be undone by anyone", stacklevel=2)
    return own.encode() if own is not None else _OPEN_KEY


def mentions_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row_key, kind, entity) of each part that must not become real, and of the roles of names, once a row; row_key is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, found = [], [], []
            for k, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py()
                for e in {x for a, b, kind in detect(text or "") for x in (*parts_of(kind, text[a:b]), *roles_of(kind, text[a:b])) if x[0] not in UNCHECKED}:
                    keys.append(k.as_py())
                    kinds.append(e[0])
                    found.append(e[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["row_key", "kind", "entity"])

    return docs.select(F.xxhash64(quoted(text_col)).alias("row_key"), quoted(text_col).alias("text")).mapInArrow(tb.frugal(run), "row_key long, kind string, entity string")


def lone_first_names(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of names that stand alone and are first names of the corpus, and no surnames of it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [part_surrogate("first", x, key) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

    names = lambda kind: mentions.filter(F.col("kind") == kind).select("entity").distinct()
    alone = names("lone").join(names("given"), "entity", "left_semi").join(names("last"), "entity", "left_anti")
    return alone.select(F.lit("lone").alias("kind"), "entity").mapInArrow(tb.frugal(step), "kind string, entity string, surrogate string")


def exceptions(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of the parts whose first surrogate is real or another's too.

    Turns from ``MAX_TRIES`` on draw from a keyed digest instead of a permutation.
    """
    spark = mentions.sparkSession
    schema = "kind string, entity string, surrogate string"

    def tried(rows: DataFrame, turn: int) -> DataFrame:
        own = key if not turn else hmac.new(key, f"try {turn}".encode(), hashlib.sha256).digest()

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                new = [part_surrogate(k, s, own) if turn < MAX_TRIES else drawn(k, s, turn - MAX_TRIES, key) for k, s in pairs]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

        return rows.select("kind", "entity").mapInArrow(tb.frugal(step), schema)

    known = written(mentions.filter(~F.col("kind").isin(*ROLES)).select("kind", "entity").distinct(), "entities")
    first = written(tried(known, 0), "surrogates")
    real = known.select("kind", F.col("entity").alias("surrogate"))
    taken = real.union(first.select("kind", "surrogate"))
    shared = first.groupBy("kind", "surrogate").agg(F.min("entity").alias("least"), F.count("*").alias("n")).filter("n > 1")
    second = first.join(shared, ["kind", "surrogate"]).filter("entity <> least").select("kind", "entity")
    left = written(first.join(real, ["kind", "surrogate"], "left_semi").select("kind", "entity").union(second).distinct(), "collisions")
    done = spark.createDataFrame([], schema)
    for turn in count(1):
        if left.isEmpty():
            return done
        now = written(tried(left, turn), "surrogates")
        free = now.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        good = written(free.select("kind", "entity", "surrogate"), "accepted")
        done, taken = done.union(good), taken.union(good.select("kind", "surrogate"))
        left = written(left.join(good, ["kind", "entity"], "left_anti"), "collisions")


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def _rewrite(rows: DataFrame, key: bytes, given: object | None) -> DataFrame:
    """(row, text, pii_n, pii_spans) of rows (row, text, walks): the new text and the places of the surrogates in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = given.value if given is not None else {}
        for batch in batches:
            texts, counts, spans = [], [], []
            walks = batch.column(2).to_pylist()
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                own = common if walks[i] is None else {(w["kind"], w["entity"]): w["surrogate"] for w in walks[i]}
                out, last, mine, size = [], 0, [], 0
                for a, b, kind in detect(text or ""):
                    new = composed(kind, text[a:b], lambda k, x: own.get((k, x)) or (own.get(("surname", x)) if k == "lone" else None) or part_surrogate(k, x, key))  # noqa: B023
                    out += [text[last:a], new]
                    size += a - last
                    mine.append({"kind": kind, "start": size, "end": size + len(new)})
                    size += len(new)
                    last = b
                texts.append("".join([*out, text[last:]]) if mine else text)
                counts.append(len(mine))
                spans.append(mine)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["row", "text", "pii_n", "pii_spans"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]).add("pii_n", T.LongType()).add("pii_spans", T.StructType.fromDDL(f"x {_SPANS}")["x"].dataType)
    return rows.mapInArrow(tb.frugal(run), schema)


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", exception_rows: int = EXCEPTION_ROWS) -> DataFrame:
    """The rows of docs with surrogates in the text, and pii_n and pii_spans."""
    mentions = written(mentions_of(docs, text_col), "mentions")
    walked = written(exceptions(mentions, key).union(lone_first_names(mentions, key)), "exceptions")
    names = [c for c in docs.columns if c.lower() not in ("pii_n", "pii_spans")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[quoted(c) for c in names if c != text_col]).alias("row"), quoted(text_col).alias("text"))
    none = F.lit(None).cast("array<struct<kind: string, entity: string, surrogate: string>>")
    if walked.limit(exception_rows + 1).count() <= exception_rows:
        given = {(r.kind, r.entity): r.surrogate for r in walked.collect()}
        out = _rewrite(rows.withColumn("walks", none), key, docs.sparkSession.sparkContext.broadcast(given))
    else:
        per_row = mentions.join(walked, ["kind", "entity"]).groupBy("row_key").agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias("walks"))
        out = _rewrite(rows.join(per_row, F.xxhash64("text") == F.col("row_key"), "left").select("row", "text", "walks"), key, None)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], "pii_n", "pii_spans")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(table(spark, sf_dir, "documents"), key_of(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"]))), ",")
    return out.select("doc_id", "text", F.col("pii_n").alias("n_entities"), kinds.alias("kinds"), F.col("pii_spans").alias("spans"))
