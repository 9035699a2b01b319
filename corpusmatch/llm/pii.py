"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

The same entity gets the same surrogate in every document (coreference), different entities different ones
(distinctness). Characters are replaced by a keyed permutation of the strings of the same shape, so two entities of
a shape can't meet; across shapes, and against entities that are really in the corpus, the distinct entities are
checked and those that collide are drawn again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmatch.llm.common import free_name, materialize

# Titles by gender, and given names by gender and script to draw from.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña", "пані"),
    "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Don", "пан"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("f", "latin"): ("Alice", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Marie", "Nora", "Paula", "Sofia", "Vera"),
    ("m", "latin"): ("Adam", "Bruno", "Daniel", "Felix", "Hugo", "Jonas", "Lukas", "Martin", "Oscar", "Peter", "Simon", "Victor"),
    ("n", "latin"): ("Alex", "Andrea", "Charlie", "Jamie", "Kim", "Morgan", "Robin", "Sam", "Taylor"),
    ("f", "cyrillic"): ("Олена", "Ірина", "Марія", "Софія", "Юлія", "Віра"),
    ("m", "cyrillic"): ("Андрій", "Борис", "Іван", "Максим", "Олег", "Петро"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя"),
}
#: Frequent given names, by which a full name is found without a title.
KNOWN_GIVEN = {
    "f": (
        "Alice Amelia Andrea Angela Anna Anne Barbara Brigitte Camille Carmen Carol Caroline Catherine Charlotte Claire Claudia Deborah Diana Dorothy "
        "Elena Elizabeth Emily Emma Eva Fatima Hannah Heike Helen Inés Isabel Jane Jennifer Jessica Joan Julia Karen Katharina Laura Linda Lisa Lucía "
        "Margaret Maria María Marie Martha Mary Michelle Monika Nancy Natalie Nicole Olivia Patricia Petra Rachel Rebecca Ruth Sabine Sandra Sarah "
        "Sophie Stephanie Susan Ursula Олена Ірина Марія Наталія Оксана Ольга Світлана Тетяна Юлія"
    ).split(),
    "m": (
        "Adam Alejandro Andrew Antonio Benjamin Bob Brian Carlos Charles Christian Christopher Daniel David Diego Dieter Edward Eric Felix Fernando "
        "François Frank George Hans Heinrich Henry Jack Jacques James Javier Jean Jens Jeremy John Jonas Jonathan Jorge José Joseph Juan Jürgen Karl "
        "Kevin Klaus Lukas Luis Manuel Martin Matthew Michael Miguel Mohammed Nicolas Oliver Patrick Paul Pedro Peter Philippe Pierre Rainer Richard "
        "Robert Samuel Stefan Steven Thomas Timothy Tobias Uwe William Wolfgang Андрій Богдан Іван Микола Олександр Сергій Тарас Юрій"
    ).split(),
}
_GENDER = {name: gender for gender, names in KNOWN_GIVEN.items() for name in names}
_TITLE = "|".join(t for group in TITLES.values() for t in group)
#: How keys of well-known services begin.
TOKEN_STARTS = r"AKIA|ASIA|AIza|gh[opsru]_|xox[abprs]-|sk-|[prs]k_(?:live|test)_|eyJ"
_CUES = "tel|phone|call|fax|mobile|telefon|tél|teléfono|тел"
_UPPER, _LOWER = "A-ZÀ-ÞА-ЯІЇЄҐ", "a-zß-ÿа-яіїєґ"
_NAME = rf"(?:[A-Z]['’])?[{_UPPER}][{_LOWER}'’]*[{_LOWER}](?:-[{_UPPER}]?[{_LOWER}]+)*"
_WORD = r"[A-ZÀ-Þ][a-zß-ÿ'’-]+"
#: What streets are called, and what stands before a number or a date that tells who someone is.
_STREETS = r"Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Blvd|Court|Square|Terrace"
_PAPERS = r"passport|passeport|reisepass|pasaporte|personalausweis|identity card|id card|driving licen[cs]e|social insurance"
_BIRTH = r"born|date of birth|birth ?date|birthday|dob|geboren|geb\.|né|née|nacid[oa]|fecha de nacimiento"
#: In the order in which they are looked for; a later one can't take what an earlier one has.
PATTERNS = {
    "email": r"[A-Za-zÀ-ÖØ-öø-ÿ0-9._%+-]+@[A-Za-zÀ-ÖØ-öø-ÿ0-9-]+(?:\.[A-Za-zÀ-ÖØ-öø-ÿ0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|bearer)\b[\"']?\s*[=:]?\s*[\"']?)(?P<value>[A-Za-z0-9+/_.-]{16,})",
    "token": rf"(?<![\w-])(?:AKIA|ASIA)[A-Z0-9]{{16}}(?!\w)|(?<![\w-])(?:AIza|gh[opsru]_|xox[abprs]-|sk-)[\w-]{{20,}}|(?<![\w-])[prs]k_(?:live|test)_\w{{16,}}|(?<![\w-])eyJ[\w-]{{10,}}\.[\w-]{{10,}}\.[\w-]*",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "paper": rf"(?i:\b(?:{_PAPERS})\b(?:[ \t]+(?:no|nr|number|is))*\.?[:#]?[ \t]*)(?P<value>[A-Z]{{0,3}}\d{{6,9}}[A-Z]?)(?!\w)",
    "birth": rf"(?i:(?<!\w)(?:{_BIRTH})(?!\w)(?:[ \t]+(?:on|am|le|el|is))?:?[ \t]*)(?P<value>\d{{1,4}}(?P<sep>[./-])\d{{1,2}}(?P=sep)\d{{1,4}})(?!\w|[./-]\d)",
    "address": rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?,? (?:{_WORD} ){{1,3}}(?:{_STREETS})\b|(?<!\w){_WORD}(?:straße|strasse|gasse|allee) \d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<![\w.,-])\d{{1,4}},? (?:rue|avenue|boulevard) (?:de la |de l['’]|du |des |de )?{_WORD}|(?<!\w)(?:Calle|Avenida) (?:de la |del |de )?{_WORD},? \d{{1,4}}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w.,+-])0\d{9,10}(?![\w-]|[.,]\d)",
    "local": rf"(?i:\b(?:{_CUES})\b\.?(?:[ \t]+(?:is|no|nr|number|est|ist|es)\b)*\.?:?[ \t]*)(?P<value>\d(?:[ -]?\d){{5,11}})(?![\w-])",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])",
    "name": rf"\b(?:{_TITLE})\.? (?P<value>{_NAME}(?: {_NAME})?)",
}
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
_HINT = re.compile(rf"[0-9@]|\b(?:{_TITLE})\.? |[Tt]oken|TOKEN|[Ss]ecret|[Pp]assw|[Aa]pi|[Bb]earer|eyJ|k_")
#: Numbers in the form of phones that aren't any: dates, and thousands in groups of three.
_DATES = re.compile(r"(?:19|20)\d\d[ .-](?:0?[1-9]|1[0-2])[ .-]|(?:0?[1-9]|[12]\d|3[01])[ .-](?:0?[1-9]|1[0-2])[ .-](?:19|20)\d\d(?!\d)")
_THOUSANDS = re.compile(r"[1-9]\d{0,2}(?: \d{3}){3,}|[1-9]\d{0,2}(?:\.\d{3}){2,}")
#: What else looks like a phone or a card: two decimal degrees, and numbers of books.
_DEGREES = re.compile(r"(?<![\d.])-?\d{1,3}\.\d{3,},?[ \t]+-?\d{1,3}\.\d{3,}(?![\d.])")
_BOOKS = re.compile(r"97[89][ -]?(?:\d[ -]?){9}\d")
#: A given name that may be followed by a surname.
_PAIR = re.compile(rf"(?<![\w'’-])(?P<given>{_NAME})(?= (?P<last>{_NAME}))")
_PLACES = frozenset(_STREETS.split("|")) | {"University", "Hospital", "Airport", "Station", "College", "School", "Park", "Bridge", "Prize", "Institute"}
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщьюяіїєґ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
_DRAWS = 12
_DAYS = (date(1900, 1, 1).toordinal(), date(2030, 1, 1).toordinal())


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int
    end: int
    text: str
    canon: str
    gender: str = ""


def canonical(kind: str, text: str) -> str:
    """What spellings of the same entity have in common: letters in lower case, numbers without their separators."""
    if kind in ("card", "phone", "ssn", "iban"):
        return ("+" if text.lstrip().startswith("+") else "") + re.sub(r"[^0-9A-Za-z]", "", text).upper()
    if kind == "ip6":
        return str(IPv6Address(text))
    if kind == "birth":
        return _day(text)[0].isoformat()
    return text.lower() if kind == "email" else text


def _day(text: str) -> tuple[date, str] | None:
    """A date and the order of its parts: year first, or else day first unless only a month can come first."""
    parts = [int(p) for p in re.split("[./-]", text)]
    order = "ymd" if len(re.split("[./-]", text)[0]) == 4 else "mdy" if parts[1] > 12 else "dmy"
    by = dict(zip(order, parts, strict=True))
    try:
        found = date(by["y"], by["m"], by["d"])
    except ValueError:
        return None
    return (found, order) if _DAYS[0] <= found.toordinal() < _DAYS[1] else None


def _ip6(text: str) -> bool:
    try:
        return int(IPv6Address(text)) > 1
    except AddressValueError:
        return False


def _luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mentions(text: str) -> list[Mention]:
    """Entities of a whole text from left to right, without overlaps.

    A name is found by its title or a known given name; where it stands again in the text without one, it is found,
    too. Dates, papers' numbers and local phones need a word before them that says what they are. Thousands,
    coordinates, dates and numbers of books aren't taken for phones or cards.
    """
    if not text:
        return []
    pairs = [m for m in _PAIR.finditer(text) if m["given"] in _GENDER and m["last"] not in _PLACES and m["last"] != m["given"]]
    if not pairs and not _HINT.search(text):
        return []
    taken: list[tuple[int, Mention]] = []  # in order, so that only neighbours can overlap
    names: dict[str, str] = {}

    def take(kind: str, start: int, end: int, gender: str = "") -> None:
        at = bisect_left(taken, start, key=lambda t: t[0])
        if (at == 0 or taken[at - 1][1].end <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, Mention(kind, start, end, text[start:end], canonical(kind, text[start:end]), gender)))

    degrees = [m.span() for m in _DEGREES.finditer(text)]
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            group = "value" if "value" in pattern.groupindex else 0
            start, end, value, gender = *m.span(group), m[group], ""
            if kind == "phone":
                before = re.search(r"(?<![\w.])(?:\d{1,3}[ .])+\Z", text[max(0, start - 12) : start])
                number = (before[0] if before else "") + value
                if sum(c.isdigit() for c in value) < 9 or _DATES.match(value) or _THOUSANDS.fullmatch(value) or _THOUSANDS.fullmatch(number):
                    continue
            if kind in ("phone", "card") and any(a < end and start < b for a, b in degrees):
                continue
            if kind == "card" and _BOOKS.fullmatch(value) or kind == "ip6" and not _ip6(value) or kind == "birth" and _day(value) is None:
                continue
            if kind == "secret" and not re.search(r"\d", value):
                continue
            if kind == "name":
                title = m[0].split(" ")[0].rstrip(".")
                gender = next(g for g, group_ in TITLES.items() if title in group_)
                gender = _GENDER.get(value.split(" ")[0], "n") if gender == "n" and " " in value else gender
                if " " in value:
                    names.setdefault(value, gender)
            take("phone" if kind == "local" else kind, start, end, gender)
    for m in pairs:
        name = f"{m['given']} {m['last']}"
        names.setdefault(name, _GENDER[m["given"]])
        take("name", m.start(), m.start() + len(name), _GENDER[m["given"]])
    for name in names:
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
            take("name", *m.span(), "n")
    return [m for _, m in taken]


def _permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of 0 .. size - 1: a Feistel network on the next square, walked until it falls inside."""
    side = 1
    while side * side < size:
        side += side if side < 1 << 20 else side >> 4
    while True:
        a, b = divmod(value, side)
        for turn in range(6):
            mixed = hashlib.blake2b(f"{turn}|{tweak}|{size}|{b}".encode(), key=key, digest_size=16).digest()
            a, b = b, (a + int.from_bytes(mixed, "big")) % side
        value = a * side + b
        if value < size:
            return value


def _recode(text: str, key: bytes, tweak: str) -> str:
    """Permute the strings of the same shape: digits stay digits, letters letters of their alphabet and case."""
    hexadecimal = tweak.startswith(("secret|", "hex|")) and re.fullmatch(r"[0-9a-f]{16,}", text) is not None
    sets = []
    for c in text:
        low = c.lower()
        pool = "0123456789abcdef" if hexadecimal else "0123456789" if c.isascii() and c.isdigit() else next((s for s in _LETTERS if low in s), "")
        sets.append(pool)
    size, value = 1, 0
    for c, pool in zip(text, sets, strict=True):
        if pool:
            size *= len(pool)
            value = value * len(pool) + pool.index(c.lower())
    shape = "".join(str(len(p)) + ("U" if c.isupper() else "") if p else c for c, p in zip(text, sets, strict=True))
    value = _permute(value, size, key, f"{tweak}|{shape}") if size > 1 else value
    out = []
    for c, pool in zip(reversed(text), reversed(sets), strict=True):
        if pool:
            value, k = divmod(value, len(pool))
            c = pool[k].upper() if c.isupper() else pool[k]
        out.append(c)
    return "".join(reversed(out))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


@lru_cache(100_000)
def surrogate(kind: str, canon: str, key: bytes, draw: int, gender: str = "") -> str:
    """Canonical form of the entity's replacement; another for each draw. gender: of a name."""
    tweak = f"{kind}|{draw}"
    if kind == "email":
        local, domain = canon.split("@", 1)
        labels, top = domain.rsplit(".", 1)
        return f"{_recode(local, key, tweak)}@{_recode(labels, key, tweak + '|domain')}.{top}"
    if kind == "ip6":  # the first group stays, and groups of zeros do, so the address keeps its form
        groups = [int(g, 16) for g in IPv6Address(canon).exploded.split(":")]
        drawn = [k for k, g in enumerate(groups) if g and k] or [0]
        value = 0
        for k in drawn:
            value = value * 0xFFFF + groups[k] - 1
        value = _permute(value, 0xFFFF ** len(drawn), key, f"{tweak}|{groups[0]}")
        for k in reversed(drawn):
            value, rest = divmod(value, 0xFFFF)
            groups[k] = rest + 1
        return str(IPv6Address(":".join(f"{g:x}" for g in groups)))
    if kind == "birth":
        day = date.fromisoformat(canon).toordinal() - _DAYS[0]
        return date.fromordinal(_DAYS[0] + _permute(day, _DAYS[1] - _DAYS[0], key, tweak)).isoformat()
    if kind == "address":  # what a street is called stays
        keep = rf"\b(?:{_STREETS})\Z|straße|strasse|gasse|allee|\b(?:rue|avenue|boulevard|Calle|Avenida|de la|de l|du|des|del|de)\b"
        parts = re.split(f"({keep})", canon)
        drawn = _recode("\0".join(parts[::2]), key, f"{tweak}|{'|'.join(parts[1::2])}").split("\0")
        return "".join(w for k, d in enumerate(drawn) for w in (d, *parts[2 * k + 1 : 2 * k + 2]))
    if kind == "ip":
        value = 0
        for part in canon.split("."):
            value = value * 256 + int(part)
        value = _permute(value, 1 << 32, key, tweak)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        body = _recode(canon[:-1], key, tweak)
        if _luhn(canon):
            return next(body + c for c in "0123456789" if _luhn(body + c))
        wrong = [c for c in "0123456789" if not _luhn(body + c)]
        return body + wrong[[c for c in "0123456789" if not _luhn(canon[:-1] + c)].index(canon[-1])]
    if kind == "phone":  # the country and a leading area zero stay, as numbers keep their format
        keep = re.match(r"\+(?:1|7|\d\d)|0|", canon)[0]
        return keep + _recode(canon[len(keep):], key, tweak)
    if kind == "token":
        start = re.match(TOKEN_STARTS, canon)[0]
        return start + _recode(canon[len(start):], key, tweak)
    if kind == "iban":  # the country stays, and check digits are right if they were
        body = _recode(canon[4:], key, tweak)
        off, check = (int(canon[2:4]) - _iban_check(canon[:2], canon[4:])) % 97, _iban_check(canon[:2], body)
        return f"{canon[:2]}{(check + off) % 97 if off else check:02d}{body}"
    if kind == "name":
        name = canon
        given, _, last = name.partition(" ")
        if not last:
            return _recode(given, key, tweak)
        script = "cyrillic" if re.search("[а-яіїєґ]", name.lower()) else "latin"
        pool = GIVEN[gender or "n", script]
        pick = int.from_bytes(hashlib.blake2b(f"{tweak}|{given}".encode(), key=key, digest_size=8).digest(), "big")
        return f"{pool[pick % len(pool)]} {_recode(last, key, tweak + '|' + given)}"
    return _recode(canon, key, tweak)


def render(kind: str, original: str, found: str) -> str:
    """A surrogate in the format of the mention: its separators, and for e-mail its capitals."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(found.lstrip("+"))
        return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in original)
    if kind == "ip6":
        whole = IPv6Address(found).exploded if len(original) == 39 else found
        return whole.upper() if original != original.lower() else whole
    if kind == "birth":
        (order, sep), day = (_day(original)[1], re.search("[./-]", original)[0]), date.fromisoformat(found)
        widths = [len(p) for p in re.split("[./-]", original)]
        return sep.join(str({"y": day.year, "m": day.month, "d": day.day}[c]).zfill(w) for c, w in zip(order, widths, strict=True))
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, found, strict=True))
    return found


def _draw(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, gender, draw) -> with the surrogate of that draw."""
    names = ["kind", "canon", "gender", "draw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            found = [surrogate(k, c, key, d, g) for k, c, g, d in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, "found"])

    return entities.select(*names).mapInArrow(run, "kind string, canon string, gender string, draw int, found string")


def _crowded(entities: DataFrame) -> DataFrame:
    """Entities of which the corpus has over a twentieth of all strings of their shape, such as days of birth.

    There are fewer than 3000 shapes: 102 starts of phones by 20 lengths, 40 forms of papers and one of each other kind.
    """
    kept = F.when(F.col("kind") == "phone", F.regexp_extract("canon", r"^(\+(?:1|7|\d\d)|0|)", 1)).otherwise("")
    rest = F.expr("substr(canon, length(kept) + 1)")
    shaped = entities.where(F.col("kind").isin("phone", "paper", "ssn", "ip", "birth")).withColumn("kept", kept)
    shape = F.when(F.col("kind").isin("ip", "birth"), "").otherwise(F.regexp_replace(F.regexp_replace(rest, "[0-9]", "0"), "[A-Z]", "A"))
    shaped = shaped.withColumn("shape", F.concat("kept", F.lit("|"), shape))
    size = F.when(F.col("kind") == "ip", F.lit(2.0**32)).when(F.col("kind") == "birth", F.lit(float(_DAYS[1] - _DAYS[0])))
    size = size.otherwise(F.pow(F.lit(10.0), F.length(F.regexp_replace(rest, "[^0-9]", ""))) * F.pow(F.lit(26.0), F.length(F.regexp_replace(rest, "[^A-Z]", ""))))
    shapes = shaped.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.max(size).alias("size")).where("20 * n > size")
    return shaped.join(F.broadcast(shapes.select("kind", "shape")), ["kind", "shape"], "left_semi").select(*entities.columns)


def mapping(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, found) for (kind, canon, gender), distinct by kind and canon: no surrogate equals another, nor an entity of the corpus.

    Of those that collide, the one first by canon keeps its surrogate unless it is a real entity; the others draw
    again, against all given out so far. Few are left after a round; if any are after the last, it fails. Where a
    shape's strings are nearly all taken by real entities, none of its own is left to draw: there the first draw
    holds, distinct as it permutes the shape, though it may be another real entity's string.
    """
    crowded = materialize(_crowded(entities), "crowded")
    names = entities.select("kind", F.col("canon").alias("found"), F.lit(1).alias("real"))
    done, open_ = None, entities.withColumn("draw", F.lit(0))
    if not crowded.isEmpty():
        done = materialize(_draw(crowded.withColumn("draw", F.lit(0)), key).select("kind", "canon", "found"), "surrogates")
        open_ = open_.join(crowded, ["kind", "canon"], "left_anti")
    for draw in range(_DRAWS):
        drawn = materialize(_draw(open_, key), "draw")
        used = names if done is None else names.unionByName(done.select("kind", "found", F.lit(1).alias("real")))
        first = drawn.groupBy("kind", "found").agg(F.min("canon").alias("canon")).join(used.distinct(), ["kind", "found"], "left_anti")
        kept = drawn.join(first, ["kind", "found", "canon"], "left_semi").select("kind", "canon", "found")
        done = materialize(kept if done is None else done.unionByName(kept), "surrogates")
        open_ = drawn.join(done, ["kind", "canon"], "left_anti").select("kind", "canon", "gender", F.lit(draw + 1).alias("draw"))
        if open_.isEmpty():
            return done
    raise RuntimeError("surrogates still collide")


def key_of(docs: DataFrame) -> str:
    """`spark.corpusmatch.pii.key` of the session, or else a key that only those who have the original texts can make.

    The latter changes with any document, and all surrogates with it; set the former where runs must agree.
    """
    found = docs.sparkSession.conf.get("spark.corpusmatch.pii.key", None)
    if found:
        return found
    halves = [F.sum(F.xxhash64(F.lit(k), "text").cast("decimal(38,0)")) for k in (1, 2)]
    return hashlib.sha256(repr(tuple(docs.agg(*halves).first())).encode()).hexdigest()


def replace_entities(docs: DataFrame, key: str, hot: int = 200_000) -> DataFrame:
    """The columns of docs with `text` replaced, and n_entities: how many mentions were.

    Entities are found in whole texts; a null text stays null with 0. Repeated rows get the same text; an empty table
    gives no rows. A column of docs named n_entities is replaced; others of any name pass. A name has one surrogate
    whatever its titles; its gender is the one that its titles agree on. Documents without a mention aren't shuffled;
    the others meet the surrogates of their distinct entities by a join on the entity, one row each, so a document
    that names one a thousand times joins once. Entities in `hot` documents or more are joined by a broadcast, if they
    are at most 100 000, so no task gets all documents of one. The key decides all surrogates; without it they can't be
    reversed.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    base = docs.drop("n_entities")
    own = base.columns
    at, new, found_ = (free_name(base, c) for c in ("row", "new", "found"))
    mark = "struct<kind:string,start:int,end:int,text:string,canon:string,gender:string>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32() if n in ("start", "end") else pa.string()) for n in ("kind", "start", "end", "text", "canon", "gender")]))
        for batch in batches:
            found = [[vars(m) for m in mentions(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, found_])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    marked = base.mapInArrow(find, f"{schema}, `{found_}` array<{mark}>").withColumn(at, F.monotonically_increasing_id())
    marked = materialize(marked, "mentions")
    have = marked.where(F.size(F.col(f"`{found_}`")) > 0)
    entity = F.transform(F.col(f"`{found_}`"), lambda m: F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"), m["gender"].alias("gender")))
    each = have.select(F.col(f"`{at}`").alias("row"), F.explode(F.array_distinct(entity)).alias("e"))
    each = materialize(each.select("row", "e.kind", "e.canon", "e.gender"), "each")
    said = F.array_sort(F.array_remove(F.collect_set("gender"), "n"))
    entities = each.groupBy("kind", "canon").agg(F.when(F.size(said) == 1, said[0]).otherwise("n").alias("gender"), F.count("*").alias("n"))
    entities = materialize(entities, "entities")
    table = mapping(entities.drop("n"), secret)
    each = each.select("row", "kind", "canon").distinct()
    often = entities.where(F.col("n") >= hot).select("kind", "canon")
    if 0 < often.count() <= 100_000:
        by = materialize(table.join(F.broadcast(often), ["kind", "canon"], "left_semi"), "often")
        known = each.join(F.broadcast(by), ["kind", "canon"])
        pairs = known.unionByName(each.join(F.broadcast(often), ["kind", "canon"], "left_anti").join(table, ["kind", "canon"]))
    else:
        pairs = each.join(table, ["kind", "canon"])
    pairs = pairs.groupBy("row").agg(F.collect_list(F.struct("kind", "canon", "found")).alias(new)).withColumnRenamed("row", at)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks, given in zip(*(batch.column(c).to_pylist() for c in ("text", found_, new)), strict=True):
                by, upto, parts = {(n["kind"], n["canon"]): n["found"] for n in given}, 0, []
                for m in marks:
                    parts += [text[upto : m["start"]], render(m["kind"], m["text"], by[m["kind"], m["canon"]])]
                    upto = m["end"]
                texts.append("".join([*parts, text[upto:]]))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in own]
            count = pa.array([len(f) for f in batch.column(found_).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, count], [*own, "n_entities"])

    changed = have.join(pairs, at).mapInArrow(put, f"{schema}, n_entities int")
    same = marked.where(F.size(F.col(f"`{found_}`")) == 0).select(*base.columns, F.lit(0).alias("n_entities"))
    return same.unionByName(changed)
