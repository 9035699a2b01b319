"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = ("llc", "ltd", "inc", "gmbh", "corp", "co", "sro", "spzoo", "тов", "пп", "ооо", "фоп")
SENIORITY = (
    ("senior", ("senior", "sr.", "lead", "principal", "staff")),
    ("middle", ("middle", "mid-level", "mid level")),
    ("junior", ("junior", "jr.", "trainee", "intern")),
)
CURRENCIES = (("$", "USD"), ("€", "EUR"), ("₴", "UAH"), ("£", "GBP"))
UKRAINIAN, RUSSIAN, POLISH = "іїєґІЇЄҐ", "ыэъёЫЭЪЁ", "ąćęłńśźżĄĆĘŁŃŚŹŻ"
NO_EXPERIENCE = ("без досвіду",)
REMOTE_MARKS = ("віддалено",)
MARKUP_MARKS = ("</p>", "</div>", "</ul>", "</ol>", "</li>", "</h", "<br")
# Fixed value: an amount with its currency.
_AMOUNT = r"[$€₴£]\s*[\d.,]+"


def normalize_title(title: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_company(name: Column) -> Column:
    """The same, without words for legal forms."""
    words = F.filter(F.split(normalize_title(name), " "), lambda w: ~w.isin(*LEGAL_SUFFIXES))
    return F.array_join(words, " ")


def collapse(text: Column) -> Column:
    """Runs of blanks to one, three or more line ends to two, trimmed."""
    lines = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    # Most texts end in no blank but spaces. `$` also stands before the last three of these characters.
    blank = [" ", "\t", "\n", "\x0b", "\f", "\r", "\u0085", "\u2028", "\u2029"]
    odd = lambda t: F.left(t, F.lit(1)).isin(*blank) | F.right(t, F.lit(1)).isin(*blank)
    ends = lambda t: F.when(odd(F.trim(t)), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.trim(t))
    return once(once(F.regexp_replace(text, r"[ \t]+", " "), lines), ends)


def block_text(text: Column) -> Column:
    """Non-breaking blanks to blanks, zero-width ones out, runs within a line to one, ends trimmed."""
    plain = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\S\n]+", " "), r"(?U)^\s+|\s+$", "")


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def seniority(title: Column) -> Column:
    low = F.lower(title)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in keys)), F.lit(level)) for level, keys in SENIORITY))


def experience_years(text: Column) -> Column:
    """Null stays null, a phrase for none is 0, else the first whole number; null without one."""
    none = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p)) for p in NO_EXPERIENCE))
    return F.when(none, F.lit(0.0)).otherwise(F.regexp_extract(text, r"(\d+)", 1).try_cast("double"))


def salary(text: Column) -> Column:
    """struct<min, max, currency> from a range, up to, from, or a single amount, whichever is found first in this order."""
    amount = lambda span, k: F.replace(F.try_element_at(F.regexp_extract_all(span, F.lit(r"([\d.,]+)"), F.lit(1)), F.lit(k)), F.lit(","), F.lit("")).try_cast("double")
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    spread = found(_AMOUNT + r"\s*[-–—]\s*[$€₴£]?\s*[\d.,]+")
    upto = found(r"(?iu)(?:до|up to)\s*" + _AMOUNT)
    start = found(r"(?iu)(?:від|from)\s*" + _AMOUNT)
    one = found(_AMOUNT)
    span = F.coalesce(spread, upto, start, one)
    symbol = F.regexp_extract(span, "[$€₴£]", 0)
    currency = F.coalesce(*(F.when(symbol == s, F.lit(c)) for s, c in CURRENCIES))
    low = F.when(spread.isNotNull(), amount(spread, 1)).when(upto.isNotNull(), F.lit(None)).otherwise(amount(F.coalesce(start, one), -1))
    high = F.when(spread.isNotNull(), amount(spread, -1)).when(upto.isNotNull(), amount(upto, -1)).when(start.isNotNull(), F.lit(None)).otherwise(amount(one, -1))
    return F.when(span.isNotNull(), F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"), currency.alias("currency")))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a regular-expression class a text has."""
    # Whole runs of other characters go at once: a replacement for each is what costs.
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def script_profile(text: Column) -> dict[str, Column]:
    """Letters in all, of the Cyrillic block, and Latin ones: ASCII and Polish; other Latin letters count as letters only."""
    return {
        "letters": count_of(text, r"\p{L}"),
        "cyrillic": count_of(text, r"\p{L}&&[Ѐ-ӿ]"),
        "latin": count_of(text, f"A-Za-z{POLISH}"),
        "uk_marks": count_of(text, UKRAINIAN),
        "ru_marks": count_of(text, RUSSIAN),
        "pl_marks": count_of(text, POLISH),
    }


def detect_language(text: Column, least_letters: int = 20, share: float = 0.02) -> Column:
    p = script_profile(text)
    uk, ru = p["uk_marks"] / p["cyrillic"] >= share, p["ru_marks"] / p["cyrillic"] >= share
    cyrillic = F.when(uk & ~ru, "uk").when(ru & ~uk, "ru").when(uk & ru, F.when(p["uk_marks"] >= p["ru_marks"], "uk").otherwise("ru"))
    latin = F.when(p["latin"] > 0, F.when(p["pl_marks"] / p["latin"] >= share, "pl").otherwise("en"))
    return F.when(p["letters"] < least_letters, None).when(p["cyrillic"] > p["latin"], cyrillic).otherwise(latin)


# What contact details and credentials look like. (?U): blanks, digits and word characters of all scripts.
# A look at the first character comes before what is dear to try at every place.
_BOT_TOKEN = r"bot\d{6,}:[A-Za-z0-9_-]{20,}"
_BEARER = r"(?iU)\b(bearer)\s+[A-Za-z0-9._~+/-]{16,}=*"
_QUERY_SECRET = r"(?iU)([?&](?:api[_-]?key|token|secret|access[_-]?token|password)=)[^&\s]+"
_EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
_PHONE = r"(?U)(?=[+0])(?:\+|\b00)\d[\d\s().‐-―-]{6,}\d"
_GROUPED = r"(?U)(?=[(\d])\b\(?\d{2,4}\)?(?:[\s.‐-―-]\d{2,4}){2,3}\b"


def once(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def redact(text: Column, least_digits: int = 9) -> Column:
    """Credentials, then e-mail addresses, then phone numbers to placeholders. Grouped digits need enough of them.

    Each grouped run is judged where it stands: the text is cut at the runs and put together again. A pattern is only
    tried on texts that have a mark which every match of it needs, that of e-mail addresses, which hold no blank, on words.
    """
    has = lambda *marks: lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))
    mail = lambda w: F.when(F.contains(w, F.lit("@")), F.regexp_replace(w, _EMAIL, "[email]")).otherwise(w)
    steps = (
        (has("bot"), lambda t: F.regexp_replace(t, _BOT_TOKEN, "bot[redacted]")),
        (lambda t: F.contains(F.lower(t), F.lit("bearer")), lambda t: F.regexp_replace(t, _BEARER, "$1 [redacted]")),
        (has("="), lambda t: F.regexp_replace(t, _QUERY_SECRET, "$1[redacted]")),
        (has("@"), lambda t: F.array_join(F.transform(F.split(t, " ", -1), mail), " ")),
        (has("+", "00"), lambda t: F.regexp_replace(t, _PHONE, "[phone]")),
        (lambda t: F.rlike(t, F.lit(_GROUPED)), lambda t: _grouped(t, least_digits)),
    )
    gated = lambda gate, step: lambda t: F.when(gate(t), step(t)).otherwise(t)
    return reduce(lambda out, step: once(out, gated(*step)), steps, text)


def _grouped(text: Column, least_digits: int) -> Column:
    runs = F.transform(
        F.regexp_extract_all(text, F.lit(f"({_GROUPED})"), F.lit(1)),
        lambda m: F.when(F.length(F.regexp_replace(m, r"(?U)\D", "")) >= least_digits, F.lit("[phone]")).otherwise(m),
    )
    parts = F.zip_with(F.split(text, _GROUPED, -1), runs, lambda part, run: F.concat(part, F.coalesce(run, F.lit(""))))
    return F.array_join(parts, "")


def preview(text: Column, limit: int = 120) -> Column:
    line = F.trim(F.regexp_replace(redact(text), r"\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit), F.lit("…")))


def find_span(text: Column, needle: Column) -> Column:
    """struct<start, end, quote>: first occurrence without regard to case, in the text's own letters; null if none."""
    both = F.struct(text.alias("text"), needle.alias("needle"), F.lower(text).alias("low"), F.lower(needle).alias("small"))

    def place(p: Column) -> Column:
        same = (F.length(p["low"]) == F.length(p["text"])) & (F.length(p["small"]) == F.length(p["needle"]))
        return F.when(same, F.position(p["small"], p["low"])).otherwise(F.position(p["needle"], p["text"]))

    def span(p: Column, at: Column) -> Column:
        size = F.length(p["needle"])
        found = F.struct((at - 1).alias("start"), (at - 1 + size).alias("end"), F.substring(p["text"], at, size).alias("quote"))
        return F.when((at > 0) & (p["needle"] != ""), found)

    return once(both, lambda p: once(place(p), lambda at: span(p, at)))


def html_escape(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), text)


def round_score(x: Column, digits: int = 1) -> Column:
    """Half up on the binary value, as floor; the same in every engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def cities(text: Column) -> Column:
    """Places of a comma-separated line, trimmed, without blank ones and those with a mark of remote work; null gives none."""
    remote = lambda p: reduce(lambda a, b: a | b, (F.contains(F.lower(p), F.lit(m)) for m in REMOTE_MARKS))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: (p != "") & ~remote(p))


def is_markup(text: Column) -> Column:
    """Whether a stored text is HTML: it has one of the marks."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in MARKUP_MARKS))


def json_flag(raw: Column, path: str) -> Column:
    """Whether a JSON value is the literal true; anything else, or no JSON at all, is false."""
    return F.coalesce(F.get_json_object(raw, path) == "true", F.lit(False))


def fold_distinct(values: Column, separator: str = "; ") -> Column:
    """Non-blank values, the first of each without regard to case, joined."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda v: v.isNotNull() & (v != ""))
    first = lambda all_: lambda v, k: F.array_position(F.transform(all_, F.lower), F.lower(v)) == k + 1
    return F.array_join(once(kept, lambda all_: F.filter(all_, first(all_))), separator)
