"""Text functions over Columns. All are null in, null out unless they say otherwise."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brazilian states by their plain-letter names, in the order they are tried.
STATES = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA", "ceara": "CE", "distrito federal": "DF",
    "espirito santo": "ES", "goias": "GO", "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG",
    "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE", "piaui": "PI", "rio de janeiro": "RJ",
    "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO", "roraima": "RR", "santa catarina": "SC",
    "sao paulo": "SP", "sergipe": "SE", "tocantins": "TO",
}
#: How a defect is denied, and told.
NEGATED_DEFECT = r"\b(?:sem|nenhum(?:a)?|nao (?:tem|possui|apresenta))(?: qualquer)? (?:defeitos?|avarias?|problemas?)\b"
DEFECT = r"\b(?:defeitos?|defeituos[oa]s?|nao funciona|quebrad[oa]s?|avariad[oa]s?|para retirar pecas|com problema)\b"
#: Secrets that logs must not hold, and what stands in their place.
SECRETS = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"\bbot\d+:[A-Za-z0-9_-]{20,}\b", "bot[REDACTED]"),
    (r"\b\d+:[A-Za-z0-9_-]{20,}\b", "[REDACTED_TELEGRAM_TOKEN]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED_API_KEY]"),
    (r"(?i)(postgres(?:ql)?://[^:\s/]+:)[^@\s]+@", "$1[REDACTED]@"),
)


@cache
def _plain_letters() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII letter or digit and marks of U+0300 to U+036F."""
    pairs = []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.decomposition(c):
            base = [x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F]
            if len(base) == 1 and base[0].isascii() and base[0].isalnum():
                pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), kept in one place: filters on the result do not repeat its expression, which outgrows a method."""
    return F.transform(F.array(value), use)[0]


def made_once(value: Column) -> Column:
    """value as a generator of one row gives it: no filter or column above works its expression out again, and filters on it
    stay above an exchange below."""
    return F.explode(F.array(value))


def normalize_title(text: Column) -> Column:
    """Accents dropped, lower case, and every run outside a-z and 0-9 one space."""
    accented, plain = _plain_letters()
    bare = F.regexp_replace(F.translate(text, accented, plain), "[\\u0300-\\u036f]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def nullable_text(text: Column) -> Column:
    """White space, the Unicode kinds included, collapsed and trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct words of the normalized text; an empty array for null."""
    return F.filter(F.array_distinct(F.split(normalize_title(F.coalesce(text, F.lit(""))), " ")), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def listing_text(title: Column, description: Column, attributes: Column) -> Column:
    """Normalized title, description and attributes (a map), the words an extraction reads."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return normalize_title(F.concat_ws(" ", title, F.coalesce(description, F.lit("")), F.coalesce(F.array_join(pairs, " "), F.lit(""))))


def includes_term(text: Column, term: Column | str) -> Column:
    """Whether the words of term stand next to each other in the already normalized text."""
    term = normalize_title(F.lit(term) if isinstance(term, str) else term)
    return (F.length(term) > 0) & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def first_term(text: Column, terms: list[str]) -> Column:
    """The first term of the list, in its order, that the normalized text includes."""
    found = lambda padded: F.coalesce(*(F.when(F.contains(padded, F.lit(f" {t} ")), F.lit(t)) for t in terms))
    return once(F.concat(F.lit(" "), text, F.lit(" ")), found)


def contains_defect(text: Column) -> Column:
    """Whether the normalized text tells of a defect, denied ones not counted."""
    return F.regexp_replace(text, NEGATED_DEFECT, "").rlike(DEFECT)


def match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return once(F.regexp_extract(text, pattern, group), lambda found: F.nullif(found, F.lit("")))


def state_of(location: Column) -> Column:
    """Two letters after a comma or hyphen; else the state whose name the location is or ends in."""
    short = F.upper(match(location, r"(?i)[,-]\s*([A-Z]{2})(?![A-Za-z0-9_])"))
    named = lambda plain: F.coalesce(*(F.when((plain == n) | plain.endswith(f" {n}"), F.lit(s)) for n, s in STATES.items()))
    return F.coalesce(short, once(normalize_title(location), named))


def city_of(location: Column) -> Column:
    """The normalized location without the names and letters of states at its end, tried in order."""
    suffixes = F.array(*(F.lit(f" {x}") for n, s in STATES.items() for x in (n, s.lower())))
    cut = lambda city, s: F.when(F.endswith(city, s), F.trim(F.left(city, F.length(city) - F.length(s)))).otherwise(city)
    return F.aggregate(suffixes, normalize_title(location), cut)


def model_signature(model: Column) -> Column:
    """Words of a model name in order of letters, with sizes like 256 gb made one word."""
    joined = F.regexp_replace(normalize_title(model), r"\b(\d+)\s+(gb|tb)\b", "$1$2")
    return F.array_join(F.array_sort(F.filter(F.split(joined, " "), lambda t: t != "")), " ")


def redact(text: Column) -> Column:
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def error_message(text: Column) -> Column:
    """Redacted and at most 2,000 characters."""
    return F.left(redact(text), F.lit(2000))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def truncate(text: Column, most: int, marker: str = "…") -> Column:
    """At most `most` characters, the marker included."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - len(marker))), F.lit(marker)))


def truncate_after(text: Column, most: int, marker: str) -> Column:
    """The first `most` characters, and the marker where more follow."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit(marker)))


def bullets(items: Column, instead: str, shown: int = 5, most: int = 180) -> Column:
    """One line per item, escaped and cut; how many more there are; `instead` for none."""
    items = F.coalesce(items, F.array().cast("array<string>"))
    lines = F.transform(F.slice(items, 1, shown), lambda x: F.concat(F.lit("• "), escape_html(truncate(x, most))))
    more = F.when(F.size(items) > shown, F.array(F.concat(F.lit("• … e mais "), (F.size(items) - shown).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(items) == 0, F.lit(f"• {instead}")).otherwise(F.array_join(F.concat(lines, more), "\n"))


def money(value: Column, currency: Column) -> Column:
    """Brazilian style: R$ 1.234,50 for BRL, other codes in letters, no code bare; n/d for null."""
    cents = F.translate(F.format_number(value, 2), ",.", ".,")
    code = F.upper(F.trim(currency))
    bare = F.when(cents.rlike(",00$"), F.regexp_replace(cents, ",00$", "")).when(cents.rlike(",.0$"), F.regexp_replace(cents, "0$", "")).otherwise(cents)
    return F.when(value.isNull(), "n/d").when(code == "BRL", F.concat(F.lit("R$ "), cents)).when(code.rlike("^[A-Z]{3}$"), F.concat(code, F.lit(" "), cents)).otherwise(bare)
