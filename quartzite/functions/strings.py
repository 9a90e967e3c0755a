"""What a string literal looks like: escapes, identifiers, paths, queries, patterns, and what is left: perhaps a secret."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartzite.functions import scalars as S

#: Alphabets of encodings, words of queries, types of media, names of headers.
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ybndrfg8ejkmcpqxot1uwisza345h769",
    "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
)
SQL_WORDS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "WHERE ", " LIKE ", "LOWER(", "UPPER(", "COALESCE(", "CONCAT(", "TRIM(", "ORDER BY", "GROUP BY", "JOIN ", "FROM ")
MEDIA = ("application/", "text/", "image/", "audio/", "video/", "multipart/", "font/", "model/", "message/")
HEADERS = ("content-type", "content-disposition", "authorization", "cache-control", "accept-encoding", "x-requested-with", "access-control-allow")
#: Files whose strings are no secrets of their own.
UNREAD_PATHS = r"(?i)\.lock$|-lock\.|\.ya?ml$|/(i18n|locales|lang|translations)/|\.pot?$"
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\0": "\0", "\\\\": "\\", '\\"': '"', "\\'": "'"}


def unescape(text: Column) -> Column:
    """The escapes of line ends, tabs, zero, backslash and quotes resolved, from left to right; others stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    known = F.create_map(*(F.lit(x) for pair in _ESCAPES.items() for x in pair))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(known, p), p)), "")


def unquoted(text: Column) -> Column:
    """A literal without its prefix (b, r, br, rb) and its quotes."""
    body = F.regexp_replace(text, "^(br|rb|b|r)(?=[\"'`])", "")
    return F.when(body.rlike("(?s)^([\"'`]).*\\1$") & (F.length(body) >= 2), F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)


def percent_decoded(text: Column) -> Column:
    """``%XX`` resolved; malformed escapes stay, and so does the whole where the bytes aren't UTF-8."""
    parts = F.regexp_extract_all(text, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    codes = F.transform(parts, lambda p: F.when(p.rlike("^%.."), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    out = F.unhex(F.array_join(codes, "")).cast("string")
    return F.when(F.is_valid_utf8(out), out).otherwise(text)


def is_alphabet(text: Column) -> Column:
    return text.isin(*ALPHABETS)


def is_location(text: Column) -> Column:
    """A URL, a path, or an integrity hash."""
    return text.contains("://") | text.rlike(r"^(data:|/|\./|\.\./|@|urn:|sha(1|256|384|512)-)") | (text.contains("/") & text.contains(".")) | text.rlike("/.*/")


def is_query(text: Column) -> Column:
    """Words of SQL, or a chain of method calls under a namespace."""
    upper = F.upper(text)
    words = reduce(lambda a, b: a | b, (upper.contains(w) for w in SQL_WORDS))
    return words | (text.contains("::") & (text.contains(".(") | (text.contains(".") & text.contains("(") & text.contains(")"))))


def is_pattern(text: Column) -> Column:
    """A regular expression: a class escape and an operator."""
    return text.rlike(r"\\[sSdDwWbB]") & text.rlike(r"[\^$()?*+|]")


def is_media_or_header(text: Column) -> Column:
    lower = F.lower(text)
    return lower.rlike("^(" + "|".join(MEDIA) + ")") | reduce(lambda a, b: a | b, (lower.contains(h) for h in HEADERS))


def is_template(text: Column) -> Column:
    """A placeholder in braces."""
    return text.rlike(r"\{[\p{L}\p{N}_:.?#<>^+-]*\}")


def is_compound_name(text: Column) -> Column:
    """Words of at most 15 letters and digits, none of which mixes cases and digits, joined by marks."""
    parts = F.filter(F.split(text, r"[-_:.,\[\]/@*]"), lambda p: p != "")
    word = lambda p: p.rlike("^[A-Za-z0-9]{1,15}$") & ~(p.rlike("[0-9]") & p.rlike("[A-Z]") & p.rlike("[a-z]"))
    return (F.size(parts) >= 2) & F.forall(parts, word)


def is_style(text: Column) -> Column:
    """A style variable, or a utility class with a value of its own."""
    return (text.startswith("var(--") & text.endswith(")")) | (text.contains("[") & text.contains("]") & text.rlike(r"^[A-Za-z0-9\[\]\-_:./%#(),&*!='\"+]*$"))


def could_be_secret(text: Column, bits: float = 3.5, length: int = 20) -> Column:
    """An unescaped literal of high entropy that is nothing else that's known."""
    plain = (F.octet_length(text) >= length) & text.rlike("^[\\x00-\\x7f]*$") & ~text.rlike(r"\s")
    known = S.is_hex_digest(text) | S.is_uuid(text) | is_location(text) | is_template(text) | is_compound_name(text) | is_style(text) | is_alphabet(text) | is_query(text) | is_media_or_header(text) | is_pattern(text)
    return plain & ~known & text.rlike(r"[0-9]|[^A-Za-z0-9_\-:.,/@()=]") & (S.entropy(text) >= bits)


def is_rule_id(text: Column) -> Column:
    return text.rlike("^[a-z0-9-]+:[a-z0-9-]+$")


def in_module(specifier: Column, module: Column) -> Column:
    """A module itself, or what is inside it by any of the separators."""
    inside = lambda sep: specifier.startswith(F.concat(module, F.lit(sep)))
    return (specifier == module) | inside("/") | inside(".") | inside("::")


def impact(issue_type: Column, severity: Column) -> tuple[Column, Column]:
    """The quality that an issue bears on and how hard."""
    quality = S.lookup(issue_type, {"Bug": "Reliability", "Vulnerability": "Security", "CodeSmell": "Maintainability"})
    return quality, S.lookup(severity, {"Info": "Info", "Minor": "Low", "Major": "Medium", "Critical": "High", "Blocker": "Blocker"})


def fingerprint(rule_id: Column, path: Column, message: Column) -> Column:
    """What an issue is known by across analyses, wherever its line moves."""
    return F.xxhash64(rule_id, path, message)
