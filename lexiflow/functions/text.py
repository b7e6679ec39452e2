"""Text functions on columns. Space means the characters of ``SPACES``, Unicode white space as browsers know it."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed value: white space, as the inside of a character class.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters as text.
SPACE_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed value: marks that stand alone after a word.
MARKS = "!?.,;:…"
# Fixed value: marks and quotes that are not read aloud at either end of a word.
SILENT = "!?.,;:…«»\"'“”"


@lru_cache(1)
def letters() -> tuple[str, str]:
    """Characters that have one of a-z or 0-9 below their marks, and these: by lower case and canonical decomposition."""
    found = {}
    for code in range(0x80, 0x30000):
        base = [x for x in unicodedata.normalize("NFD", chr(code).lower()) if x.isascii() and x.isalnum()] if not 0xD800 <= code < 0xE000 else []
        if len(base) == 1:
            found[chr(code)] = base[0]
    return "".join(found), "".join(found.values())


def trimmed(x: Column) -> Column:
    """Without white space at either end; null is empty."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(SPACE_CHARACTERS))


def non_blank(x: Column) -> Column:
    return F.length(trimmed(x)) > 0


def or_default(x: Column, default: Column) -> Column:
    """``default`` where ``x`` is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default)


def _plain_spaces(x: Column) -> Column:
    """White space as plain spaces, one for each character; patterns then need no Unicode class."""
    return F.translate(x, SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))


def tokenize(x: Column) -> Column:
    """Words; tokens of ``MARKS`` only belong to the word before, after one space. A leading one stands alone."""
    found = F.regexp_extract_all(_plain_spaces(F.coalesce(x, F.lit(""))), F.lit(rf"[^ ]+(?: +[{MARKS}]+(?= |\z))*"), F.lit(0))
    return F.transform(found, lambda w: F.when(w.contains("  "), F.regexp_replace(w, " +", " ")).otherwise(w))


def spoken(word: Column) -> Column:
    """The word without silent marks at either end and space there, or the word itself where nothing is left."""
    return or_default(trimmed(F.regexp_replace(word, rf"^[{SILENT}]+|[{SILENT}]+\z", "")), word)


def normalize_word(word: Column) -> Column:
    """Lower case, accents off, only a-z and 0-9 stay; null is empty."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(word, F.lit("")), *letters())), "[^a-z0-9]", "")


def split_space(x: Column) -> Column:
    return F.split(_plain_spaces(x), " +")


def _once(x: Column, make) -> Column:
    """``make`` of ``x``, which is computed once however often ``make`` names it."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def _payload(x: Column) -> Column:
    """What follows ``data:<kind>;base64,`` where it has no line end, else null; found by places, as a pattern walks each character."""
    semi = F.instr(x, ";")
    kind = F.startswith(x, F.lit("data:")) & (semi > 6) & (F.substring(x, semi + 1, F.lit(7)) == "base64,")
    ends = lambda r: r.contains("\n") | r.contains("\r") | r.contains("\u2028") | r.contains("\u2029")
    return F.when(kind, _once(F.substring(x, semi + 8, F.length(x)), lambda r: F.when(~ends(r), r)))


def data_url_mime(x: Column) -> Column:
    return F.when(_payload(x).isNotNull(), F.substring(x, F.lit(6), F.instr(x, ";") - 6))


def data_url_bytes(x: Column) -> Column:
    """Payload of a base64 data URL, null where there is none.

    Decoding is lenient: characters outside of both base64 alphabets are skipped, the first ``=`` ends the payload, and a
    last character that is no whole byte is dropped.
    """
    body = F.regexp_replace(F.substring_index(_payload(x), "=", 1), "[^A-Za-z0-9+/_-]+", "")
    body = F.replace(F.replace(body, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    whole = _once(body, lambda b: F.substring(b, F.lit(1), F.length(b) - F.when(F.length(b) % 4 == 1, 1).otherwise(0)))
    return _once(whole, lambda w: F.unbase64(F.concat(w, F.repeat(F.lit("="), F.pmod(-F.length(w), F.lit(4))))))


def image_extension(url: Column) -> Column:
    """png where the data URL, or its MIME type, says so; else jpg."""
    return F.when(url.rlike("(?i)image/png"), "png").otherwise("jpg")


def is_heic(name: Column, mime: Column) -> Column:
    """A photo format that browsers do not decode, by file name or MIME type."""
    return F.coalesce(name.rlike(r"(?i)\.(heic|heif)\z"), F.lit(False)) | F.coalesce(mime.rlike("(?i)image/hei[cf]"), F.lit(False))


def is_data_image(x: Column) -> Column:
    return F.coalesce(F.startswith(x, F.lit("data:image")), F.lit(False))


def embed_link(url: Column, host: str, prefix: str = "embed/") -> Column:
    """A share link of ``host`` as its embeddable form; other links stay; the query string goes.

    A link that has ``/embed/`` anywhere is embeddable already.
    """
    dotted = host.replace(".", r"\.")
    moved = F.when(url.contains("/" + prefix), url).otherwise(F.regexp_replace(url, f"(?is)^(.*?){dotted}/", _quoted("$1", host + "/" + prefix)))
    return F.when(url.rlike(f"(?i){dotted}"), F.substring_index(moved, "?", 1)).otherwise(url)


def _quoted(start: str, value: str) -> str:
    """A replacement text: ``start`` as it is, then ``value`` literally."""
    return start + value.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(x: Column, pattern: str, value: str) -> Column:
    """The first match of ``pattern`` replaced by ``value``, which is taken literally."""
    return F.regexp_replace(x, f"(?s)^(.*?){pattern}", _quoted("$1", value))


def url_component(x: Column) -> Column:
    """Percent encoding that leaves letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.regexp_replace(F.url_encode(x), r"\+", "%20")
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def fixed(x: Column, digits: int) -> Column:
    """The number with ``digits`` decimals (at most 2), rounded by its exact binary value, ties away from zero.

    The fraction is taken in units of 2^-60 as two 30-bit halves, so nothing is rounded twice. Null for null.
    """
    if not 0 <= digits <= 2:
        raise ValueError("0 to 2 decimals")
    scale, half = 10**digits, 1 << 30
    size = F.abs(x.cast("double"))
    units = ((size - F.floor(size)) * float(1 << 60)).cast("long")
    high = F.shiftright(units, 30) * scale + F.shiftright(F.pmod(units, F.lit(half)) * scale, 30) + half // 2
    parts = F.floor(size) * scale + F.shiftright(high, 30)
    text = parts.cast("string")
    if digits:
        text = F.concat(F.floor(parts / F.lit(scale)).cast("string"), F.lit("."), F.lpad(F.pmod(parts, F.lit(scale)).cast("string"), digits, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def random_id(prefix: str, millis: Column, *seed: Column) -> Column:
    """``prefix-time-letters``: letters are a base-36 number of a hash of ``seed``, so a rerun gives the same id."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *seed)), 1, 12), 16, 10)
    return F.concat_ws("-", F.lit(prefix), millis.cast("string"), F.lower(F.conv(number, 10, 36)))


def key_of(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)
