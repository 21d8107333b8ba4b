"""Text functions as columns: folding, tokens, hashes, display forms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Tokens of two characters or more that are not all ASCII digits.
KEYWORD = r"(?![0-9]++(?![\p{L}\p{N}]))[\p{L}\p{N}]{2,}"

#: Letters of which the index keeps another form, beyond what decomposition gives.
SYMBOL_LETTERS = {
    "µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ",
    "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε",
}
#: Letters whose marks the index keeps although they decompose to an ASCII letter.
KEPT_LETTERS = {"ǡ"}


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """Lower-case letters and what the index folds each to, as the two arguments of ``translate``.

    A letter that decomposes to one ASCII letter and combining marks becomes that letter.
    """
    pairs = dict(SYMBOL_LETTERS)
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if unicodedata.category(c)[0] != "L" or c.lower() != c or c in KEPT_LETTERS:
            continue
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without accents, as the index has it; other scripts keep their letters. Of ASCII texts, lower case is all."""
    old, new = fold_tables()
    whole = F.regexp_replace(F.translate(F.lower(text), old, new), r"\p{Mn}", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(whole)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased: what keywords and highlights use. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def keyword_tokens(text: Column) -> Column:
    """The tokens that keyword statistics count."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEYWORD), 0)


def index_tokens(text: Column) -> Column:
    """Tokens of the folded text: what the index and its queries use."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def fallback_words(text: Column) -> Column:
    """Words of a typed query: runs of ASCII letters and digits, and single Han characters."""
    return F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(r"[A-Za-z0-9]+|\p{IsHan}"), 0)


_TYPED = regex.compile(r"[A-Za-z0-9]+|\p{IsHan}")


def typed_words(text: str) -> list[str]:
    """``fallback_words`` of one typed text, in the driver."""
    return _TYPED.findall(text.strip().lower())


def normalized_keyword(term: Column) -> Column:
    """Trimmed and lower-cased; empty unless it has a letter or digit."""
    plain = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    return F.when(plain.rlike(r"[\p{L}\p{N}]"), plain).otherwise(F.lit(""))


def normalized_hash(text: Column) -> Column:
    """What identifies a hash: without a leading address scheme, ASCII letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?is)^.*urn:btih:", ""), "[^a-zA-Z0-9]", ""))


def is_hash(text: Column) -> Column:
    """40 hexadecimal digits, alone, after an address scheme or after ``hash``."""
    return F.lower(F.trim(text)).rlike(r"(?s)^(.*urn:btih:|hash)?[a-f0-9]{40}$")


def extension(name: Column) -> Column:
    """Lower-case characters after the last dot, which is neither the first nor the last character; else empty."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


#: File classes by extension, in display order; all others are ``other``.
CATEGORIES = {
    "video": "mp4 mkv avi mov wmv flv rmvb rm ts m2ts mts mpg mpeg mpe m2v m1v mpv vob webm m4v 3gp asf f4v ogv divx mxf",
    "audio": "mp3 flac wav aac m4a ogg oga wma ape opus alac aiff aif ac3 dts mka mid midi amr ra wv tak tta",
    "image": "jpg jpeg jpe png gif bmp webp tif tiff svg ico heic heif avif jfif psd raw cr2 cr3 nef arw dng orf rw2 pef srw tga ppm pgm pbm xcf",
    "archive": "zip rar 7z tar gz tgz bz2 tbz xz txz zst cab arj lzh ace iso img lz lzma z br r00 r01 001 002 gzip",
}
CATEGORY_ORDER = (*CATEGORIES, "other")


def category(name: Column) -> Column:
    ext = extension(name)
    out = F.lit("other")
    for label, known in reversed(CATEGORIES.items()):
        out = F.when(ext.isin(*known.split()), F.lit(label)).otherwise(out)
    return out


def category_rank(label: Column) -> Column:
    """Place of a class in the display order."""
    return F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), label)


#: Size classes in bytes, lower bounds included.
SIZE_BUCKETS = (("<100MB", 100 << 20), ("100MB-1GB", 1 << 30), ("1GB-10GB", 10 << 30), ("10GB-100GB", 100 << 30))


def size_bucket(size: Column, buckets: tuple[tuple[str, int], ...] = SIZE_BUCKETS, last: str = ">100GB") -> Column:
    """Label of the first class whose upper bound the size is below."""
    out = F.lit(last)
    for label, bound in reversed(buckets):
        out = F.when(size < bound, F.lit(label)).otherwise(out)
    return F.when(size.isNotNull(), out)


def _rounded(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def format_bytes(size: Column) -> Column:
    """Bytes with a binary unit, two decimals above bytes; ``-`` for null or negative."""
    value = size.cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.concat(_rounded(value / 1024.0**4, 2), F.lit(" TB"))
    for i in reversed(range(4)):
        shown = _rounded(value / 1024.0**i, 2 if i else 0)
        out = F.when(value < 1024.0 ** (i + 1), F.concat(shown, F.lit(" " + units[i]))).otherwise(out)
    return F.when(value >= 0, out).otherwise(F.lit("-"))


def format_date(millis: Column) -> Column:
    """Epoch milliseconds as date and minute in the session's zone; ``-`` for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm"), F.lit("-"))


def format_count(n: Column) -> Column:
    """An integer with thousands separators; 0 for null."""
    return F.format_number(F.coalesce(n.cast("long"), F.lit(0)), 0)


def format_countdown(millis: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; ``-`` for null or negative."""
    s = F.round(millis / 1000.0).cast("long")
    parts = [F.format_string("%d", F.floor(s / 3600)), F.format_string("%02d", F.floor(s % 3600 / 60)), F.format_string("%02d", s % 60)]
    return F.when(millis >= 0, F.when(s >= 3600, F.concat_ws(":", *parts)).otherwise(F.concat_ws(":", *parts[1:]))).otherwise(F.lit("-"))


def thunder_link(uri: Column) -> Column:
    return F.when(F.coalesce(uri, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("thunder://"), F.base64(F.encode(F.concat(F.lit("AA"), uri, F.lit("ZZ")), "UTF-8"))))


_OPEN, _CLOSE = "\ue000", "\ue001"  # private use: escaping makes neither


def _quoted(token: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in token)


def highlight(text: Column, words: list[str]) -> Column:
    """HTML-escaped text with the words (any case) inside ``<mark>``. Hits are found before escaping."""
    out = F.coalesce(text, F.lit(""))
    if words:
        out = F.regexp_replace(out, "(?iu)(" + "|".join(map(_quoted, words)) + ")", _OPEN + "$1" + _CLOSE)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (_OPEN, "<mark>"), (_CLOSE, "</mark>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def match_score(name: Column, words: list[str]) -> Column:
    """How many of the words (lower-case) the name contains."""
    low = F.lower(name)
    return sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs compare as numbers: they are padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")
