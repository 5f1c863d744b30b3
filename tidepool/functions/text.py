"""Scalar text functions as Columns: normal forms, n-grams, hashes, small parsers. No Python runs per row.

Lengths and positions count code points, as Spark does. A null argument gives null unless said otherwise.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a.
FNV_START, FNV_PRIME = 2166136261, 16777619
#: The video id codec (alphabet, positions of the six digits, the two constants).
ID_ALPHABET = "fZodR9XQDSUm21yCkr6zBqiveYah8bt4xsWpHnJE7jL5VG3guMTKNPAwcF"
ID_POSITIONS = (11, 10, 3, 8, 4, 6)
ID_XOR, ID_ADD = 177451812, 8728348608


def normalize(c: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def compact(c: Column) -> Column:
    """Without white space of any kind."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def is_laugh(c: Column, chars: str) -> Column:
    """At least two characters besides white space, all from `chars`."""
    return compact(c).rlike(f"^[{_class(chars)}]{{2,}}$")


def _class(chars: str) -> str:
    return "".join("\\" + x if x in r"\]^-[&" else x for x in chars)


def grams(c: Column, n: int) -> Column:
    """All substrings of n characters, in order."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def bigrams_of(c: Column, keep: str = r"\p{IsHan}") -> Column:
    """Adjacent pairs among the characters of the class `keep`: pairs bridge what is left out."""
    return grams(F.regexp_replace(c, f"[^{keep}]", ""), 2)


def stable_hash(c: Column) -> Column:
    """32-bit FNV-1a over code points, as a long."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(FNV_START).cast("long"), lambda v, x: (v.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def feature_buckets(c: Column, n_features: int = 1 << 15) -> Column:
    """Distinct hashed character uni-, bi- and trigrams of the compact text.

    The hash of a gram goes on from the hash of the gram without its last character, so each gram costs one step.
    """
    points = F.transform(F.filter(F.split(compact(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda v, x: (v.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    longer = lambda h, n: F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(points) - n + 1, F.lit(0))), F.slice(points, F.lit(n), F.greatest(F.size(points) - n + 1, F.lit(0))), step)
    one = F.transform(points, lambda x: step(F.lit(FNV_START).cast("long"), x))
    two = longer(one, 2)
    return F.array_distinct(F.transform(F.concat(one, two, longer(two, 3)), lambda h: h % n_features))


def unescape(c: Column, references: dict[str, str] | None = None) -> Column:
    """Character references resolved, each once: named ones of HTML 5 (with or without the semicolon, where that is a name too),
    decimal and hexadecimal ones. Numbers that are no character become U+FFFD; 128 to 159 are read as windows-1252.

    references: only these, as they are written, with what they stand for.
    """
    if references is not None:
        known = F.from_json(F.lit(json.dumps(references)), "map<string,string>")
        parts = F.regexp_extract_all(c, F.lit("|".join(f"\\Q{r}\\E" for r in sorted(references, key=len, reverse=True)) + "|[^&]+|&"), F.lit(0))
        return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")).otherwise(c)
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = F.from_json(F.lit(json.dumps({str(i): bytes([i]).decode("cp1252", "replace") for i in range(128, 160)})), "map<string,string>")

    def resolved(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", 1)
        number = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+)", 1)).try_cast("long")
        bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        letter = F.when(bad, "\ufffd").otherwise(F.coalesce(F.try_element_at(old, number.cast("string")), point))
        name = F.try_element_at(named, F.substring(x, 2, 64))
        return F.when(~x.startswith("&"), x).when(x.rlike("^&#(?:[xX][0-9a-fA-F]|[0-9])"), letter).otherwise(F.coalesce(name, x))

    parts = F.regexp_extract_all(c, F.lit("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, resolved), "")).otherwise(c)


def clean_title(c: Column, references: dict[str, str] | None = None, blank: str = r"\s") -> Column:
    """Without tags, entities resolved (all, or those of `references`), trimmed of the class `blank`; null is empty."""
    return F.regexp_replace(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), references), f"(?U)^{blank}+|{blank}+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def excerpt(c: Column, n: int = 180) -> Column:
    return F.substring(squeezed(c), 1, n)


def count_text(c: Column) -> Column:
    """Counts as pages write them: "1,234" and, in ten thousands, "1.2万"; anything else is 0."""
    x = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    wan = x.substr(F.lit(1), F.length(x) - 1).try_cast("double") * 10000
    return F.coalesce(F.when(x.endswith("万"), wan.cast("long")).otherwise(x.try_cast("double").cast("long")), F.lit(0).cast("long"))


def norm_title(c: Column, prefix: str, boiler: list[str]) -> Column:
    """Without a leading marker, boiler words, white space and quotes; a full-width plus becomes a plain one."""
    x = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), prefix, "")
    for word in boiler:
        x = F.replace(x, F.lit(word), F.lit(""))
    return F.translate(F.regexp_replace(x, r"(?U)\s+", ""), "＋“”\"", "+")


def remainder(c: Column, keys: Column) -> Column:
    """c without any key, longer keys first."""
    ordered = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, c, lambda s, k: F.when(k == "", s).otherwise(F.replace(s, k, F.lit(""))))


def short_keys(title: Column, marks: list[str], stop: list[str], keep: str = r"\p{IsHan}", low: int = 2, high: int = 4, most: int = 4) -> Column:
    """Pieces of a title between ask-marks and characters outside `keep`: of low to high characters, not in the stop list, the first few."""
    parts = F.split(title, "|".join([*marks, f"[^{keep}]+"]))
    fit = F.filter(parts, lambda p: (F.length(p) >= low) & (F.length(p) <= high) & ~p.isin(*(stop or [""])))
    return F.slice(F.array_distinct(fit), 1, most)


def maximal_keys(text: Column, lexicon: list[str], most: int = 12) -> Column:
    """Lexicon words that occur in the text and in no other word that does, in the lexicon's order."""
    hits = F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(text, w))
    return F.slice(F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o != h) & F.contains(o, h))), 1, most)


def lead_in(a: Column, b: Column) -> Column:
    """Whether an end of one, of 2 characters or more but less than the shorter, begins the other."""
    width = F.least(F.length(a), F.length(b))
    meets = F.exists(F.sequence(F.lit(2), width - 1), lambda k: (F.right(a, k) == F.left(b, k)) | (F.right(b, k) == F.left(a, k)))
    return F.when(width > 2, meets).otherwise(False)


def overlaps_key(piece: Column, keys: Column) -> Column:
    """Whether any two adjacent characters of a key occur in the piece (a longer common part has such a pair)."""
    pairs = F.flatten(F.transform(keys, lambda k: grams(k, 2)))
    return F.exists(pairs, lambda g: F.contains(piece, g))


def percent_label(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def place_label(start: Column, end: Column) -> Column:
    """A point, or a span from one to another."""
    a, b = percent_label(start), percent_label(end)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


#: An address: a local part, and labels joined by dots, the last of letters.
EMAIL = r"[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


def emails(c: Column, most: int = 6) -> Column:
    return F.slice(F.array_sort(F.array_distinct(found(c, EMAIL))), 1, most)


def contacts(c: Column, phone: str, organiser_labels: list[str], organiser: str, number_labels: list[str], number: str, most: int = 4) -> Column:
    """struct<emails, phones, numbers, organisers>: addresses sorted, all else in order, each once; patterns and labels are yours."""
    once = lambda x: F.slice(F.array_distinct(F.transform(x, lambda v: F.trim(v))), 1, most)
    label = lambda labels, value: found(c, f"(?:{'|'.join(labels)})[：:]\\s*({value})", 1)
    return F.struct(emails(c).alias("emails"), once(found(c, phone)).alias("phones"), once(label(number_labels, number)).alias("numbers"), once(label(organiser_labels, organiser)).alias("organisers"))


def labelled(c: Column, labels: list[str], value: str, most: int = 4) -> Column:
    """Trimmed values after a label and a colon, in order."""
    return F.slice(F.transform(found(c, f"(?:{'|'.join(labels)})[：:]\\s*({value})", 1), lambda x: F.trim(x)), 1, most)


def headings(c: Column, pattern: str) -> Column:
    """Distinct matches of the pattern's first group, in order, trimmed."""
    return F.array_distinct(F.transform(found(c, pattern, 1), lambda x: F.trim(x)))


def url_path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def post_number(c: Column, pattern: str = r"/(\d+)\.html$") -> Column:
    """The number of a post in a URL's path, or null."""
    return F.nullif(F.regexp_extract(url_path(c), pattern, 1), F.lit("")).cast("long")


def is_internal(c: Column, hosts: list[str]) -> Column:
    """A post of one of the hosts, or of no host."""
    return ((url_host(c) == "") | url_host(c).isin(*hosts)) & post_number(c).isNotNull()


#: Kinds of files that count as assets.
ASSET_KINDS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z")


def is_asset(c: Column, kinds: tuple[str, ...] = ASSET_KINDS) -> Column:
    return url_path(c).rlike(f"(?i)\\.({'|'.join(kinds)})$")


def file_name(c: Column) -> Column:
    """A safe name: the last part of the path, decoded, odd characters as underscores."""
    last = F.try_url_decode(F.regexp_extract(url_path(c), "([^/]*)$", 1))
    return F.regexp_replace(last, r'[\\/:*?"<>|]', "_")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")


def absolute(base: Column, href: Column) -> Column:
    """href against base (RFC 3986, section 5.2): absolute, scheme-relative, rooted, relative, query and fragment references; "." and
    ".." segments are resolved, empty ones within a merged path dropped."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda c, g: F.regexp_extract(c, pattern, g)
    path, folder = part(href, 3), F.regexp_extract(part(base, 3), "^(.*/)", 1)
    rooted = path.startswith("/")
    segments = F.split(F.when(rooted, F.substring(path, 2, 1 << 20)).otherwise(F.concat(F.regexp_replace(folder, "^/", ""), path)), "/", -1)
    last = F.element_at(segments, -1)
    inner = F.slice(segments, F.lit(1), F.size(segments) - 1)
    inner = F.when(rooted, inner).otherwise(F.filter(inner, lambda x: x != ""))
    none = F.array().cast("array<string>")
    up = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.concat(inner, F.array(last)), none, up)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    merged = F.concat(F.lit("/"), F.array_join(kept, "/"))
    root = F.concat(F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?", 0), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)", 1))
    whole_base = F.regexp_extract(base, "^[^#]*", 0)
    same = F.when(part(href, 4) != "", F.concat(root, part(base, 3), part(href, 4), part(href, 5))).when(part(href, 5) != "", F.concat(whole_base, part(href, 5))).otherwise(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(path == "", same).otherwise(F.concat(root, merged, part(href, 4), part(href, 5)))


def video_number(c: Column) -> Column:
    """The number that a video id stands for: six base-58 digits at fixed places, less a constant, xor another."""
    letters = F.array(*map(F.lit, ID_ALPHABET))
    digits = [(F.array_position(letters, F.substring(c, at + 1, 1)) - 1) * 58**i for i, at in enumerate(ID_POSITIONS)]
    return (sum(digits[1:], digits[0]) - F.lit(ID_ADD)).bitwiseXOR(F.lit(ID_XOR).cast("long"))
