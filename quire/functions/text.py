"""Column functions on text. Lengths and offsets count code points, as Spark's own functions do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"(?U)\s+"
EDGE = r"(?U)^\s+|\s+$"


def token_estimate(text: Column) -> Column:
    """Half of the UTF-8 bytes, rounded up, and two."""
    return (F.ceil(F.octet_length(text) / 2) + 2).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, BLANK, " "))


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def share(text: Column, kind: str, whole: str = r"\p{L}") -> Column:
    """Characters of a class as a part of those of another; 0 if there are none of the latter."""
    keep = lambda k: F.length(F.regexp_replace(text, f"[^{k}]", ""))
    return F.when(keep(whole) > 0, keep(kind) / keep(whole)).otherwise(F.lit(0.0))


def heading_valid(title: Column) -> Column:
    """Titles of divisions: empty, or not all digits, not led by punctuation, at most 30 % of letters in lower case."""
    return (title == "") | (
        ~title.rlike(r"^\d+$") & ~F.substring(title, 1, 1).isin(".", ",", ";", ":", "(", ")") & (share(title, r"\p{Ll}") <= 0.30)
    )


def bare_header(line: Column) -> Column:
    """A line without a page number of 1 to 4 digits at either end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(line), r"^\d{1,4}\s+", ""), r"\s+\d{1,4}$", ""))


def is_upper_header(text: Column) -> Column:
    return F.length(text).between(4, 80) & (share(text, r"\p{Lu}") >= 0.6)


def page_tag(page: Column, text: Column) -> Column:
    tag = F.concat(F.lit("<physical_index_"), page.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag)


def heading_level(code: Column) -> Column:
    """Level of a dotted code: one more than its dots."""
    return (F.length(code) - F.length(F.replace(code, F.lit("."), F.lit(""))) + 1).cast("int")


#: The numerals that outlines use; anything else counts as 1.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}


def roman(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(text)), F.lit(1)).cast("int")


def is_personal(question: Column) -> Column:
    return F.lower(question).rlike(r"(?U)\b(my|mine|me|i|our|we)\b")


def asks_for_sources(question: Column) -> Column:
    """Singular words only."""
    return F.lower(question).rlike(r"\b(reference|bibliography|citation)\b")


def is_complex(question: Column) -> Column:
    """Whether a question asks for more than a fact."""
    return F.lower(question).rlike(r"\b(compare|why|how|across|synthesi|versus)\b")


def match_terms(question: Column, most: int = 16) -> Column:
    """A full-text query of a question's first terms: quoted, any of them."""
    terms = F.slice(F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, most)
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def is_reference_path(heading: Column) -> Column:
    return F.lower(F.coalesce(heading, F.lit(""))).rlike(r"\b(references?|bibliography)\b")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def chunk_key(version: Column, book: Column, source: Column, ordinal: Column) -> Column:
    """20 hex digits that name a chunk."""
    return F.substring(F.sha1(F.concat_ws("|", version, book, source, ordinal.cast("string")).cast("binary")), 1, 20)


def point_id(key: Column) -> Column:
    """The 60-bit number of a chunk's key."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


#: The folders that exported assets lie in.
ASSET_DIRS = ("document_artifacts", "figures")


def local_asset(uri: Column) -> Column:
    """The part of a link from its assets folder on; null for remote links and for paths that climb from there."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.regexp_extract(decoded, rf"(?:^|/)((?:{'|'.join(ASSET_DIRS)})/[^/].*)$", 1)
    return F.when(decoded.rlike("^(?i:https?|data):") | path.rlike(r"(^|/)\.\.(/|$)") | (path == ""), F.lit(None)).otherwise(path)


def quoted_path(path: Column) -> Column:
    """A path as part of a link: everything escaped but letters, digits, _.-~ and slashes."""
    escaped = F.url_encode(path)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        escaped = F.replace(escaped, F.lit(code), F.lit(plain))
    return escaped


def portable_links(markdown: Column) -> Column:
    """Markdown whose image links to exported assets are relative; other links stay."""
    image = r"(?s)^(!\[[^\]]*\]\()([^)]*)(\).*)$"

    def renew(piece: Column) -> Column:
        target = quoted_path(local_asset(F.regexp_extract(piece, image, 2)))
        return F.when(piece.rlike(image) & target.isNotNull(), F.concat(F.regexp_extract(piece, image, 1), target, F.regexp_extract(piece, image, 3))).otherwise(piece)

    return F.array_join(F.transform(F.split(markdown, r"(?=!\[[^\]]*\]\([^)]*\))"), renew), "")


def portable_uris(document: Column) -> Column:
    """A JSON text whose "uri" values that lead to exported assets are relative; other values stay."""
    uri = r'(?s)^("uri"\s*:\s*")([^"]*)(".*)$'

    def renew(piece: Column) -> Column:
        value = F.regexp_extract(piece, uri, 2)
        target = F.when(value.contains(ASSET_DIRS[0]), local_asset(value))
        return F.when(piece.rlike(uri) & target.isNotNull(), F.concat(F.regexp_extract(piece, uri, 1), target, F.regexp_extract(piece, uri, 3))).otherwise(piece)

    return F.array_join(F.transform(F.split(document, r'(?="uri"\s*:)'), renew), "")


@F.pandas_udf(StringType())
def ascii_name(names: pd.Series) -> pd.Series:
    """Names in ASCII, by compatible decomposition, for which Spark has no function."""
    return names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(name: Column, file: Column) -> Column:
    """Letters and digits of an ASCII name joined by dashes (65 characters at most), and 8 digits of the file name's hash."""
    bare = F.left(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(65))
    return F.concat(F.when(bare == "", "book").otherwise(bare), F.lit("-"), F.left(F.sha2(file.cast("binary"), 256), F.lit(8)))
