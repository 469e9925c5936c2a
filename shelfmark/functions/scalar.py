"""Column expressions of the catalogue's scalar rules. Arrow functions only where Unicode needs them, with a native way for ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema as S


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def search_text_key(text: Column) -> Column:
    """NFKC and full case folding; diacritics stay. ASCII texts are folded natively, only others are sent to Python."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(_folded(F.when(~is_ascii(text), text)))


def ascii_search_key(text: Column) -> Column:
    """search_text_key of texts known to be ASCII."""
    return F.lower(text)


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def normalize_search_terms(text: str) -> tuple[str, ...]:
    """Sorted distinct folded terms; an error if there are none, or the text is too long or holds NUL."""
    text.encode("utf-8")
    if "\0" in text or len(text) > S.MAX_TERM_LENGTH:
        raise ValueError("invalid search text")
    terms = tuple(sorted(set(fold(text.strip()).split())))
    if not terms:
        raise ValueError("empty search text")
    return terms


#: Zeros of all scripts.
_ZEROS = "".join(chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), None) == 0)
#: The root collation at its first level: letters without case, marks and width, contractions and expansions as it has them.
LOOSE = "UNICODE_CI_AI"


def natural_name_key(name: Column) -> Column:
    """The sort key of a name: collated loosely, digit runs by value, in any script.

    Runs become a zero, their length in four digits, and their digits without leading zeros: digits of all scripts weigh
    what they count and come before letters, so such texts compare as their numbers do. The key is a text of the collation
    LOOSE: Spark compares, sorts and groups it by its weights. Names that differ in case, marks, width or leading zeros
    alone have equal keys; a sort goes on by the name itself.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{Nd}+|\P{Nd}+)"), F.lit(1))

    def one(run: Column) -> Column:
        digits = F.regexp_replace(run, f"^[{_ZEROS}]+(?=.)", "")
        return F.when(run.rlike(r"^\p{Nd}"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, one), ""), LOOSE)


@F.pandas_udf(T.StringType())
def natural_name_key_any(name: pd.Series) -> pd.Series:
    """natural_name_key of any text: compatibility forms, no combining marks, case folded."""
    import re

    def one(s):
        if s is None:
            return None
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
        return re.sub(r"[0-9]+", lambda m: f"0{len(m[0].lstrip('0') or '0'):04d}{m[0].lstrip('0') or '0'}", s)

    return name.map(one)


def valid_path(path: str) -> bool:
    """A relative path of plain components, however often it is percent-decoded."""
    if path == "":
        return True
    if "\0" in path or "\\" in path:
        return False
    return all(_plain(part) for part in path.split("/"))


def _plain(part: str) -> bool:
    data = part.encode("utf-8", "surrogatepass")
    while True:
        try:
            view = data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        if view in ("", ".", "..") or any(c in view for c in "\0/\\"):
            return False
        again = _percent_decoded(data)
        if again == data:
            return True
        data = again


def _percent_decoded(data: bytes) -> bytes:
    import re

    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data)


@F.pandas_udf(T.BooleanType())
def _valid_path(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else valid_path(p))


def is_valid_path(path: Column) -> Column:
    """Whether a path is relative and plain however often it is decoded; only paths with percent signs are sent to Python."""
    return F.when(path.contains("%"), _valid_path(F.when(path.contains("%"), path))).otherwise(is_valid_plain_path(path))


def is_valid_plain_path(path: Column) -> Column:
    """is_valid_path of paths without percent signs, natively."""
    parts = F.split(path, "/", -1)
    return (path == "") | (~path.contains("\\") & ~path.contains("\0") & F.forall(parts, lambda p: ~p.isin("", ".", "..")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def directory_path(path: Column, name: Column) -> Column:
    """Of an asset: empty if its path is its name, else the path without the name."""
    return F.when(F.length(path) == F.length(name), F.lit("")).otherwise(F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1))


def path_ancestors(path: Column) -> Column:
    """The path and all above it, the root last to come first: '', 'a', 'a/b'."""
    parts = F.split(path, "/", -1)
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def classify_path(path: Column) -> Column:
    """(kind, format, mime) of a path, null if its extension isn't known."""
    known = F.create_map(*[x for ext, (k, f, m) in S.FORMATS.items() for x in (F.lit(ext), F.struct(F.lit(k).alias("kind"), F.lit(f).alias("format"), F.lit(m).alias("mime")))])
    return known[extension(path)]


def is_system_directory(name: Column) -> Column:
    return F.lower(name).isin(*S.SYSTEM_DIRECTORIES)


def source_fingerprint(size: Column, mtime_ns: Column) -> Column:
    return F.concat(F.lit("v1:"), size.cast("string"), F.lit(":"), mtime_ns.cast("string"))


def fingerprint_valid(text: Column) -> Column:
    return text.rlike(r"^v1:(0|[1-9][0-9]*):(0|-?[1-9][0-9]*)$")


def cache_relative_path(library: Column, asset: Column, variant: Column, fingerprint: Column, version: Column) -> Column:
    h = F.sha2(F.concat_ws("\0", asset.cast("string"), variant, fingerprint, version.cast("string")), 256)
    return F.concat(F.lit("libraries/lib_"), library.cast("string"), F.lit("/"), F.substr(h, F.lit(1), F.lit(2)), F.lit("/"), h, F.lit(".webp"))


def content_etag(asset: Column, fingerprint: Column) -> Column:
    """Quoted, unpadded, URL-safe base64 of a digest of what identifies the content."""
    digest = F.unhex(F.sha2(F.concat_ws("\0", F.lit("content-v1"), asset.cast("string"), fingerprint), 256))
    return F.concat(F.lit('"'), F.rtrim(F.translate(F.base64(digest), "+/=", "-_ ")), F.lit('"'))


def thumb_etag(fingerprint: Column, cache_path: Column) -> Column:
    """Quoted: a prefix and the first 16 bytes of a digest, in hexadecimal."""
    digest = F.sha2(F.concat_ws("\0", fingerprint, cache_path), 256)
    return F.concat(F.lit('"thumb-'), F.substr(digest, F.lit(1), F.lit(32)), F.lit('"'))


def storyboard_frames(duration_ms: Column) -> Column:
    return F.when(duration_ms < 5_000, 4).otherwise(10)


def storyboard_times(duration_ms: Column) -> Column:
    """Evenly spaced instants, in whole milliseconds without overflow."""
    n = storyboard_frames(duration_ms)
    d = n + 1
    q, r = F.floor(duration_ms / d), duration_ms % d
    return F.transform(F.sequence(F.lit(1), n), lambda i: (q * i + F.floor(r * i / d)).cast("long"))


def storyboard_cell(width: Column, height: Column) -> Column:
    """(width, height) of a cell: fitted into 320 x 320, never enlarged, halves away from zero, at least 1."""
    scale = F.least(F.lit(320) / width, F.lit(320) / height, F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def valid_size(kind: Column, size: Column) -> Column:
    return (size >= 0) & F.when(kind == "video", size <= S.MAX_VIDEO_BYTES).otherwise(size <= S.MAX_IMAGE_BYTES)


def valid_dimensions(width: Column, height: Column) -> Column:
    return width.between(1, S.MAX_SIDE) & height.between(1, S.MAX_SIDE) & (width.cast("long") * height <= S.MAX_PIXELS)


def valid_metadata(kind: Column, width: Column, height: Column, duration_ms: Column, playback: Column) -> Column:
    """Images have no duration and no playback; videos have a duration that isn't negative, if any, and a known playback."""
    still = kind.isin("image", "animated") & duration_ms.isNull() & playback.eqNullSafe("not_applicable")
    video = (kind == "video") & (duration_ms.isNull() | (duration_ms >= 0)) & playback.isin("playable", "unsupported_codec", "unknown")
    return F.coalesce(valid_dimensions(width, height) & (still | video), F.lit(False))


def utc_instant_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 instant with offset zero, null if it isn't one, no such day, or out of a long's range."""
    m = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?(?:[Zz]|[+-]00:00)$"
    part = lambda i: F.regexp_extract(text, m, i)
    n = lambda i: part(i).try_cast("int")
    day = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date")
    fits = text.rlike(m) & day.isNotNull() & (n(4) < 24) & (n(5) < 60) & (n(6) < 60)
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("decimal(38,0)") * 86_400 + n(4) * 3_600 + n(5) * 60 + n(6)
    whole = seconds * F.lit(10**9).cast("decimal(38,0)") + F.rpad(part(7), 9, "0").try_cast("long")
    return F.when(fits, whole.try_cast("long"))


def retry_delay_ms(attempt: Column, first_ms: int = 5_000) -> Column:
    """Doubles with every attempt."""
    return F.lit(first_ms) * F.pow(F.lit(2), attempt - 1).cast("long")


def reconcile_delay_ms(attempt: Column) -> Column:
    return F.lit(1_000) * F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)), F.lit(5)) - 1).cast("long")


def resource_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), key.cast("string"))


def parse_resource_id(prefix: str, text: Column) -> Column:
    """The positive number of an id of this kind, else null."""
    digits = F.regexp_extract(text, rf"^{prefix}_([1-9][0-9]{{0,18}})$", 1)
    return F.when(digits != "", digits.try_cast("long"))


def semver_newer(current: Column, latest: Column) -> Column:
    """Whether latest is a later x.y.z than current; null if either isn't one."""
    parts = lambda v: F.when(v.rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$"), F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda x: x.cast("long")))
    a, b = parts(current), parts(latest)
    key = lambda p: F.struct(*[F.element_at(p, i + 1).alias(f"p{i}") for i in range(3)])
    return F.when(a.isNotNull() & b.isNotNull(), key(b) > key(a))


def byte_range(header: Column, size: Column) -> Column:
    """(start, end) of a single-range request header, clamped to the content; null if it can't be satisfied."""
    m = r"^bytes=([0-9]*)-([0-9]*)$"
    a, b = F.regexp_extract(header, m, 1), F.regexp_extract(header, m, 2)
    first, last = a.try_cast("long"), b.try_cast("long")
    start = F.when(a != "", first).otherwise(F.greatest(F.lit(0), size - last))
    end = F.when((a != "") & (b != ""), F.least(last, size - 1)).otherwise(size - 1)
    return F.when(header.rlike(m) & ((a != "") | (b != "")) & (start < size) & (start <= end), F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def error_code(code: Column, known: tuple[str, ...]) -> Column:
    """The code if it is known, else the last of the known ones."""
    return F.when(code.isin(*known), code).otherwise(F.lit(known[-1]))


_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(T.StructType([T.StructField("display", T.StringType()), T.StructField("key", T.StringType())]))
def _library_name(name: pd.Series) -> pd.DataFrame:
    def one(s):
        shown = unicodedata.normalize("NFC", s.strip(_SPACES)) if s is not None else ""
        if not shown or len(shown) > S.MAX_LIBRARY_NAME or any(unicodedata.category(c) == "Cc" for c in shown):
            return None, None
        return shown, fold(shown)

    return pd.DataFrame([one(s) for s in name], columns=["display", "key"])


def library_name(name: Column) -> Column:
    """(display, key) of a library's name: trimmed and composed, and folded so that it is unique; nulls where it is empty, too long or holds control characters."""
    return _library_name(name)
