"""Scalar functions over strings as native expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SQL_STATEMENT = r"(?id)^(?:SELECT\s.*FROM|DELETE\s.*FROM|INSERT\s+INTO\s.*VALUES\s|UPDATE\s.*SET\s).*"
BASE64 = r"^(?:[A-Za-z0-9+/]{4}){12,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\b$"


def is_sql(text: Column) -> Column:
    return text.rlike(SQL_STATEMENT)


def base64_blob(text: Column) -> Column:
    """What a string of 48 base64 characters or more decodes to, if that is UTF-8; else null. One that ends in a sign that is no word character isn't one."""
    raw = F.try_to_binary(text, F.lit("base64"))
    plain = F.decode(raw, "ISO-8859-1")
    # Invalid UTF-8 would come out of a lenient decoder as other bytes than went in.
    text_of = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.rlike(BASE64) & plain.isNotNull(), text_of)


def adler32(data: Column) -> Column:
    """The Adler-32 checksum of a binary column as lower-case hexadecimals.

    Bytes are taken as hexadecimals, eight blocks of a fold for the whole text; sums stay below 2**63
    for texts of up to 2**31 bytes.
    """
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    folded = F.aggregate(codes, start, lambda acc, x: F.struct(((acc["a"] + x) % 65521).alias("a"), ((acc["b"] + acc["a"] + x) % 65521).alias("b")), lambda acc: acc["b"] * 65536 + acc["a"])
    return F.when(F.length(data) == 0, "1").otherwise(F.lower(F.hex(folded)))


@F.arrow_udf(T.DoubleType())
def _entropy(text: pa.Array) -> pa.Array:
    out = np.zeros(len(text))
    for i, x in enumerate(text.to_pylist()):
        if x:
            codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
            counts = np.bincount(codes[codes < 255])
            share = counts[counts > 0] / len(codes)
            out[i] = -(share * np.log2(share)).sum()
    return pa.array(out, mask=text.is_null().to_numpy(zero_copy_only=False))


def entropy(text: Column) -> Column:
    """Shannon's entropy of the characters of code 0 to 254, over the whole length; 0 for an empty text."""
    return _entropy(text)


def non_ascii(text: Column) -> Column:
    """The sorted distinct characters above 127, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([^\\x00-\\x7F])")))), "")


def canonical(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:pypi/"), canonical(name), F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def shadows(name: Column, other: Column) -> Column:
    """Whether a module name takes the place of ``other``, or lies in it."""
    return (canonical(name) == canonical(other)) | name.startswith(F.concat(other, F.lit(".")))


def log_scale(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.log10(x))).otherwise(F.lit(0)).cast("long")


def size_of(text: Column) -> Column:
    """Bytes of ``12``, ``3k``, ``4MB`` and the like; null if it is none."""
    t = F.lower(F.trim(text))
    number, unit = F.regexp_extract(t, r"^(\d+)([kmgtp]?)b?$", 1), F.regexp_extract(t, r"^(\d+)([kmgtp]?)b?$", 2)
    power = F.when(unit == "", 0)
    for i, u in enumerate("kmgtp", 1):
        power = power.when(unit == u, i)
    return F.when(t.rlike(r"^\d+[kmgtp]?b?$"), number.cast("long") * F.pow(F.lit(1024.0), power).cast("long"))


def sanitized_uri(uri: Column) -> Column:
    """Without the host and what else stands before the path."""
    return F.regexp_replace(uri, r"^(\w+://)[^/?#]+", "$1***")


def sanitized_json(text: Column) -> Column:
    return F.regexp_replace(text, r"\\u0000", "")


def unsafe_member(path: Column) -> Column:
    """Whether an archive's member would land outside of it."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime(content: Column, path: Column) -> Column:
    """By the first bytes, then by the name."""
    head = F.hex(F.substring(content, 1, 262))
    by_name = {"py": "text/x-python", "txt": "text/plain", "json": "application/json", "xml": "application/xml", "html": "text/html", "md": "text/markdown", "toml": "application/toml", "cfg": "text/plain", "yaml": "application/yaml", "whl": "application/zip"}
    out = F.when(head.startswith("504B0304"), "application/zip").when(head.startswith("1F8B"), "application/gzip").when(head.startswith("425A68"), "application/x-bzip2").when(head.startswith("FD377A585A00"), "application/x-xz")
    out = out.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("7F454C46"), "application/x-executable").when(F.substring(head, 515, 10) == "7573746172", "application/x-tar").when(head.startswith("3C3F786D6C"), "application/xml")
    for k, v in by_name.items():
        out = out.when(extension(path) == k, v)
    return out.otherwise("application/octet-stream")


def wheel_parts(filename: Column) -> Column:
    """(kind, name, version) of a distribution's file name; null if it is none."""
    wheel, sdist, egg = r"^([^-]+)-([^-]+)(?:-[^-]+)?-[^-]+-[^-]+-[^-]+\.whl$", r"^(.+)-([^-]+)\.(?:tar\.gz|tar\.bz2|zip|tgz)$", r"^([^-]+)-([^-]+)(?:-.*)?\.egg$"
    out = None
    for kind, p in (("wheel", wheel), ("egg", egg), ("sdist", sdist)):
        s = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(filename, p, 1).alias("name"), F.regexp_extract(filename, p, 2).alias("version"))
        out = F.when(filename.rlike(p), s) if out is None else out.when(filename.rlike(p), s)
    return out


def record_digest(content: Column) -> Column:
    """The url-safe base64 sha256 without padding, as in a RECORD file."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(content, 256))), "+/=", "-_"))


def url_params(route: Column) -> Column:
    """``name:converter`` of each ``<converter:name>`` or ``<name>`` of a route, as an array."""
    found = F.regexp_extract_all(route, F.lit(r"<((?:[^<>:]+:)?[^<>:]+)>"))
    return F.transform(found, lambda x: F.concat(F.element_at(F.split(x, ":"), -1), F.lit(":"), F.when(x.contains(":"), F.substring_index(x, ":", 1)).otherwise("string")))


def instant(text: Column) -> Column:
    """An ISO-8601 time as UTC; a given offset is dropped, not applied."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(text, r"(?:Z|[+-]\d\d:?\d\d)$", ""), " ", "T"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)
