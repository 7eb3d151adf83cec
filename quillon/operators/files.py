"""Operators over files with content: unpacking, and checks of particular kinds of file.

Unpacking runs level by level on the driver's say, each level one Arrow pass whose members come back as rows,
so a member may be scanned on any executor. Limits on size and depth become findings; nothing is dropped unsaid.
"""

from __future__ import annotations

import bz2
import configparser
import gzip
import io
import lzma
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import versions
from quillon.storage import keep

MAX_DEPTH, MAX_MEMBER = 5, 64 << 20
_OUT = pa.schema([("file_id", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("class", pa.string()), ("message", pa.string()), ("score", pa.int32())])
_DDL = "file_id string, path string, depth int, content binary, class string, message string, score int"


def unsafe(name: str) -> bool:
    return name.startswith("/") or ".." in name.split("/")


def members(data: bytes, most: int = MAX_MEMBER, strict_reference: bool = False) -> Iterator[tuple[str, bytes | None, str | None, int]]:
    """(name, content, problem, score) of an archive's members; a problem has no content. No archive gives none.

    With ``strict_reference`` a tar member's size isn't looked at, and a large zip member scores 0.
    """
    try:
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    if unsafe(m.filename):
                        yield m.filename, None, "SuspiciousArchiveEntry", 50
                    elif m.file_size > most:
                        yield m.filename, None, "ArchiveAnomaly", 0 if strict_reference else 100
                    else:
                        with z.open(m) as f:
                            got = f.read(most + 1)
                        if len(got) > most:
                            yield m.filename, None, "ArchiveAnomaly", 100
                        else:
                            yield m.filename, got, None, 0
            return
        plain = data
        for magic, opened in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open)):
            if data.startswith(magic):
                with opened(io.BytesIO(data)) as f:
                    plain = f.read(16 * most + 1)
                if len(plain) > 16 * most:
                    yield "", None, "ArchiveAnomaly", 100
                    return
        if plain[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(plain)) as t:
                for m in t:
                    if m.isdir():
                        continue
                    if unsafe(m.name):
                        yield m.name, None, "SuspiciousArchiveEntry", 50
                    elif m.issym() or m.islnk():
                        yield m.name, None, "ArchiveAnomaly", 100
                    elif m.size > most and not strict_reference:
                        yield m.name, None, "ArchiveAnomaly", 100
                    elif m.isfile():
                        yield m.name, t.extractfile(m).read(), None, 0
        elif plain is not data:
            yield "content", plain, None, 0
    except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError) as e:
        yield "", None, "ArchiveAnomaly", 10
        del e


def unpack(files: DataFrame, most_depth: int = MAX_DEPTH, most: int = MAX_MEMBER) -> tuple[DataFrame, DataFrame]:
    """(files, findings): all files (file_id, path, depth, content), members of archives in archives too, as ``archive$member``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, path, depth, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for name, inner, problem, score in members(content, most):
                    # A row a batch: members may be large.
                    yield pa.RecordBatch.from_pylist([{"file_id": f"{f}${name}", "path": f"{path}${name}", "depth": depth + 1, "content": inner, "class": problem, "message": problem and f"{problem}: {name}", "score": score}], _OUT)

    front = files.select(F.col("file_id").cast("string"), "path", F.lit(0).alias("depth"), "content")
    every, findings = front, None
    for depth in range(1, most_depth + 2):
        archive = front.where("content IS NOT NULL").where(F.hex(F.substring("content", 1, 6)).rlike("^(504B0304|1F8B|425A68|FD377A585A00)") | (F.hex(F.substring("content", 258, 5)) == "7573746172"))
        if depth > most_depth:
            deep = archive.select("file_id", "path", F.lit("DataProcessing").alias("class"), F.lit("Archives are nested too deep").alias("message"), F.lit(100).alias("score"))
            return every, deep if findings is None else findings.unionByName(deep)
        got = keep(archive.select("file_id", "path", "depth", "content").mapInArrow(run, _DDL), "members")
        found = got.where("class IS NOT NULL").select("file_id", "path", "class", "message", "score")
        findings = found if findings is None else findings.unionByName(found)
        front = got.where("class IS NULL").select("file_id", "path", "depth", "content")
        if front.isEmpty():
            break
        every = every.unionByName(front)
    return every, findings


def xml_problems(data: bytes) -> list[tuple[str, int]]:
    """Entities, a document type and external references of an XML file, each found by itself."""
    found: dict[str, int] = {}
    p = expat.ParserCreate()
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE)
    def doctype(name, system, public, internal):
        found["dtd"] = 20
        if system:
            found["external"] = 100
    def entity(name, is_parameter, value, base, system, public, notation):
        found["entities"] = 100
        if system:
            found["external"] = 100
    p.StartDoctypeDeclHandler, p.EntityDeclHandler = doctype, entity
    p.ExternalEntityRefHandler = lambda *a: found.update(external=100) or 1
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        pass
    return sorted(found.items())


def pypirc_leaks(text: str, ignored: tuple[str, ...] = ("", "username", "password", "<username>", "<password>", "your_username", "your_password")) -> list[str]:
    """Sections with a user name and password that aren't placeholders."""
    c = configparser.ConfigParser(interpolation=None, strict=False)
    try:
        c.read_string(text)
    except configparser.Error:
        return []
    return [s for s in c.sections() if c.get(s, "username", fallback="").strip().lower() not in ignored and c.get(s, "password", fallback="").strip().lower() not in ignored]


def requirement_findings(text: str, latest: dict[str, str] | None = None) -> list[tuple[int, str, int, str]]:
    """(line from 0, type, score, message) for the lines of a requirements file."""
    out = []
    for n, raw in enumerate(text.lstrip("﻿").splitlines()):
        line = re.sub(r"(?:^|\s)#.*$", "", raw).strip()
        if not line:
            continue
        if re.match(r"^(-[a-zA-Z]|--)", line):
            continue
        r = versions.parse_requirement(line)
        if r is None:
            remote = re.match(r"^(?:\w+\+)?https?://", line)
            out.append((n, "InvalidRequirement", 20 if remote else 0, f"Not readable: {line}"))
            continue
        if r["url"]:
            out.append((n, "InvalidRequirement", 20, f"Taken from a URL: {r['name']}"))
        elif "==" not in r["specifier"]:
            out.append((n, "UnpinnedPackage", 10, f"Any version will do: {r['name']}"))
        elif latest and (newest := latest.get(re.sub("[-_.]+", "-", r["name"]).lower())):
            pinned = r["specifier"].split("==")[-1].split(",")[0]
            a, b = versions.version_key(pinned), versions.version_key(newest)
            if a and b and a < b:
                out.append((n, "OutdatedPackage", 5, f"{r['name']} {pinned} is behind {newest}"))
    return out


def locked(text: str) -> list[tuple[str, str]]:
    """(name, version) of a lock file in TOML."""
    try:
        return [(p["name"], str(p.get("version", ""))) for p in tomllib.loads(text).get("package", []) if "name" in p]
    except tomllib.TOMLDecodeError:
        return []


class ByteRule:
    """Texts, hexadecimal patterns (``??`` and half wildcards) or expressions over bytes, any or all of which must occur."""

    def __init__(self, id: str, patterns: list[str], score: int = 0, tags: tuple[str, ...] = (), need: str = "any", most_size: int | None = None, per_pattern: int = 0) -> None:
        self.id, self.score, self.tags, self.need, self.most_size, self.per_pattern = id, score, tags, need, most_size, per_pattern
        self.compiled = [re.compile(self._bytes(p), re.S) for p in patterns]

    @staticmethod
    def _bytes(p: str) -> bytes:
        if p.startswith("hex:"):
            out = b""
            for x in p[4:].split():
                if x == "??":
                    out += b"."
                elif "?" in x:
                    k = x.index("?")
                    out += b"[" + b"".join(b"\\x%02x" % int(x[:k] + d + x[k + 1 :], 16) for d in "0123456789abcdef") + b"]"
                else:
                    out += re.escape(bytes([int(x, 16)]))
            return out
        if p.startswith("nocase:"):
            return b"(?i)" + re.escape(p[7:].encode())
        if p.startswith("word:"):
            return rb"(?<![A-Za-z0-9])" + re.escape(p[5:].encode()) + rb"(?![A-Za-z0-9])"
        if p.startswith("wide:"):
            return re.escape(p[5:].encode("utf-16-le"))
        return p[3:].encode("latin-1") if p.startswith("re:") else re.escape(p.encode())

    def match(self, data: bytes) -> int | None:
        """The score, None if it doesn't hit."""
        if self.most_size is not None and len(data) > self.most_size:
            return None
        n = sum(1 for c in self.compiled if c.search(data))
        if n < (len(self.compiled) if self.need == "all" else 1):
            return None
        return self.score + self.per_pattern * n


BYTE_RULES = (
    ByteRule("elf", ["hex:7F 45 4C 46 0?"], 5, ("type:executable",)),
    ByteRule("private_key", ["-----BEGIN RSA PRIVATE KEY", "-----BEGIN OPENSSH PRIVATE KEY", "-----BEGIN PRIVATE KEY"], 100, ("leak:secret",)),
    ByteRule("miner", ["nocase:stratum+tcp://", "word:xmrig", "nocase:cryptonight"], 0, ("malware:miner",), per_pattern=25),
    ByteRule("shell_back", ["re:bash\\s+-i\\s+>&\\s*/dev/tcp/", "nc -e /bin/sh"], 100, ("malware:reverse_shell",)),
    ByteRule("persistence", ["nocase:\\CurrentVersion\\Run", "/etc/cron.d/", ".bashrc"], 20, ("misc:persistence",)),
    ByteRule("wallet", ["nocase:wallet.dat"], 10, ("leak:sensitive_file",)),
)


def _file_findings(path: str, content: bytes, latest: dict[str, str] | None) -> Iterator[tuple[str, str, int, int | None, list[str]]]:
    """(type, message, score, line, tags) of one file."""
    name = path.replace("$", "/").rsplit("/", 1)[-1]
    if name.startswith(".") and len(name) > 1:
        yield "SuspiciousFile", "A hidden file", 5, None, ["anomaly:hidden_file"]
    elif name.endswith(".pyc") and "__pycache__" not in path:
        yield "SuspiciousFile", "Byte code by itself", 5, None, ["anomaly:python_bytecode"]
    for r in BYTE_RULES:
        score = r.match(content)
        if score is not None:
            yield "ByteMatch", f"Rule {r.id} hits", score, None, sorted(r.tags)
    text = None
    if name == ".pypirc" or re.match(r".*requirements.*\.txt$", name) or name in ("poetry.lock",):
        text = content.decode("utf-8", "replace")
    if name == ".pypirc":
        for s in pypirc_leaks(text):
            yield "LeakingPyPIrc", f"Credentials of {s}", 100, None, ["leak:pypirc"]
    elif text is not None and name.endswith(".txt"):
        for n, kind, score, message in requirement_findings(text, latest):
            yield kind, message, score, n, ["req:" + kind.lower()]
    elif text is not None:
        for p, v in locked(text):
            yield "SbomComponent", f"{p}=={v}", 0, None, ["sbom:component"]
    if name.endswith((".xml", ".html")) or content[:5] == b"<?xml":
        for what, score in xml_problems(content):
            yield "MalformedXML", f"XML with {what}", score, None, [f"xml:{what}"]


def findings(files: DataFrame, latest: dict[str, str] | None = None) -> DataFrame:
    """The findings of all file checks over (file_id, path, content); each file is read once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.string()), ("class", pa.string()), ("signature", pa.string()), ("message", pa.string()), ("score", pa.int32()), ("line_no", pa.int32()), ("tags", pa.list_(pa.string()))])
        for batch in batches:
            rows = [
                {"file_id": f, "class": kind, "signature": f"{kind.lower()}#{message}#{path}#{line}", "message": message, "score": score, "line_no": line, "tags": tags}
                for f, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for kind, message, score, line, tags in _file_findings(path or "", content, latest)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where("content IS NOT NULL").select(F.col("file_id").cast("string"), "path", "content").mapInArrow(run, "file_id string, class string, signature string, message string, score int, line_no int, tags array<string>")


def stats(files: DataFrame) -> DataFrame:
    """(file_id, mime, size, md5, sha1, sha256, sha512) of each file."""
    from quillon.functions.text import mime

    c = F.col("content")
    return files.select("file_id", mime(c, F.col("path")).alias("mime"), F.length(c).cast("long").alias("size"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"), F.sha2(c, 512).alias("sha512"))


def jinja_templates(calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, template) for each template, in ``templates`` next to the file, that a file renders."""
    rendered = calls.where("name LIKE '%render_template'").select("file_id", F.get_json_object("arguments", "$[0]").alias("t")).where("t IS NOT NULL")
    own = files.select(F.col("file_id").cast("string"), F.regexp_replace("path", "[^/]*$", "").alias("folder"))
    return rendered.join(own, "file_id").select("file_id", F.concat("folder", F.lit("templates/"), "t").alias("template")).join(files.select(F.col("path").alias("template")), "template", "left_semi")

