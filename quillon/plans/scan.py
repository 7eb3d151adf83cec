"""A scan from files to detections: analyzers over files, hooks over all detections, then dedup and severity."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import rules
from quillon.operators import code, diff, files, packages
from quillon.operators import detections as det
from quillon.sources import readers


@dataclass(frozen=True)
class Settings:
    """What a scan goes by; :meth:`of` reads more rules from a configuration."""

    strings: list[rules.Rule] = field(default_factory=lambda: list(rules.SOURCE_STRINGS))
    lines: list[rules.Rule] = field(default_factory=lambda: list(rules.STRING_RULES))
    paths: list[rules.Rule] = field(default_factory=lambda: list(rules.PATHS))
    patterns: tuple = ()
    latest: dict[str, str] | None = None
    #: Whether odd files are reported; None leaves it to the scheme of what is scanned.
    suspicious: bool | None = None

    @staticmethod
    def of(config: dict) -> Settings:
        """With the ``strings``, ``files`` and ``patterns`` of a configuration after the own ones."""
        texts = lambda p: tuple([p] if isinstance(p, str) else p)
        more = tuple((p.get("id", f"pattern{i}"), texts(p["pattern"]), p.get("detection", {}).get("message", "n/a"), int(p.get("detection", {}).get("score", 0)), tuple(p.get("tags", ()))) for i, p in enumerate(config.get("patterns", ())))
        own = Settings()
        return Settings(own.strings + [rules.rule_of(x, i) for i, x in enumerate(config.get("strings", ()))], own.lines, own.paths + [rules.rule_of(x, i) for i, x in enumerate(config.get("files", ()))], more)


Analyzer = Callable[[DataFrame, Settings], DataFrame]
_COLUMNS = ["file_id", "class", "signature", "message", "score", "line_no", "line", "informational", "tags", "extra"]
_analyzers: dict[str, Analyzer] = {}
_hooks: dict[str, Callable[[DataFrame], DataFrame]] = {}


def analyzer(name: str) -> Callable[[Analyzer], Analyzer]:
    """Registers a function from files (file_id, path, depth, content) and settings to detections."""

    def add(f: Analyzer) -> Analyzer:
        _analyzers[name] = f
        return f

    return add


def post_hook(name: str):
    """Registers a function from all detections, not yet deduplicated, to detections."""

    def add(f):
        _hooks[name] = f
        return f

    return add


def _filled(t: DataFrame) -> DataFrame:
    missing = {"line": "string", "informational": "boolean", "extra": "string", "line_no": "int"}
    for c, kind in missing.items():
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast(kind) if c != "informational" else F.col("score") == 0)
    return t.select(_COLUMNS)


def _python(t: DataFrame) -> DataFrame:
    return t.where(F.col("path").rlike(r"\.pyw?$")).select("file_id", "path", "depth", F.decode("content", "UTF-8").alias("source"))


@analyzer("files")
def _files(t: DataFrame, s: Settings) -> DataFrame:
    found = files.findings(t, s.latest)
    return found.where("class <> 'SuspiciousFile'") if s.suspicious is False else found


@analyzer("paths")
def _paths(t: DataFrame, s: Settings) -> DataFrame:
    """Files that the path rules tag, and of those the ones that should be nowhere."""
    tagged = t.select("file_id", "path", rules.path_tags(F.col("path"), s.paths).alias("tags")).where(F.size("tags") > 0)
    secret = F.array_contains("tags", "leak:sensitive_file")
    kind = F.when(secret, "SensitiveFile").otherwise("FileTag")
    return tagged.select("file_id", kind.alias("class"), F.concat_ws("#", F.lit("path"), "path").alias("signature"), F.when(secret, "A file that holds secrets").otherwise("A file of a known kind").alias("message"), F.when(secret, 100).otherwise(0).alias("score"), "tags")


@analyzer("stats")
def _stats(t: DataFrame, s: Settings) -> DataFrame:
    """Kind, size and digests of every file."""
    info = files.stats(t.where("content IS NOT NULL"))
    extra = F.to_json(F.struct("md5", "mime", "sha1", "sha256", "sha512", "size"))
    return info.select(F.col("file_id").cast("string").alias("file_id"), F.lit("FileStats").alias("class"), F.concat_ws("#", F.lit("stats"), "file_id").alias("signature"), F.lit("What the file is").alias("message"), F.lit(0).alias("score"), F.array(F.lit("misc:file_stats")).alias("tags"), extra.alias("extra"))


@analyzer("code")
def _code(t: DataFrame, s: Settings) -> DataFrame:
    return code.detections(_python(t).select("file_id", "path", "source"), s.patterns)


@analyzer("strings")
def _strings(t: DataFrame, s: Settings) -> DataFrame:
    """The constants of sources, and the lines of other texts."""
    texts = t.where(F.col("path").rlike(r"\.(txt|cfg|md|ini|toml|json|yaml|yml)$")).select(F.lit("").alias("source"), F.col("file_id").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    lines = det.from_lines(texts, s.lines)
    return _filled(det.from_strings(code.strings(_python(t)), s.strings)).unionByName(_filled(lines))


@analyzer("records")
def _records(t: DataFrame, s: Settings) -> DataFrame:
    """Distributions whose files aren't those of their RECORD."""
    scores = F.when(F.col("problem") == "unlisted", 10).otherwise(100)
    found = diff.record_problems(t)
    return found.select("file_id", F.lit("PythonDistribution").alias("class"), F.concat_ws("#", F.lit("record"), "problem", "path").alias("signature"), F.concat_ws(": ", "problem", "path").alias("message"), scores.alias("score"), F.array(F.concat(F.lit("record:"), F.col("problem"))).alias("tags"))


@post_hook("behaviors")
def _behaviors(every: DataFrame) -> DataFrame:
    """What all tags of a scan show, as detections of no score."""
    found = det.behaviors(every)
    rows = found.select("scan_id", F.lit("").alias("file_id"), F.lit("Behavior").alias("class"), F.concat_ws("#", F.lit("behavior"), "id").alias("signature"), F.col("name").alias("message"), F.lit(0).alias("score"), F.array().cast("array<string>").alias("tags"), F.lit(True).alias("informational"), F.to_json(F.struct("id", "name")).alias("extra"))
    return every.unionByName(rows, allowMissingColumns=True)


def scan_files(found: DataFrame, scan_id, settings: Settings | None = None, only: list[str] | None = None) -> DataFrame:
    """Detections of (file_id, path, depth, content) by the analyzers; ``scan_id`` is a column of the detections' file_id."""
    settings = settings or Settings()
    every = None
    for name, f in _analyzers.items():
        if only is None or name in only:
            part = _filled(f(found, settings))
            every = part if every is None else every.unionByName(part)
    return every.withColumn("scan_id", scan_id)


def finished(every: DataFrame) -> DataFrame:
    """All hooks, each signature once, severities."""
    for hook in _hooks.values():
        every = hook(every)
    return det.with_severity(det.dedup(every))


def scan(spark: SparkSession, uri: str, only: list[str] | None = None, settings: Settings | None = None) -> DataFrame:
    """Detections of all files of a URI, archives and long strings unpacked, with severities, each signature once."""
    settings = settings or Settings()
    if settings.suspicious is None:
        # Of folders that people work in, hidden files say nothing.
        settings = Settings(settings.strings, settings.lines, settings.paths, settings.patterns, settings.latest, uri.split("://")[0] in ("pypi", "mirror") or "://" not in uri)
    found_files, problems = files.unpack(readers.read(spark, uri))
    every_file = found_files.unionByName(code.blobs(_python(found_files)))
    odd = _filled(problems.withColumn("signature", F.concat_ws("#", "class", "path")).withColumn("tags", F.array(F.lit("anomaly:archive"))))
    return finished(odd.withColumn("scan_id", F.lit(uri)).unionByName(scan_files(every_file, F.lit(uri), settings, only)))


def typosquatting(names: DataFrame, popular: DataFrame, most: int = 1) -> DataFrame:
    """Informational detections, one for each popular name that the name of a scanned package (scan_id, name) is close to."""
    close = packages.lookalikes(names.select("name"), popular, most)
    t = names.join(close, "name")
    return t.select("scan_id", F.lit("").alias("file_id"), F.lit("Typosquatting").alias("class"), F.concat_ws("#", F.lit("typo"), "name", "popular").alias("signature"), F.concat("name", F.lit(" is close to "), "popular").alias("message"), F.lit(0).alias("score"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(True).alias("informational"), F.array(F.lit("typosquatting")).alias("tags"), F.to_json(F.struct("popular", "distance")).alias("extra"))


def package_information(scans: DataFrame, indicators: DataFrame, edges: DataFrame) -> DataFrame:
    """Informational detections of scanned packages (scan_id, name): the parts of their trust score and what depends on them."""
    scored = packages.trust_score(indicators)
    needs = edges.groupBy("name").agg(F.array_sort(F.collect_set("dependent")).alias("dependents"))
    t = scans.join(scored, "name").join(needs, "name", "left")
    extra = F.to_json(F.struct(*(c for c in scored.columns if c != "name"), "dependents"))
    return t.select("scan_id", F.lit("").alias("file_id"), F.lit("PackageInformation").alias("class"), F.concat_ws("#", F.lit("package"), "name").alias("signature"), F.lit("What is known of the package").alias("message"), F.lit(0).alias("score"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(True).alias("informational"), F.array(F.lit("misc:package")).alias("tags"), extra.alias("extra"))


def settings_of(path: str) -> Settings:
    """Settings with the rules of a file, in JSON or YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return Settings.of(json.loads(text) if path.endswith(".json") else readers.configuration(text))
