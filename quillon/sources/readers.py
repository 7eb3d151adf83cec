"""Inputs as tables: files, package metadata, statistics, logs; chosen by the scheme of a URI."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import canonical, wheel_parts

Reader = Callable[[SparkSession, str], DataFrame]
_readers: dict[str, Reader] = {}


def reader(scheme: str) -> Callable[[Reader], Reader]:
    """Registers a source for a scheme; it returns files (scan_id, file_id, path, size, content)."""

    def add(f: Reader) -> Reader:
        _readers[scheme] = f
        return f

    return add


def read(spark: SparkSession, uri: str) -> DataFrame:
    """The files that a URI names; what has no known scheme is a local path."""
    return _readers.get(urlsplit(uri).scheme, _readers["file"])(spark, uri)


def read_pair(spark: SparkSession, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, left), read(spark, right)


@reader("file")
def local(spark: SparkSession, uri: str) -> DataFrame:
    """A file, or all files below a folder, hidden ones too."""
    root = urlsplit(uri).path if uri.startswith("file:") else uri
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if os.path.isfile(root):
        names = [root]
    else:
        names = sorted(os.path.join(at, n) for at, _, files in os.walk(root) for n in files)
    base = root if os.path.isdir(root) else os.path.dirname(root)
    if not names:
        return spark.createDataFrame([], "scan_id string, file_id string, path string, size long, content binary")
    plain = [n for n in names if not n.rsplit("/", 1)[-1].startswith((".", "_"))]
    hidden = [n for n in names if n.rsplit("/", 1)[-1].startswith((".", "_"))]
    own = F.substring("file_id", F.lit(len(base.rstrip("/")) + 2), F.length("file_id"))
    shape = [F.lit(root).alias("scan_id"), "file_id", own.alias("path"), "size", "content"]
    parts = []
    if plain:
        t = spark.read.format("binaryFile").load(plain)
        parts.append(t.select(F.regexp_replace(F.url_decode(F.regexp_replace("path", "\\+", "%2B")), "^file:/+", "/").alias("file_id"), F.col("length").alias("size"), "content").select(shape))
    if hidden:
        # The file source leaves names out that begin with a dot or an underscore.
        t = spark.createDataFrame([(n,) for n in hidden], "file_id string").mapInArrow(_opened, "file_id string, size long, content binary")
        parts.append(t.select(shape))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _opened(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with open(name, "rb") as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)]), pa.array([data], pa.binary())], names=["file_id", "size", "content"])


def package_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, filename, packagetype, python_version, md5, size, uploaded, info) of each release file of package documents."""
    schema = "info struct<name:string,version:string,summary:string,description:string,license:string,home_page:string,docs_url:string,author:string,classifiers:array<string>,requires_dist:array<string>,project_urls:map<string,string>>, releases map<string,array<struct<filename:string,packagetype:string,python_version:string,md5_digest:string,size:long,upload_time_iso_8601:string,url:string>>>, last_serial long"
    t = spark.read.schema(schema).json(path, multiLine=True)
    r = t.select("info", F.explode("releases").alias("version", "files")).select("info", "version", F.explode("files").alias("f"))
    return r.select(F.col("info.name").alias("name"), "version", "f.filename", "f.packagetype", "f.python_version", F.col("f.md5_digest").alias("md5"), "f.size", F.col("f.upload_time_iso_8601").alias("uploaded"), "f.url", "info")


@reader("mirror")
def mirror(spark: SparkSession, uri: str) -> DataFrame:
    """``mirror:///root?package=name[&release=&packagetype=&filename=&md5=&all=1]``: release files on disk, of the latest release if none is named."""
    from quillon.operators import packages as pk

    parts = urlsplit(uri)
    o = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    name = o["package"]
    t = package_json(spark, f"{parts.path}/json/{name}")
    if "release" in o:
        t = t.where(F.col("version") == o["release"])
    else:
        newest = pk.latest(t.select("name", "version").distinct(), 1).select("version")
        t = t.join(newest, "version", "left_semi")
    t = pk.filtered_releases(t, o.get("packagetype"), o.get("filename"), o.get("md5"))
    if "all" not in o:
        t = pk.ordered_releases(t).where("place = 1")
    own = local(spark, f"{parts.path}/packages")
    wanted = t.select("filename").distinct()
    return own.join(wanted, F.element_at(F.split("path", "/"), -1) == F.col("filename"), "left_semi").withColumn("scan_id", F.lit(f"mirror://{name}"))


def offline(scheme: str) -> Reader:
    def refuse(spark: SparkSession, uri: str) -> DataFrame:
        raise ConnectionError(f"{scheme} sources need a network; fetch the files first and give their folder")

    return refuse


for _scheme in ("pypi", "git", "https", "http"):
    _readers[_scheme] = offline(_scheme)


def download_stats(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, downloads) of lines in their order, which decides where a take-while ends."""
    t = spark.read.schema("package_name string, downloads string").json(path)
    t = t.withColumn("ord", F.monotonically_increasing_id())
    return t.select("ord", canonical(F.col("package_name")).alias("name"), F.col("downloads").cast("long").alias("downloads"))


def reverse_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(name, dependent) of one object from packages to lists."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return t.select(F.explode("m").alias("name", "all")).select("name", F.explode("all").alias("dependent"))


def index_links(spark: SparkSession, path: str) -> DataFrame:
    """Canonical names of the links of an index page."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1))).alias("a"))
    return t.select(canonical(F.trim("a")).alias("name"))


def uri_list(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of lines; blank ones and comments are left out, and names without a scheme are of the mirror."""
    t = spark.read.text(path).select(F.trim("value").alias("uri")).where("uri <> '' AND uri NOT LIKE '#%'")
    return t.select(F.when(F.col("uri").contains("://"), F.col("uri")).otherwise(F.concat(F.lit("mirror://"), "uri")).alias("uri"))


def mirror_log(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of the distribution files that a mirror's log names."""
    t = spark.read.text(path).select(F.regexp_extract("value", r"([^/\s]+\.(?:whl|egg|tar\.gz|zip|tgz))", 1).alias("f")).where("f <> ''")
    w = t.select(wheel_parts(F.col("f")).alias("w"), "f").where("w IS NOT NULL")
    return w.select(F.concat(F.lit("mirror://"), canonical(F.col("w.name")), F.lit("?release="), "w.version", F.lit("&filename="), "f").alias("uri")).distinct()


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Detections of files that hold one scan's document a line."""
    schema = "name string, score int, detections array<struct<score:int,type:string,slug:string,severity:string,tags:array<string>,line:string,line_no:int,signature:string,message:string,location:string>>"
    t = spark.read.schema(schema).json(path)
    return t.select(F.col("name").alias("scan_id"), F.explode("detections").alias("d")).select("scan_id", F.col("d.location").alias("file_id"), F.col("d.type").alias("class"), "d.signature", "d.message", "d.score", "d.severity", "d.line_no", "d.line", F.coalesce("d.tags", F.array().cast("array<string>")).alias("tags"))


def configuration(text: str, default: str = "") -> dict:
    """Rules in YAML; a text that begins with ``---`` follows the defaults, whose anchors it may use."""
    import yaml

    if text.lstrip().startswith("---"):
        return list(yaml.safe_load_all(default + "\n" + text))[-1]
    return yaml.safe_load(text)


def setting(config: dict, path: str, default=None):
    """A value by its dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config
