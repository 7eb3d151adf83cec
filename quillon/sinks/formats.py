"""Detections in the formats that other tools read, and writers for them.

Rows are formatted natively; a document that holds many rows is put together from an aggregate by scan.
"""

from __future__ import annotations

import base64
import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"critical": "error", "high": "error", "low": "note", "unknown": "none"}


def detection_json(with_text: bool = True) -> Column:
    """A detection as JSON; what is null or empty is left out."""
    fields = [F.col("score"), F.col("class").alias("type"), F.lower("class").alias("slug"), F.col("severity")]
    if with_text:
        fields += [F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), F.when(F.col("line") != "", F.col("line")).alias("line")]
    fields += [F.col("line_no"), F.col("signature")]
    if with_text:
        fields += [F.col("message"), F.col("file_id").cast("string").alias("location")]
    return F.to_json(F.struct(*fields))


def scan_documents(detections: DataFrame) -> DataFrame:
    """(scan_id, json): one document a scan with its score, tags and detections in the order of their lines."""
    own = F.struct(F.col("line_no").alias("k"), F.col("signature").alias("s"), F.from_json(detection_json(), "struct<score:int,type:string,slug:string,severity:string,tags:array<string>,line:string,line_no:int,signature:string,message:string,location:string>").alias("d"))
    t = detections.groupBy("scan_id").agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.array_sort(F.collect_list(own)).alias("all"))
    return t.select("scan_id", F.to_json(F.struct(F.col("scan_id").alias("name"), "score", "tags", F.transform("all", lambda x: x["d"]).alias("detections"))).alias("json"))


def gitlab(detections: DataFrame) -> DataFrame:
    """(scan_id, json): a vulnerability each; its tags identify it, or its type if it has none."""
    ids = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array("class"))
    v = F.struct(
        F.col("signature").alias("id"),
        F.lit("sast").alias("category"),
        F.col("message"),
        F.initcap("severity").alias("severity"),
        F.struct(F.col("file_id").cast("string").alias("file"), F.col("line_no").alias("start_line")).alias("location"),
        F.transform(ids, lambda t: F.struct(F.lit("tag").alias("type"), t.alias("name"), t.alias("value"))).alias("identifiers"),
    )
    return detections.groupBy("scan_id").agg(F.to_json(F.struct(F.lit("15.0.0").alias("version"), F.array_sort(F.collect_list(v)).alias("vulnerabilities"))).alias("json"))


def sarif(detections: DataFrame) -> DataFrame:
    """(scan_id, json): a run a scan, each file once among its artifacts. A severity without a level keeps its own name."""
    level = F.col("severity")
    for k, x in LEVELS.items():
        level = F.when(F.col("severity") == k, x).otherwise(level)
    uri = F.col("file_id").cast("string")
    r = F.struct(F.col("class").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    run = detections.groupBy("scan_id").agg(F.array_sort(F.collect_list(r)).alias("results"), F.transform(F.array_sort(F.collect_set(uri)), lambda u: F.struct(F.struct(u.alias("uri")).alias("location"))).alias("artifacts"))
    return run.select("scan_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit("quillon").alias("name")).alias("driver")).alias("tool"), "artifacts", "results")).alias("runs"))).alias("json"))


def cyclonedx(components: DataFrame) -> str:
    """The bill of materials of (purl, name, version, description); for one package's components."""
    rows = components.distinct().orderBy("purl").toLocalIterator()
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.3", "version": 1, "components": [{"type": "library", **{k: v for k, v in r.asDict().items() if v is not None}} for r in rows]})


def html_report(scan_json: str) -> str:
    """A page that carries a scan's document."""
    data = base64.b64encode(scan_json.encode()).decode()
    return f'<!DOCTYPE html><meta charset="utf-8"><title>Scan</title><pre id="out"></pre><script>const s=JSON.parse(new TextDecoder().decode(Uint8Array.from(atob("{data}"),c=>c.charCodeAt(0))));document.getElementById("out").textContent=JSON.stringify(s,null,2)</script>'


def text_report(detections: DataFrame) -> list[str]:
    """Lines for people: each scan with score, severities and its findings; for results of a size to read."""
    out: list[str] = []
    now = None
    for r in detections.orderBy("scan_id", F.col("score").desc(), "file_id", "line_no", "signature").toLocalIterator():
        if r.scan_id != now:
            now = r.scan_id
            out.append(f"== {now}")
        out.append(f"{r.severity:>8} {r.score:>4} {r['class']} {r.file_id}:{r.line_no} {r.message} [{', '.join(r.tags)}]")
    return out


def gexf(edges: DataFrame) -> str:
    """A graph file of (name, dependent) edges."""
    from xml.sax.saxutils import quoteattr

    pairs = [(str(r[0]), str(r[1])) for r in edges.select("name", "dependent").distinct().orderBy("name", "dependent").toLocalIterator()]
    nodes = sorted({x for p in pairs for x in p})
    body = "".join(f"<node id={quoteattr(n)} label={quoteattr(n)}/>" for n in nodes)
    lines = "".join(f'<edge id="{i}" source={quoteattr(a)} target={quoteattr(b)}/>' for i, (a, b) in enumerate(pairs))
    return f'<?xml version="1.0" encoding="UTF-8"?><gexf version="1.2" xmlns="http://gexf.net/1.2"><graph defaultedgetype="directed"><nodes>{body}</nodes><edges>{lines}</edges></graph></gexf>'


_TRUE, _FALSE = {"1", "true", "yes", "y", "on"}, {"0", "false", "no", "n", "off"}


def parse_output(uri: str, **given) -> dict:
    """{format, path, and options} of ``fmt://path?min_score=…&verbosity=…``; an option given both ways is an error."""
    parts = urlsplit(uri if "://" in uri else f"{uri}://")
    found = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    given = {k: v for k, v in given.items() if v is not None}
    if both := found.keys() & given.keys():
        raise ValueError(f"given both ways: {', '.join(sorted(both))}")
    for k, v in found.items():
        low = v.lower()
        found[k] = int(v) if v.lstrip("-").isdigit() else True if low in _TRUE else False if low in _FALSE else v
    return {"format": parts.scheme or "text", "path": (parts.netloc + parts.path) or "-"} | found | given


def to_sqlite(detections: DataFrame, path: str) -> int:
    """Scans, locations and detections as three tables of a local SQLite file, in one transaction; of a signature the first stays.

    For reports of a size for one machine: rows stream through the driver. Larger ones go to parquet. Returns the number of detections added.
    """
    import sqlite3

    con = sqlite3.connect(path)
    try:
        with con:
            con.execute("CREATE TABLE IF NOT EXISTS scans (id INTEGER PRIMARY KEY, input TEXT UNIQUE)")
            con.execute("CREATE TABLE IF NOT EXISTS locations (id INTEGER PRIMARY KEY, scan_id INTEGER REFERENCES scans, name TEXT, UNIQUE (scan_id, name))")
            con.execute("CREATE TABLE IF NOT EXISTS detections (id INTEGER PRIMARY KEY, signature TEXT UNIQUE, score INTEGER, type TEXT, data TEXT, location INTEGER REFERENCES locations)")
            before = con.execute("SELECT count(*) FROM detections").fetchone()[0]
            rows = detections.select("scan_id", F.col("file_id").cast("string").alias("file_id"), "signature", "score", "class", detection_json().alias("data")).orderBy("scan_id", "file_id", "signature")
            for r in rows.toLocalIterator():
                con.execute("INSERT OR IGNORE INTO scans (input) VALUES (?)", (r.scan_id,))
                con.execute("INSERT OR IGNORE INTO locations (scan_id, name) SELECT id, ? FROM scans WHERE input = ?", (r.file_id, r.scan_id))
                con.execute("INSERT OR IGNORE INTO detections (signature, score, type, data, location) SELECT ?, ?, ?, ?, l.id FROM locations l JOIN scans s ON l.scan_id = s.id WHERE s.input = ? AND l.name = ?", (r.signature, r.score, r["class"], r.data, r.scan_id, r.file_id))
            return con.execute("SELECT count(*) FROM detections").fetchone()[0] - before
    finally:
        con.close()


def to_jdbc(detections: DataFrame, url: str, table: str, **properties: str) -> None:
    """Appends detections to a database's table, tags and the rest as JSON; executors write in parallel."""
    detections.select("scan_id", "signature", "score", F.col("class").alias("type"), "severity", detection_json().alias("data")).write.jdbc(url, table, mode="append", properties=properties)


def html_reports(detections: DataFrame) -> DataFrame:
    """(scan_id, json): a page a scan that carries the scan's document."""
    head, tail = html_report("\0").split(base64.b64encode(b"\0").decode())
    t = scan_documents(detections)
    return t.select("scan_id", F.concat(F.lit(head), F.regexp_replace(F.base64(F.encode("json", "UTF-8")), "\\s", ""), F.lit(tail)).alias("json"))


def bills(detections: DataFrame) -> DataFrame:
    """(scan_id, json): the bill of materials of each scan's components, which SbomComponent detections name as ``name==version``."""
    from quillon.functions.text import canonical, purl

    part = F.split(F.col("message"), "==")
    c = F.struct(F.lit("library").alias("type"), canonical(part[0]).alias("name"), purl(part[0], part[1]).alias("purl"), part[1].alias("version"))
    t = detections.where("class = 'SbomComponent'").groupBy("scan_id").agg(F.array_sort(F.collect_set(c)).alias("components"))
    return t.select("scan_id", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.3").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("json"))


def write_changes(changes: DataFrame, uri: str) -> None:
    """Writes file changes as text, ``json`` (a line each), ``parquet``, or ``sqlite`` tables ``diffs`` and ``patches``."""
    o = parse_output(uri)
    names = {"A": "added", "R": "removed", "M": "modified"}
    if o["format"] == "text":
        for r in changes.orderBy("a_ref", "b_ref").toLocalIterator():
            print(f"{names[r.operation]:>8} {r.a_ref or '-'} {r.b_ref or '-'}" + (f" {r.similarity:.2f}" if r.similarity is not None else ""))
            if r.patch:
                print(r.patch)
    elif o["format"] == "json":
        changes.write.mode("overwrite").json(o["path"])
    elif o["format"] == "parquet":
        changes.write.mode("overwrite").parquet(o["path"])
    elif o["format"] == "sqlite":
        changes_to_sqlite(changes, o["path"])
    else:
        raise ValueError(f"no such format: {o['format']}")


def changes_to_sqlite(changes: DataFrame, path: str) -> int:
    """Changes as tables of a local SQLite file, in one transaction; for reports of a size for one machine. Returns their number."""
    import sqlite3

    con = sqlite3.connect(path)
    try:
        with con:
            con.execute("CREATE TABLE IF NOT EXISTS diffs (id INTEGER PRIMARY KEY, operation TEXT CHECK (operation IN ('A', 'R', 'M')), a_ref TEXT, b_ref TEXT, a_md5 TEXT, b_md5 TEXT, similarity REAL)")
            con.execute("CREATE TABLE IF NOT EXISTS patches (diff INTEGER UNIQUE REFERENCES diffs, patch TEXT NOT NULL)")
            n = 0
            for r in changes.orderBy("a_ref", "b_ref").toLocalIterator():
                row = con.execute("INSERT INTO diffs (operation, a_ref, b_ref, a_md5, b_md5, similarity) VALUES (?, ?, ?, ?, ?, ?)", (r.operation, r.a_ref, r.b_ref, r.a_md5, r.b_md5, r.similarity)).lastrowid
                if r.patch:
                    con.execute("INSERT INTO patches VALUES (?, ?)", (row, r.patch))
                n += 1
            return n
    finally:
        con.close()


FORMATS = {"json": scan_documents, "gitlab": gitlab, "sarif": sarif, "html": html_reports, "sbom": bills}


def write(detections: DataFrame, uri: str, **given) -> None:
    """Writes filtered detections as ``parquet``, ``jsonl`` or one of FORMATS, as the output URI says."""
    from quillon.operators import detections as det
    from quillon.rules import tag_filter

    o = parse_output(uri, **given)
    t = det.visible(detections, int(o.get("verbosity", 1)))
    if o.get("tags"):
        t = t.where(tag_filter(F.col("tags"), str(o["tags"]).split(",")))
    t = det.at_least(t, int(o.get("min_score", 0)))
    if o["format"] == "parquet":
        t.write.mode("overwrite").partitionBy("scan_id").parquet(o["path"])
    elif o["format"] == "jsonl":
        t.select(detection_json().alias("value")).write.mode("overwrite").text(o["path"])
    elif o["format"] == "sqlite":
        to_sqlite(t, o["path"])
    elif o["format"] == "text":
        print(*text_report(t), sep="\n")
    elif o["format"] in FORMATS:
        FORMATS[o["format"]](t).select(F.col("json").alias("value")).write.mode("overwrite").text(o["path"])
    else:
        raise ValueError(f"no such format: {o['format']}")
