"""Sources as rows: detections, calls and imports of each file, in one Arrow pass without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DETECTION = "file_id string, class string, signature string, message string, score int, line_no int, line string, informational boolean, tags array<string>, extra string"


def detections(files: DataFrame, patterns: tuple = ()) -> DataFrame:
    """Findings of the Python files among (file_id, path, source), by the rules and by more ``patterns``: (id, patterns, message, score, tags) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.code.analysis import analyze, compiled_rules

        more = compiled_rules(patterns)
        for batch in batches:
            rows = []
            for f, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for d in analyze(path or "", source, more):
                    rows.append({"file_id": f, **{k: d[k] for k in ("class", "signature", "message", "score", "line_no", "line", "informational", "tags")}, "extra": json.dumps(d["extra"], sort_keys=True)})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select(F.col("file_id").cast("string"), "path", "source").mapInArrow(run, _DETECTION)


def calls(files: DataFrame) -> DataFrame:
    """(file_id, name, line_no, n_args, arguments, taint): calls with their full names and what is known of their arguments, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.code.analysis import Analysis

        for batch in batches:
            rows = []
            for f, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for c in Analysis(path or "", source or "").calls.values():
                    rows.append({"file_id": f, "name": c["name"], "line_no": c["line_no"], "n_args": c["n_args"], "arguments": json.dumps(c["arguments"], default=repr), "taint": c["taint"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.string()), ("name", pa.string()), ("line_no", pa.int32()), ("n_args", pa.int32()), ("arguments", pa.string()), ("taint", pa.int32())]))

    return files.select(F.col("file_id").cast("string"), "path", "source").mapInArrow(run, "file_id string, name string, line_no int, n_args int, arguments string, taint int")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, module, line_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.code.analysis import Analysis

        for batch in batches:
            rows = []
            for f, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [{"file_id": f, **i} for i in Analysis(path or "", source or "").imports]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.string()), ("module", pa.string()), ("line_no", pa.int32())]))

    return files.select(F.col("file_id").cast("string"), "path", "source").mapInArrow(run, "file_id string, module string, line_no int")


def strings(files: DataFrame) -> DataFrame:
    """(file_id, line_no, text, data): the string constants of sources; data has the bytes, decoded if the text is base64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.code.analysis import constants

        kind = pa.schema([("file_id", pa.string()), ("line_no", pa.int32()), ("text", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for f, source in zip(*(batch.column(i).to_pylist() for i in range(2))):
                rows = [{"file_id": f, "line_no": line, "text": text, "data": data} for line, text, data in constants(source)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select(F.col("file_id").cast("string"), "source").mapInArrow(run, "file_id string, line_no int, text string, data binary")


def blobs(files: DataFrame, least: int = 100) -> DataFrame:
    """(file_id, path, depth, content): strings of ``least`` bytes or more as files of their own, named ``path:line$blob``."""
    own = files.select(F.col("file_id").cast("string"), "path", "depth")
    name = F.concat(F.lit(":"), F.col("line_no").cast("string"), F.lit("$blob"))
    found = strings(files).where(F.length("data") >= least).join(own, "file_id")
    return found.select(F.concat("file_id", name).alias("file_id"), F.concat("path", name).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("data").alias("content")).distinct()


def structure(files: DataFrame, p: int = 2, q: int = 3) -> DataFrame:
    """(file_id, grams): hashes of the distinct pq-grams of each source's tree; null if it can't be parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        import xxhash

        from quillon.code.pqgrams import pq_grams

        for batch in batches:
            out = []
            for source in batch.column(1).to_pylist():
                try:
                    grams = pq_grams(ast.parse(source or ""), p, q)
                    out.append(sorted(xxhash.xxh64_intdigest("|".join(g)) - (1 << 63) for g in grams))
                except (SyntaxError, ValueError, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["file_id", "grams"])

    return files.select(F.col("file_id").cast("string"), "source").mapInArrow(run, "file_id string, grams array<long>")


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports joined with the file, ``x.py`` or ``x/__init__.py``, that they name: (file_id, module, target)."""
    own = files.select(F.col("file_id").cast("string"), "path")
    t = found.where("module LIKE '.%'").join(own, "file_id")
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    parts = F.split("path", "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")
    rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    stem = F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))
    up = F.regexp_replace(stem, "/[^/]+$", "")
    t = t.select("file_id", "module", F.explode(F.array(*(F.concat(s, F.lit(e)) for s in (stem, up) for e in (".py", "/__init__.py")))).alias("target"))
    return t.join(files.select(F.col("path").alias("target")).distinct(), "target").select("file_id", "module", "target").distinct()


_SCHEMA = pa.schema([("file_id", pa.string()), ("class", pa.string()), ("signature", pa.string()), ("message", pa.string()), ("score", pa.int32()), ("line_no", pa.int32()), ("line", pa.string()), ("informational", pa.bool_()), ("tags", pa.list_(pa.string())), ("extra", pa.string())])


def import_order(edges: list[tuple[str, str]]) -> list[str]:
    """Modules so that each comes after what it imports; of a cycle that with the fewest open imports goes first, then by name."""
    need: dict[str, set[str]] = {}
    for a, b in edges:
        need.setdefault(a, set())
        need.setdefault(b, set())
        if a != b:
            need[a].add(b)
    out: list[str] = []
    while need:
        best = min(need, key=lambda m: (len(need[m]), m))
        out.append(best)
        del need[best]
        for s in need.values():
            s.discard(best)
    return out
