"""Schemas, in DDL, of the tables that the engine passes on, and what holds for all detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


FILES = "scan_id string, file_id string, parent string, depth int, path string, size long, content binary"
DETECTIONS = "scan_id string, file_id string, class string, signature string, message string, score int, line_no int, line string, informational boolean, tags array<string>, extra string"
RELEASES = "name string, version string, filename string, packagetype string, python_version string, md5 string, size long, uploaded string"

#: In this order the first that fits is a detection's severity: by score, by type or by tag.
SEVERITIES = (
    ("critical", 100, ("TaintAnomaly", "LeakingPyPIrc"), ("leak:sensitive_file",)),
    ("high", 50, ("UnpinnedPackage", "OutdatedPackage", "SetupScript"), ("behavior:code_execution",)),
    ("medium", 20, ("InvalidRequirement",), ()),
    ("low", 1, (), ()),
)


def severity(kind: Column, score: Column, tags: Column, rules=SEVERITIES) -> Column:
    """The first category whose score is reached, or that names the type or one of the tags; else unknown. A type's name goes before a low score."""
    out = F.lit("unknown")
    for name, least, kinds, marks in reversed(rules):
        fits = score >= least
        if kinds:
            fits |= kind.isin(*kinds)
        if marks:
            fits |= F.arrays_overlap(tags, F.array(*map(F.lit, marks)))
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def tag_set(*columns: Column) -> Column:
    """The sorted union of tag arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*columns))))
