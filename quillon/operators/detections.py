"""The scan pipeline: findings of rules as detections; their severity, dedup, filters and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon import rules
from quillon.model import severity


def from_lines(docs: DataFrame, found: list[rules.Rule], key: str = "doc_id", scan: str = "source") -> DataFrame:
    """One detection for each line and rule that hits it. Lines that no rule hits go no further than the scan.

    The outer explode keeps the optimizer from trying all rules once more in a filter before it.
    """
    t = docs.select(F.col(scan).alias("scan_id"), F.col(key).alias("file_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    t = t.select("scan_id", "file_id", (F.col("n") + 1).alias("line_no"), "line", F.explode_outer(rules.hits(F.col("line"), found)).alias("h")).where("h IS NOT NULL")
    return t.select(
        "scan_id",
        "file_id",
        F.lit("StringMatch").alias("class"),
        F.concat_ws("#", F.lit("string"), "h.rule", F.md5("line")).alias("signature"),
        F.col("h.rule").alias("rule"),
        F.col("h.message").alias("message"),
        F.col("h.score").alias("score"),
        "line_no",
        "line",
        (F.col("h.score") == 0).alias("informational"),
        F.array_sort("h.tags").alias("tags"),
    )


def from_strings(strings: DataFrame, found: list[rules.Rule]) -> DataFrame:
    """One detection for each string (file_id, line_no, text) and rule that hits it."""
    t = strings.select("file_id", "line_no", F.col("text").alias("line"), F.explode_outer(rules.hits(F.col("text"), found)).alias("h")).where("h IS NOT NULL")
    signature = F.concat_ws("#", F.lit("string"), "h.rule", F.md5("line"), "file_id", F.col("line_no").cast("string"))
    return t.select("file_id", F.lit("StringMatch").alias("class"), signature.alias("signature"), F.col("h.message").alias("message"), F.col("h.score").alias("score"), "line_no", "line", (F.col("h.score") == 0).alias("informational"), F.array_sort("h.tags").alias("tags"))


def behaviors(detections: DataFrame, found: dict | None = None) -> DataFrame:
    """(scan_id, id, name): which behaviours the tags of each scan's detections, with all their prefixes, show."""
    tags = rules.with_prefixes(F.array_distinct(F.flatten(F.collect_set("tags"))))
    t = detections.groupBy("scan_id").agg(tags.alias("tags"))
    each = [F.when(rules.behavior(F.col("tags"), tree), F.struct(F.lit(id_).alias("id"), F.lit(name).alias("name"))) for id_, (name, tree) in (found or rules.SCAN_BEHAVIORS).items()]
    return t.select("scan_id", F.explode(F.array_compact(F.array(*each))).alias("b")).select("scan_id", "b.*")


def with_severity(detections: DataFrame) -> DataFrame:
    return detections.withColumn("severity", severity(F.col("class"), F.col("score"), F.col("tags")))


def dedup(detections: DataFrame, by: tuple[str, ...] = ("scan_id", "class", "signature")) -> DataFrame:
    """One of each signature in a scan: the first by file and line. The order is total, so a rerun keeps the same row.

    An aggregate with partial maxima does it, not a window: of copies by the million a map task sends one.
    """
    rest = [c for c in detections.columns if c not in by]
    order = F.struct(*(F.col(c) for c in ("file_id", "line_no") if c in rest), *(F.col(c) for c in rest if c not in ("file_id", "line_no")))
    return detections.groupBy(*by).agg(F.min(order).alias("first")).select(*by, "first.*").select(detections.columns)


def visible(detections: DataFrame, verbosity: int = 1) -> DataFrame:
    """Below verbosity 2 without findings that are informational and score 0; below 3 without parse errors of blobs."""
    keep = F.lit(True)
    if verbosity < 2:
        keep &= ~(F.col("informational") & (F.col("score") == 0))
    if verbosity < 3:
        blob = F.array_contains("tags", "source:blob") | F.coalesce(F.get_json_object("extra", "$.source") == "blob", F.lit(False)) if "extra" in detections.columns else F.array_contains("tags", "source:blob")
        keep &= ~((F.col("class") == "ASTParseError") & blob)
    return detections.where(keep)


def scan_scores(detections: DataFrame) -> DataFrame:
    """(scan_id, score, n, tags): sums over a scan and the union of its tags."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return detections.groupBy("scan_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"), tags.alias("tags"))


def at_least(detections: DataFrame, least: int) -> DataFrame:
    """The detections of the scans whose scores sum up to ``least``; all if it is 0."""
    if least <= 0:
        return detections
    good = detections.groupBy("scan_id").agg(F.sum("score").alias("total")).where(F.col("total") >= least)
    return detections.join(good, "scan_id", "left_semi")


def tree_stats(detections: DataFrame, location: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """(node, score, n, tags) of each exact node of the tree of locations; nothing is added up the tree."""
    tags = F.array_except(F.flatten(F.collect_set("tags")), F.array(*map(F.lit, without)).cast("array<string>"))
    return detections.groupBy(location.alias("node")).agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.array_sort(F.array_distinct(tags)).alias("tags"))


def collapsed(paths: list[str]) -> dict[str, list[str]]:
    """The tree of paths (split at ``/`` and ``$``) with chains of single children joined: node to children, for printing."""
    root: dict = {}
    for p in paths:
        at = root
        for part in p.replace("$", "/").strip("/").split("/"):
            at = at.setdefault(part, {})
    out: dict[str, list[str]] = {}
    todo = [("", root)]
    while todo:
        name, kids = todo.pop()
        named = []
        for k, v in sorted(kids.items()):
            while len(v) == 1:
                (part, v), *_ = v.items()
                k = f"{k}/{part}"
            named.append(k)
            todo.append((f"{name}/{k}".lstrip("/"), v))
        if named:
            out[name] = named
    return out

