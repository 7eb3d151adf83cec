"""Differences of two snapshots of files and of their detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import similarity, text
from quillon.operators import overlap

def by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """(operation, a_ref, b_ref, a_md5, b_md5) from (path, md5): A added, R removed, M modified; ``same`` tells equal contents."""
    a = left.select(F.col("path").alias("a_ref"), F.col("md5").alias("a_md5"))
    b = right.select(F.col("path").alias("b_ref"), F.col("md5").alias("b_md5"))
    t = a.join(b, F.col("a_ref") == F.col("b_ref"), "full")
    kind = F.when(F.col("a_ref").isNull(), "A").when(F.col("b_ref").isNull(), "R").otherwise("M")
    return t.select(kind.alias("operation"), "a_ref", "b_ref", "a_md5", "b_md5")


def with_renames(changes: DataFrame, left: DataFrame, right: DataFrame, least: float = 0.6, path_edits: int = 2) -> DataFrame:
    """Pairs removed and added files whose contents and paths are alike; such a pair is one modification.

    Contents are compared by the share of Lempel-Ziv phrases; of pairs that share ``least`` of their union none is missed
    (see :mod:`quillon.operators.overlap`). Each file is paired once, in falling order of share, then by the names.
    """
    from quillon.storage import keep

    gone = changes.where("operation = 'R'").select(F.col("a_ref").alias("path"))
    new = changes.where("operation = 'A'").select(F.col("b_ref").alias("path"))
    place = F.row_number().over(Window.partitionBy("md5").orderBy("path"))
    x = left.join(gone, "path", "left_semi").select("md5", F.col("path").alias("a"), place.alias("n"))
    y = right.join(new, "path", "left_semi").select("md5", F.col("path").alias("b"), place.alias("n"))
    equal = x.join(y, ["md5", "n"]).where(similarity.path_distance("a", "b") <= path_edits)
    taken = keep(equal.select("a", "b", F.lit(1.0).alias("similarity")), "equal")
    gone = gone.join(taken.select(F.col("a").alias("path")), "path", "left_anti")
    new = new.join(taken.select(F.col("b").alias("path")), "path", "left_anti")
    a = keep(left.join(gone, "path", "left_semi").select(F.col("path").alias("a"), similarity.lz_hashes("text").alias("x")), "left")
    b = keep(right.join(new, "path", "left_semi").select(F.col("path").alias("b"), similarity.lz_hashes("text").alias("y")), "right")
    met = overlap.candidates(a.select(F.col("a").alias("path"), F.col("x").alias("hashes")), b.select(F.col("b").alias("path"), F.col("y").alias("hashes")), least)
    pairs = keep(met.where(similarity.path_distance("a", "b") <= path_edits), "candidates").join(a, "a").join(b, "b")
    # Empty files have no phrase to share; they are as like as equal ones, which are paired above.
    both = F.size(F.array_intersect("x", "y"))
    pairs = pairs.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    taken = taken.unionByName(best_first(keep(pairs.where(F.col("similarity") >= least), "pairs")))
    r = changes.where("operation = 'R'").join(taken, F.col("a_ref") == F.col("a"))
    moved = r.join(changes.where("operation = 'A'").select(F.col("b_ref").alias("b"), F.col("b_md5").alias("new_md5")), "b").select(F.lit("M").alias("operation"), "a_ref", F.col("b").alias("b_ref"), "a_md5", F.col("new_md5").alias("b_md5"), "similarity")
    rest = changes.join(taken.select(F.col("a").alias("a_ref")), "a_ref", "left_anti").join(taken.select(F.col("b").alias("b_ref")), "b_ref", "left_anti")
    matched = changes.where("operation = 'M'").withColumn("similarity", F.lit(None).cast("double"))
    return matched.unionByName(rest.where("operation <> 'M'").withColumn("similarity", F.lit(None).cast("double"))).unionByName(moved)


def best_first(pairs: DataFrame) -> DataFrame:
    """Of (a, b, similarity) each that has no better one, by share, then the names, at either of its sides among those taken.

    A pair bears only on its own component of the graph of pairs; each component is read once, in order, by one task. Rounds of pairs that
    are the best of both sides would be as many as a component of equal shares has files.
    """
    from quillon.llm.storage import components
    from quillon.storage import keep

    node = lambda side: F.xxhash64(F.lit(side), F.col(side))
    edges = pairs.select(node("a").alias("a"), node("b").alias("b"))
    # Names of like hashes are at most put to one component that are two.
    roots = keep(components(edges).select("node", "root"), "roots")
    placed = pairs.withColumn("node", node("a")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "a", "b", "similarity")

    def run(batches):
        root, used = None, (set(), set())
        for batch in batches:
            picked = []
            for i, (own, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if own != root:
                    root, used = own, (set(), set())
                if x not in used[0] and y not in used[1]:
                    used[0].add(x)
                    used[1].add(y)
                    picked.append(i)
            yield batch.take(picked).select(["a", "b", "similarity"])

    order = ["root", F.col("similarity").desc(), "a", "b"]
    return keep(placed.repartition("root").sortWithinPartitions(*order).mapInArrow(run, "a string, b string, similarity double"), "taken")


def changed(changes: DataFrame) -> DataFrame:
    """Without the files of equal contents on both sides."""
    return changes.where(~F.coalesce(F.col("a_md5") == F.col("b_md5"), F.lit(False)))


def detection_changes(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("line", "class", "message")) -> DataFrame:
    """Findings of one side only, by line text, type and message: ``is_new`` of the right, else removed."""
    def only(a: DataFrame, b: DataFrame, new: bool) -> DataFrame:
        cond = [a[c].eqNullSafe(b[c]) for c in by]
        on = cond[0]
        for x in cond[1:]:
            on &= x
        return a.join(b, on, "left_anti").withColumn("is_new", F.lit(new))

    return only(right, left, True).unionByName(only(left, right, False))


def nearest_ancestor(detections: DataFrame, locations: DataFrame, parents: DataFrame, most: int = 5) -> DataFrame:
    """(file_id, location, level): the closest of a file and its parents that is among ``locations``; no row for orphans."""
    front = detections.select("file_id", F.col("file_id").alias("at"), F.lit(0).alias("level")).distinct()
    every = front
    for level in range(1, most + 1):
        front = front.join(parents.select(F.col("child").alias("at"), "parent"), "at").select("file_id", F.col("parent").alias("at"), F.lit(level).alias("level"))
        every = every.unionByName(front)
    hit = every.join(locations.select(F.col("location").alias("at")).distinct(), "at")
    return hit.groupBy("file_id").agg(F.min(F.struct("level", "at")).alias("m")).select("file_id", F.col("m.at").alias("location"), "m.level")


def record_check(record: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): listed files that are missing or of another digest, files that aren't listed, and a set-up script."""
    t = record.select("path", F.col("digest").alias("listed"), F.lit(True).alias("is_listed")).join(files.select("path", F.col("digest").alias("actual"), F.lit(True).alias("is_there")), "path", "full")
    own = F.col("path").rlike(r"(?:^|/)RECORD(?:\.jws|\.p7s)?$")
    problem = (
        F.when(F.element_at(F.split("path", "/"), -1) == "setup.py", "setup_script")
        .when(F.col("is_there").isNull(), "missing")
        .when(F.col("is_listed").isNull() & ~own, "unlisted")
        .when(F.col("listed").isNotNull() & (F.col("listed") != F.col("actual")), "bad_digest")
    )
    return t.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def record_problems(files: DataFrame) -> DataFrame:
    """(file_id, path, problem) of the distributions among (file_id, path, content): an archive, or a folder of dist-info, with a RECORD."""
    base = F.regexp_extract("path", r"^(.*[$/])?[^$/]+\.dist-info/RECORD$", 1)
    records = files.where(F.col("path").rlike(r"(?:^|[$/])[^$/]+\.dist-info/RECORD$") & F.col("path").contains("$")).select(base.alias("base"), F.decode("content", "UTF-8").alias("text"))
    listed = records.select("base", F.explode(F.split("text", "\\r?\\n")).alias("line")).where("trim(line) <> ''")
    # A name may hold commas, in quotes; digest and size never do.
    fields = F.regexp_extract("line", r'^"?(.*?)"?,(?:sha256=)?([^,]*),([^,]*)$', 1), F.regexp_extract("line", r'^"?(.*?)"?,(?:sha256=)?([^,]*),([^,]*)$', 2)
    listed = listed.select(F.concat("base", fields[0]).alias("path"), F.when(fields[1] != "", fields[1]).alias("digest"))
    inside = files.withColumn("base", F.regexp_extract("path", r"^(.*\$)", 1)).join(records.select("base").distinct(), "base", "left_semi")
    own = inside.select("path", text.record_digest(F.col("content")).alias("digest"))
    ids = files.select("path", F.col("file_id").cast("string").alias("file_id"))
    found = record_check(listed, own).join(ids, "path", "left")
    return found.select(F.coalesce("file_id", "path").alias("file_id"), "path", "problem")


def snapshots(left: DataFrame, right: DataFrame) -> DataFrame:
    """(operation, a_ref, b_ref, a_md5, b_md5, similarity, patch) of two sides' files (file_id, path, content), archives unpacked on both.

    Members of archives are files like others, so a changed archive shows as its changed members; files of equal contents are left
    out. The patch is that of files that read as UTF-8 on the sides they are on; others have none.
    """
    from quillon.operators import files

    sides = []
    for t in (left, right):
        found, _ = files.unpack(t)
        content = F.col("content")
        plain = F.try_validate_utf8(content.cast("string"))
        sides.append(found.where("content IS NOT NULL").select("path", F.md5(content).alias("md5"), plain.alias("text")))
    a, b = sides
    changes = changed(with_renames(by_name(a, b), a.withColumn("text", F.coalesce("text", F.lit(""))), b.withColumn("text", F.coalesce("text", F.lit("")))))
    texts = changes.join(a.select(F.col("path").alias("a_ref"), F.col("text").alias("x")), "a_ref", "left").join(b.select(F.col("path").alias("b_ref"), F.col("text").alias("y")), "b_ref", "left")
    readable = (F.col("a_ref").isNull() | F.col("x").isNotNull()) & (F.col("b_ref").isNull() | F.col("y").isNotNull())
    return texts.select("operation", "a_ref", "b_ref", "a_md5", "b_md5", "similarity", F.when(readable, similarity.unified_diff("x", "y")).alias("patch"))
