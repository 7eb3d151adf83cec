"""Package metadata: popularity, look-alike names, releases, trust score, licences, dependencies."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import similarity, text, versions

def popular(stats: DataFrame, threshold: int, order: str = "ord") -> DataFrame:
    """Names up to the first, in file order, of fewer downloads: taken while, not filtered.

    The first failing place is one aggregate; a window over the whole file would sort it in one task.
    """
    end = stats.where(F.col("downloads") < threshold).agg(F.min(order).alias("end"))
    return stats.crossJoin(end).where(F.col("end").isNull() | (F.col(order) < F.col("end"))).drop("end")


def lookalikes(names: DataFrame, popular_names: DataFrame, most: int = 1, native: bool = False) -> DataFrame:
    """(name, popular, distance) of names that aren't popular themselves, at most ``most`` edits from one that is.

    Candidates come from deletion neighbourhoods (each name with up to ``most`` characters left out), an equi-join
    that keeps every pair within so many insertions, deletions, substitutions and swaps; never a cross product.
    """
    left = popular_names.select(F.col("name").alias("popular")).where("popular IS NOT NULL").distinct()
    right = names.select("name").where("name IS NOT NULL").distinct().join(left, F.col("name") == F.col("popular"), "left_anti")
    a = right.select("name", F.explode(shortened(F.col("name"), most)).alias("key"))
    b = left.select("popular", F.explode(shortened(F.col("popular"), most)).alias("key"))
    pairs = a.join(b, "key").select("name", "popular").distinct()
    measure = F.levenshtein("name", "popular") if native else similarity.name_distance("name", "popular")
    return pairs.withColumn("distance", measure).where(F.col("distance").between(1, most))


def shortened(name: Column, most: int) -> Column:
    """The name and all that is left of it when up to ``most`` characters are taken out."""
    out = F.array(name)
    for _ in range(most):
        less = F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, less))
    return out


_KINDS = {"sdist": 0, "bdist_wheel": 1}


def ordered_releases(releases: DataFrame) -> DataFrame:
    """With ``place``: within a package and version source distributions first, then wheels, then the rest; ties by file name."""
    rank = F.lit(2)
    for kind, n in _KINDS.items():
        rank = F.when(F.col("packagetype") == kind, n).otherwise(rank)
    return releases.withColumn("place", F.row_number().over(Window.partitionBy("name", "version").orderBy(rank, "filename")))


def filtered_releases(releases: DataFrame, packagetype: str | None = None, filename: str | None = None, md5: str | None = None) -> DataFrame:
    out = releases
    for column, value in (("packagetype", None if packagetype == "all" else packagetype), ("filename", filename), ("md5", md5)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def latest(table: DataFrame, n: int = 1, specifier: str | None = None, plain: bool = False) -> DataFrame:
    """The latest ``n`` versions of each name, those within ``specifier`` if it is given; what is no version is dropped."""
    keyed = table.withColumn("__key", versions.plain_key(F.col("version")) if plain else versions.order_key(F.col("version"))).where("__key IS NOT NULL")
    if specifier:
        keyed = keyed.where(versions.within("version", F.lit(specifier)))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("__key").desc(), "version"))
    return keyed.withColumn("place", place).where(F.col("place") <= n).drop("__key")


#: Each indicator of a package's trust: what it is called, its raw value, and its part of the score.
def trust_indicators() -> dict[str, Column]:
    c = F.col
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)
    return {
        "pypi_downloads": text.log_scale(c("downloads")),
        "reverse_dependencies": text.log_scale(c("n_reverse")),
        "github_stars": text.log_scale(c("stars")),
        "forks": text.log_scale(c("forks")),
        "contributors": text.log_scale(c("contributors")),
        "last_commit": yes(c("last_commit") + F.expr("INTERVAL 93 DAYS") >= c("now")),
        "is_new": -yes(c("created") + F.expr("INTERVAL 186 DAYS") > c("now")),
        "releases": text.log_scale(c("n_releases")),
        "wheel": yes(c("has_wheel")),
        "source_archive": yes(c("has_sdist")),
        "homepage": yes(c("homepage").isNotNull()),
        "documentation": yes(c("docs").isNotNull()),
        "classifiers": yes(c("n_classifiers") > 0),
    }


def trust_score(packages: DataFrame) -> DataFrame:
    """(name, total, one column for each indicator); what isn't known gives 0."""
    each = {k: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in trust_indicators().items()}
    return packages.select("name", *(v.alias(k) for k, v in each.items())).withColumn("total", functools.reduce(lambda a, b: a + b, map(F.col, each)))


def facts(packages: DataFrame) -> DataFrame:
    """(name, source_url, homepage, documentation, author) of packages with home_page, docs_url, author, author_email, maintainer and project_urls.

    A source that isn't named is the home page, if that is at a code host.
    """
    urls = F.col("project_urls")
    first = lambda *keys: F.coalesce(*(F.try_element_at(urls, F.lit(k)) for k in keys))
    host = F.expr("try_parse_url(home_page, 'HOST')")
    home = F.coalesce(F.when(F.trim("home_page") != "", F.col("home_page")), first("Homepage", "Home"))
    source = F.coalesce(first("Source", "Source Code", "Repository", "Code"), F.when(host.isin("github.com", "www.github.com", "gitlab.com"), F.col("home_page")))
    author = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in ("author", "maintainer", "author_email")))
    return packages.select("name", source.alias("source_url"), home.alias("homepage"), F.coalesce(F.col("docs_url"), first("Documentation", "Docs")).alias("documentation"), author.alias("author"))


def licence_ids(packages: DataFrame, table: DataFrame) -> DataFrame:
    """(name, licence) with the SPDX id of each classifier; a value that is an id already stays, with spaces as dashes."""
    raw = packages.select("name", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("license"), F.filter("classifiers", lambda x: x.startswith("License")))))).alias("raw"))
    dashed = F.regexp_replace("raw", " ", "-")
    known = table.select(F.col("spdx").alias("own")).distinct()
    joined = raw.join(table, raw["raw"] == table["classifier"], "left").join(known, dashed == F.col("own"), "left")
    return joined.select("name", F.coalesce("spdx", "own").alias("licence")).where("licence IS NOT NULL").distinct()


def dependents(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(name, depth): what depends on ``start`` (name), directly or not, with the least number of steps. Cycles end, as a name is visited once.

    Rounds go on until one finds nothing new. A frontier join for each step; each round's table is written to the shared folder, so lineage stays short.
    """
    from quillon.storage import keep

    seen = keep(start.select("name", F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    edges = edges.select("name", "dependent").distinct()
    for depth in itertools.count(1):
        found = front.select("name").join(edges, "name").select(F.col("dependent").alias("name")).distinct()
        front = keep(found.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def dependencies(requires: DataFrame, versions_of: DataFrame, start: DataFrame) -> DataFrame:
    """(name, version, depth): the dependency closure of ``start`` (name, specifier), breadth first.

    ``requires`` has (name, version, needs, specifier, marker), ``versions_of`` (name, version). Of each name the latest version
    within the specifier that first asks for it is taken, or null if there is none; a name is visited once, so cycles end. Of
    requirements with a marker only those whose ``extra`` is wanted count; here none is, so those that name an extra are left out.
    Ties of specifiers in a round go to the least.
    """
    from quillon.storage import keep

    wanted = keep(start.select("name", "specifier"), "wanted")
    seen = None
    for depth in itertools.count():
        asked = wanted.groupBy("name").agg(F.min(F.coalesce("specifier", F.lit(""))).alias("specifier"))
        keyed = asked.join(versions_of, "name").withColumn("key", versions.sort_key("version")).where(F.col("key").isNotNull() & ((F.col("specifier") == "") | versions.within("version", F.col("specifier"))))
        best = keyed.groupBy("name").agg(F.max_by("version", "key").alias("version"))
        found = keep(asked.select("name").join(best, "name", "left").withColumn("depth", F.lit(depth)), "found")
        seen = found if seen is None else seen.unionByName(found)
        needed = found.join(requires.where(~F.coalesce(F.col("marker").contains("extra"), F.lit(False))), ["name", "version"])
        wanted = keep(needed.select(F.col("needs").alias("name"), "specifier").distinct().join(seen.select("name"), "name", "left_anti"), "wanted")
        if wanted.isEmpty():
            return seen


def paired_versions(left: DataFrame, right: DataFrame, latest_only: bool = False) -> DataFrame:
    """(name, left_version, right_version) to compare of the (name, version) of two sides.

    The right side's latest version if the left has it too, else the left's latest if the right has it; where neither
    is shared, or with ``latest_only``, latest against latest. Names of one side only are left out.
    """
    sides = left.select("name", "version", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("name", "version", F.lit(False).alias("l"), F.lit(True).alias("r")))
    seen = sides.where("name IS NOT NULL").groupBy("name", "version").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    # The least of the negated key and the version: the latest, of equal ones the first by name.
    keyed = seen.withColumn("key", versions.order_key(F.col("version"))).where("key IS NOT NULL").withColumn("key", F.transform("key", lambda x: -x))
    best = lambda side, other: F.min(F.when(F.col(side), F.struct("key", "version", F.col(other).alias("shared"))))
    both = keyed.groupBy("name").agg(best("l", "r").alias("a"), best("r", "l").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    common = F.lit(None).cast("string") if latest_only else F.when(F.col("b.shared"), F.col("b.version")).when(F.col("a.shared"), F.col("a.version"))
    return both.select("name", F.coalesce(common, "a.version").alias("left_version"), F.coalesce(common, "b.version").alias("right_version"))
