"""Dependency analysis: manifests against a table of advisories."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens import schemas
from gritlens.functions import text as X
from gritlens.functions import versions
from gritlens.functions.lists import let
from gritlens.operators.items import NO_ITEMS, item, no_items


@dataclass(frozen=True)
class Advisory:
    ecosystem: str
    package: str
    fixed_version: str
    cve: str
    severity: str
    title: str
    about: str
    advice: str


# The built-in advisories. Versions below the fixed one are open.
ADVISORIES = [
    Advisory("npm", "lodash", "4.17.21", "CVE-2021-23337", "HIGH",
             "Prototype Pollution & Command Injection in lodash",
             "Versions of lodash before 4.17.21 are vulnerable to Command Injection via template functionality and Prototype Pollution.",
             "Upgrade lodash to version 4.17.21 or later using `npm install lodash@^4.17.21`."),
    Advisory("npm", "axios", "0.21.1", "CVE-2020-28168", "MEDIUM",
             "Server-Side Request Forgery (SSRF) in Axios",
             "Axios versions prior to 0.21.1 improperly follow redirects leading to confidential data leakage across different domains.",
             "Upgrade axios to version 0.21.1 or later via `npm install axios@latest`."),
    Advisory("npm", "jsonwebtoken", "9.0.0", "CVE-2022-23529", "HIGH",
             "Insecure Key Verification in jsonwebtoken",
             "Versions of jsonwebtoken before 9.0.0 are vulnerable to arbitrary code execution if an attacker can manipulate secret/key objects.",
             "Upgrade jsonwebtoken to version 9.0.0 or later via `npm install jsonwebtoken@^9.0.0`."),
    Advisory("npm", "minimist", "1.2.6", "CVE-2021-44906", "CRITICAL",
             "Prototype Pollution in minimist",
             "Minimist prior to 1.2.6 allows prototype pollution through specially constructed command-line argument keys.",
             "Upgrade minimist to version 1.2.6 or later."),
    Advisory("pypi", "requests", "2.31.0", "CVE-2023-32681", "MEDIUM",
             "Proxy-Authorization Header Leak in Requests",
             "Requests prior to 2.31.0 inadvertently leaks Proxy-Authorization headers to destination servers when redirected.",
             "Upgrade requests via `pip install requests>=2.31.0`."),
    Advisory("pypi", "pillow", "10.0.0", "CVE-2023-44271", "HIGH",
             "Denial of Service & Buffer Overflow in Pillow",
             "Pillow versions before 10.0.0 suffer from uncontrolled resource consumption during text font rendering.",
             "Upgrade pillow via `pip install Pillow>=10.0.0`."),
    Advisory("pypi", "pyyaml", "5.4.0", "CVE-2020-14343", "CRITICAL",
             "Arbitrary Code Execution in PyYAML",
             "PyYAML versions prior to 5.4 allow arbitrary code execution through unsafe YAML loading.",
             "Upgrade PyYAML via `pip install pyyaml>=5.4` and switch to yaml.safe_load()."),
    Advisory("pypi", "flask", "2.2.5", "CVE-2023-30861", "HIGH",
             "Session Cookie Disclosure in Flask",
             "Flask versions prior to 2.2.5 can leak secret keys or session cookies under specific caching configurations.",
             "Upgrade flask via `pip install flask>=2.2.5`."),
]

REQUIREMENT = r"^([a-zA-Z0-9_\-]+)\s*(?:==|>=|<=|~=)\s*([0-9.]+)"
MANIFEST = "dependencies map<string,string>, devDependencies map<string,string>"
RANGE_MARKS = r"[\^~>=<]"

TURNS = 16  # tasks that share the manifests with the same version of a package

RULE_OF = {"npm": "D01", "pypi": "D02"}
DEPENDENCY = "struct<ecosystem:string,package:string,raw:string,version:string,line_no:int,snippet:string,ordinal:int>"


def advisories_table(spark: SparkSession, advisories: Iterable[Advisory] = ADVISORIES) -> DataFrame:
    return spark.createDataFrame([astuple(a) for a in advisories], schemas.ADVISORIES)


def is_npm_manifest(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit("package.json"))


def is_pip_manifest(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit("requirements.txt"))


def is_manifest(path: Column) -> Column:
    return is_npm_manifest(path) | is_pip_manifest(path)


def _entries(mapping: Column) -> Column:
    """Entries as package and raw text; a JSON null reads as ``null``."""
    return F.transform(
        F.coalesce(F.map_entries(mapping), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(
            e["key"].alias("package"), F.coalesce(e["value"], F.lit("null")).alias("raw")
        ),
    )


def npm_entries(content: Column) -> Column:
    """Both maps one after the other, as written; bad JSON gives no entries."""
    return let(
        F.from_json(content, MANIFEST),
        lambda parsed: F.concat(_entries(parsed["dependencies"]), _entries(parsed["devDependencies"])),
    )


def npm_dependencies(entries: Column) -> Column:
    """One row per package: first place, last version, range marks dropped."""
    # Evaluated once each, not per entry; comparing entries only where names repeat.
    return let(entries, lambda e: let(_merged(e), _npm_rows))


def _merged(entries: Column) -> Column:
    """The first place and the last text of each package, by sorting; linear where no name repeats."""
    names = F.array_distinct(F.transform(entries, lambda e: e["package"]))

    def runs(placed):
        firsts = F.filter(placed, lambda e, i: (i == 0) | (F.get(placed, i - 1)["package"] != e["package"]))
        lasts = F.filter(
            placed, lambda e, i: (i == F.size(placed) - 1) | (F.get(placed, i + 1)["package"] != e["package"])
        )
        both = F.transform(
            F.arrays_zip(firsts.alias("a"), lasts.alias("b")),
            lambda z: F.struct(z["a"]["place"].alias("place"), z["a"]["package"].alias("package"), z["b"]["raw"].alias("raw")),
        )
        return F.transform(
            F.array_sort(both), lambda e: F.struct(e["package"].alias("package"), e["raw"].alias("raw"))
        )

    placed = F.array_sort(F.transform(
        entries, lambda e, i: F.struct(e["package"].alias("package"), i.alias("place"), e["raw"].alias("raw"))
    ))
    return F.when(F.size(names) == F.size(entries), entries).otherwise(let(placed, runs))


def _npm_rows(merged: Column) -> Column:
    return F.transform(
        merged,
        lambda e, i: F.struct(
            F.lit("npm").alias("ecosystem"),
            e["package"].alias("package"),
            e["raw"].alias("raw"),
            X.trim(F.regexp_replace(e["raw"], RANGE_MARKS, "")).alias("version"),
            F.lit(1).alias("line_no"),
            F.concat(F.lit('"'), e["package"], F.lit('": "'), e["raw"], F.lit('"')).alias("snippet"),
            i.alias("ordinal"),
        ),
    ).cast(f"array<{DEPENDENCY}>")


def pip_dependencies(content: Column) -> Column:
    """One row per pinned requirement; only the first bound of a line counts."""
    numbered = F.transform(
        X.split_lines(content),
        lambda line, i: F.struct((i + 1).alias("n"), X.trim(line).alias("t")),
    )
    pinned = F.filter(
        numbered,
        lambda x: ~F.startswith(x["t"], F.lit("#")) & X.matches(x["t"], REQUIREMENT),
    )
    return F.transform(
        pinned,
        lambda x: F.struct(
            F.lit("pypi").alias("ecosystem"),
            F.lower(X.extract(x["t"], REQUIREMENT, 1)).alias("package"),
            X.extract(x["t"], REQUIREMENT, 2).alias("raw"),
            X.extract(x["t"], REQUIREMENT, 2).alias("version"),
            x["n"].alias("line_no"),
            x["t"].alias("snippet"),
            F.lit(0).alias("ordinal"),
        ),
    ).cast(f"array<{DEPENDENCY}>")


def _dependency_item(rule_id: str, dep: Column, advisory: Column) -> Column:
    texts = {
        "package": dep["package"],
        "version": dep["version"],
        "fixed": advisory["fixed_version"],
        "cve": advisory["cve"],
        "title": advisory["title"],
        "about": advisory["about"],
        "advice": advisory["advice"],
    }
    return item(rule_id, dep["line_no"], dep["snippet"], texts, ordinal=dep["ordinal"],
                severity=advisory["severity"])


def _literal_advisories(advisories: list[Advisory], ecosystem: str) -> Column:
    """package -> advisory, first entry of a package wins."""
    pairs, seen = [], set()
    for a in advisories:
        name = a.package.lower()
        if a.ecosystem == ecosystem and name not in seen:
            seen.add(name)
            fields = ("fixed_version", "cve", "severity", "title", "about", "advice")
            pairs += [F.lit(name), F.struct(*[F.lit(getattr(a, f)).alias(f) for f in fields])]
    return F.create_map(*pairs)


def dependency_items(
    path: Column, content: Column, advisories: list[Advisory] = ADVISORIES
) -> Column:
    """Dependency findings of one file against a short list of advisories.

    All npm findings sit on line 1 under one weakness; the package tells them
    apart, so a full scan reports each.
    """

    def found(deps, ecosystem):
        known = _literal_advisories(advisories, ecosystem)
        matched = F.filter(
            F.transform(
                deps,
                lambda d: F.struct(
                    d.alias("dep"), F.try_element_at(known, F.lower(d["package"])).alias("adv")
                ),
            ),
            lambda m: m["adv"].isNotNull()
            & versions.less_than(m["dep"]["version"], m["adv"]["fixed_version"]),
        )
        rule_id = RULE_OF[ecosystem]
        return F.transform(matched, lambda m: _dependency_item(rule_id, m["dep"], m["adv"])).cast(NO_ITEMS)

    names = sorted({a.package.lower() for a in advisories if a.ecosystem == "npm"})
    listed = F.filter(npm_entries(content), lambda e: F.lower(e["package"]).isin(names))
    return (
        F.when(is_npm_manifest(path), found(npm_dependencies(listed), "npm"))
        .when(is_pip_manifest(path), found(pip_dependencies(content), "pypi"))
        .otherwise(no_items())
    )


def dependencies(files: DataFrame) -> DataFrame:
    """One row per declared dependency of every manifest."""
    path, content = F.col("file_path"), F.col("content")
    declared = F.when(is_npm_manifest(path), npm_dependencies(npm_entries(content))).otherwise(
        pip_dependencies(content)
    )
    return files.where(is_manifest(path)).select(
        *[c for c in files.columns if c not in ("content", "language", "size")],
        F.explode(declared).alias("dep"),
    )


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every vulnerable dependency against an advisory table of any size.

    An equi join on ecosystem and package, then the version test. One advisory
    per package is used: the one with the smallest ``rank`` where the table has
    that column, else the smallest CVE.
    """
    first = F.struct("rank", "cve") if "rank" in advisories.columns else F.col("cve")
    table = advisories.groupBy("ecosystem", F.lower("package").alias("package_key")).agg(
        F.min_by(F.struct(*[F.col(c) for c in advisories.columns]), first).alias("adv")
    )
    declared = dependencies(files)
    deps = declared.withColumns(
        {"ecosystem": F.col("dep.ecosystem"), "package_key": F.lower("dep.package")}
    )
    known = deps.join(table, ["ecosystem", "package_key"])
    hit = known.where(versions.less_than(F.col("dep.version"), F.col("adv.fixed_version")))
    keep = [c for c in declared.columns if c != "dep"]
    found = [
        F.when(F.col("dep.ecosystem") == name, _dependency_item(rule_id, F.col("dep"), F.col("adv")))
        for name, rule_id in RULE_OF.items()
    ]
    return hit.select(*keep, F.coalesce(*found).alias("item"))


def open_advisories(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every advisory that is open for a declared version: one row per dependency and advisory.

    ``advisories`` has ecosystem, package, introduced, fixed_version and what is to be
    told. An advisory is open from ``introduced`` (null: from the first version) up to
    but not including ``fixed_version`` (null: not fixed yet). Versions become keys that
    sort as the versions do. The intervals are tested once for each version that is
    declared of a package, not for each manifest that declares it; each dependency then
    takes the advisories of its version by an equi join, and tests none in vain. A version
    that most manifests declare is dealt to ``TURNS`` tasks.
    """
    other = [c for c in advisories.columns if c not in ("ecosystem", "package")]
    known = advisories.select(
        "ecosystem", F.lower("package").alias("package_key"), F.struct(*other).alias("advisory"),
        versions.key(F.col("introduced")).alias("low"), versions.key(F.col("fixed_version")).alias("high"),
    )
    names = ["ecosystem", "package_key", "version_key"]
    declared = dependencies(files).withColumns({
        "ecosystem": F.col("dep.ecosystem"), "package_key": F.lower("dep.package"), "version_key": versions.key(F.col("dep.version")),
    })
    told = declared.select(*names).distinct()
    inside = (
        (told["ecosystem"] == known["ecosystem"]) & (told["package_key"] == known["package_key"])
        & (F.col("low").isNull() | (F.col("low") <= F.col("version_key")))
        & (F.col("high").isNull() | (F.col("version_key") < F.col("high")))
    )
    open_ = told.join(known, inside).select(*[told[c] for c in names], "advisory")
    carried = [c for c in files.columns if c not in ("content", "language", "size")]
    # few bytes here become many rows, so the number of partitions is fixed, not advised by size
    tasks, cell = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*names, "turn"]
    turn = F.pmod(F.xxhash64("file_path", "dep.line_no", "dep.ordinal"), F.lit(TURNS)).cast("int")
    dealt = declared.withColumn("turn", turn).repartition(tasks, *cell)
    turns = F.explode(F.array(*[F.lit(n) for n in range(TURNS)]))
    return dealt.join(open_.withColumn("turn", turns).repartition(tasks, *cell), cell).select(*carried, "dep", "advisory")


def project_audit(files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Per repository: dependencies counted, vulnerable ones, and the total.

    The count reads the two npm maps apart (a package in both counts twice) and
    every pip line that is not blank and does not start with ``#``.
    """
    path, content = F.col("file_path"), F.col("content")
    lines = X.split_lines(content)
    counted = (
        F.when(F.endswith(path, F.lit("package.json")), _distinct_keys(content))
        .when(
            F.endswith(path, F.lit("requirements.txt")),
            F.size(F.filter(lines, lambda x: (X.trim(x) != "") & ~F.startswith(x, F.lit("#")))),
        )
        .otherwise(F.lit(0))
    )
    manifests = files.where(is_manifest(path))
    if advisories is None:
        open_items = F.size(dependency_items(path, content))
        sums = manifests.groupBy("repo").agg(
            F.sum(counted).cast("bigint").alias("declared"),
            F.sum(open_items).cast("bigint").alias("vulnerable_count"),
        )
    else:
        declared = manifests.groupBy("repo").agg(F.sum(counted).cast("bigint").alias("declared"))
        open_ = dependency_findings(files, advisories).groupBy("repo").agg(
            F.count("*").alias("vulnerable_count")
        )
        sums = declared.join(open_, "repo", "left").withColumn(
            "vulnerable_count", F.coalesce("vulnerable_count", F.lit(0).cast("bigint"))
        )
    return sums.select(
        "repo",
        F.greatest("declared", "vulnerable_count").alias("total_dependencies"),
        "vulnerable_count",
    )


def _distinct_keys(content: Column) -> Column:
    def keys(mapping):
        return F.coalesce(F.greatest(F.size(F.array_distinct(F.map_keys(mapping))), F.lit(0)), F.lit(0))

    total = let(
        F.from_json(content, MANIFEST),
        lambda parsed: keys(parsed["dependencies"]) + keys(parsed["devDependencies"]),
    )
    return F.coalesce(total, F.lit(0))
