"""URL verdicts: rules first, then boosted trees over lexical features.

A rule is a host and the beginning of a path; it fits its host and all subdomains,
the longest that fits decides. Other URLs are judged by gradient-boosted trees (Spark's)
that learn from labelled URLs: the ones the rules decide unless other labels are
given. Features: lengths, depth, shares of digits, letters and signs, entropy of the
bytes, numbers of parameters, and statistics of suffixes: of the top-level domain,
the registered name, the whole host, the ending of the file and the first folder (the
place a site is rooted in), how many URLs of the whole table have it and which share
of its labelled ones is blocked. The suffixes are counted by hash in ``BUCKETS`` per
kind, so what is broadcast has the same size for any table; two suffixes of one bucket
share their numbers. A labelled URL sees shares of the other half of the labels
only (halves by hash of the URL), so that its own label isn't among its features.

Rules for odd rows: of a null URL or one without ``://`` host and path are empty, no
rule fits and the method judges it. Rows that repeat an id or URL are judged each.
Without labels of both kinds nothing can be learned: the verdict is that of all labels,
or ``allow`` without any, and the score 1 or 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.llm.features import DIGIT, FIT_ROWS, LETTER, share
from gritlens.llm.store import Stage
from gritlens.llm.textbuf import Texts, small_slices

TREES, DEPTH = 20, 4
BUCKETS = 4096  # of each kind of suffix

SUFFIXES = ["top", "name", "host", "ending", "folder"]
LEXICAL = [
    "length", "host_length", "path_length", "depth", "host_parts", "digits", "letters", "signs", "capitals", "entropy",
    "parameters", "equal_signs", "escapes", "hyphens", "fragment", "secure",
]
FEATURES = LEXICAL + [f"{kind}_{what}" for kind in SUFFIXES for what in ("count", "blocked", "known")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) for (verdict, ``host/path``) rules; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the longest is asked first, so it is put on last; of two of one text a block
    for decides, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, _, begins = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{begins}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def _suffixes(host: Column, path: Column) -> Column:
    """The bucket of each of ``SUFFIXES``."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    parts = [
        F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host,
        F.regexp_extract(file, r"\.([^.]*)$", 1), F.regexp_extract(path, r"^/([^/]*)/", 1),
    ]
    return F.array(*[F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int") for part in parts])


def parts_of(pages: DataFrame, url: str, rules: Sequence[tuple[str, str]], label: Column | None) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, blocked, half, buckets): what is known of each URL before the method."""
    rows = pages.select(
        F.col("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        (label if label is not None else F.lit(None)).cast("string").alias("label"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    known = F.coalesce("label", "ruled")
    return rows.select(
        "page_id", "url", "host", "path", "rule", "ruled",
        F.when(known.isNotNull(), (known == "block").cast("int")).alias("blocked"),
        F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(2)).cast("int").alias("half"),
        _suffixes(F.col("host"), F.col("path")).alias("buckets"),
    )


class Counts:
    """Of each bucket: URLs, and labelled and blocked ones of either half."""

    def __init__(self, parts: DataFrame):
        shape = (len(SUFFIXES), BUCKETS)
        self.urls, self.labelled, self.blocked = np.zeros(shape), np.zeros((2, *shape)), np.zeros((2, *shape))
        counted = parts.select("blocked", "half", F.posexplode("buckets").alias("kind", "bucket")).groupBy("kind", "bucket", "half")
        # as many rows as kinds, buckets and halves, whatever the table
        for r in counted.agg(F.count("*").alias("n"), F.count("blocked").alias("known"), F.sum("blocked").alias("blocked")).collect():
            self.urls[r["kind"], r["bucket"]] += r["n"]
            self.labelled[r["half"], r["kind"], r["bucket"]] = r["known"]
            self.blocked[r["half"], r["kind"], r["bucket"]] = r["blocked"] or 0
        known = self.labelled[:, 0].sum()
        self.mean = self.blocked[:, 0].sum() / known if known else 0.0

    def features(self, buckets: np.ndarray, half: np.ndarray | None) -> np.ndarray:
        """Log of the count, smoothed share of blocked ones, log of labelled ones; ``half`` is left out of the latter two."""
        found = []
        for kind in range(len(SUFFIXES)):
            at = buckets[:, kind]
            labelled, blocked = self.labelled[:, kind, at], self.blocked[:, kind, at]
            if half is not None:
                other = np.arange(2)[:, None] != half
                labelled, blocked = labelled * other * 2, blocked * other * 2
            labelled, blocked = labelled.sum(axis=0), blocked.sum(axis=0)
            found += [np.log1p(self.urls[kind, at]), (blocked + 2 * self.mean) / (labelled + 2), np.log1p(labelled)]
        return np.column_stack(found)


def lexical(urls: Texts, hosts: Texts, paths: Texts) -> np.ndarray:
    """The columns of ``LEXICAL``, one row per URL."""
    n, byte = len(urls), np.arange(256)
    size = np.diff(urls.offsets)
    text = np.repeat(np.arange(n), size)
    count = np.bincount(text * 256 + urls.data, minlength=n * 256).reshape(n, 256)
    p = count / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    is_ = lambda c: count[:, ord(c)]
    letters, digits = count[:, LETTER].sum(axis=1), count[:, DIGIT].sum(axis=1)
    secure = np.zeros(n)
    long_ = size >= 5
    secure[long_] = (urls.data[urls.offsets[:-1][long_] + 4] | 32) == ord("s")
    slashes, dots = paths.counts(byte == ord("/")), hosts.counts(byte == ord("."))
    return np.column_stack([
        np.log1p(size), np.diff(hosts.offsets), np.log1p(np.diff(paths.offsets)), slashes, dots,
        share(digits, size), share(letters, size), share(size - letters - digits, size),
        share(count[:, 65:91].sum(axis=1), letters), entropy, is_("?") + is_("&"), is_("="), is_("%"), is_("-"), is_("#"), secure,
    ]).astype(np.float64)


def _with_features(counts: Counts, training: bool):
    """(the columns before ``buckets`` but url and half, and ``features``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, urls in small_slices(batch, 1):
                buckets = rows.column("buckets").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SUFFIXES))
                half = rows.column("half").to_numpy(zero_copy_only=False) if training else None
                flat = np.hstack([
                    lexical(urls, Texts.of(rows.column("host")), Texts.of(rows.column("path"))), counts.features(buckets, half),
                ])
                features = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel())
                )
                names = [n for n in rows.schema.names if n not in ("url", "half", "buckets")]
                yield pa.record_batch([*[rows.column(n) for n in names], features], names=[*names, "features"])

    return run


class Model:
    """Counts of suffixes and trees; ``score`` adds the column ``score``, the likelihood of a block."""

    def __init__(self, parts: DataFrame, stage: Stage, fit_rows: int = FIT_ROWS):
        self.counts, self.trees = Counts(parts), None
        labelled = parts.filter("blocked is not null")
        many = int(self.counts.labelled[:, 0].sum())
        if many > fit_rows:
            labelled = labelled.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(many)) < fit_rows)
        fit = stage.keep(
            self._featured(labelled, True).select(F.col("blocked").cast("double").alias("label"), array_to_vector("features").alias("features"))
            .repartition(4, F.xxhash64("label", F.col("features").cast("string"))).sortWithinPartitions(F.col("features").cast("string")),
            "fit",
        )
        if fit.agg(F.countDistinct("label")).first()[0] == 2:
            self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=5, seed=1).fit(fit)
        stage.drop(fit)

    def _featured(self, parts: DataFrame, training: bool) -> DataFrame:
        kept = [f for f in parts.schema if f.name not in ("url", "half", "buckets")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", features array<double>"
        return parts.mapInArrow(_with_features(self.counts, training), schema)

    def score(self, parts: DataFrame) -> DataFrame:
        rows = self._featured(parts, False)
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.counts.mean > 0.5))).drop("features")
        found = self.trees.transform(rows.withColumn("features", array_to_vector("features")))
        return found.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", label: Column | None = None, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row; ``score`` is the method's, also where a rule decides.

    ``label`` (``allow``, ``block`` or null) says what is known of a URL besides the rules.
    """
    stage = Stage(pages.sparkSession, "urls")
    parts = stage.keep(parts_of(pages, url, rules, label), "parts")
    scored = Model(parts, stage, fit_rows).score(parts)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
