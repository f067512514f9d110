"""URL filter: path rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides. Trees are trained (Spark ML, in the JVM) on a sample of them
bounded by ``TRAIN_ROWS``, taken by a hash of the url; suffix statistics cover all labelled URLs, in a table of at
most ``SUFFIX_BUCKETS`` rows, which is what gets broadcast. The trained trees become one SQL expression, so
scoring is a plain projection over the scan: no join but the broadcast, no Python.

A null url or one without ``://`` has empty host and path, and is judged by the trees. With labels of
one class only, that class is the verdict; with none, allow. Other columns are ignored; repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Expected size of the training sample at most.
TRAIN_ROWS = 100_000
#: Partitions of the training sample.
TRAIN_PARTS = 8
SUFFIX_BUCKETS = 4096
#: Weight of the overall rate in a suffix's rate, in rows.
PRIOR_ROWS = 20.0
TREES, DEPTH, STEP = 20, 4, 0.3


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is tested first, as it wraps the others
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _entropy(s: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(s).cast("double")
    terms = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.coalesce(F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))), F.lit(0.0))


def _count(s: Column, what: str) -> Column:
    return F.regexp_count(s, F.lit(what)).cast("double")


def suffix_bucket(host: Column) -> Column:
    """Bucket of a host's last two labels."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/[^/]"),
        "labels": _count(host, "[^.]+"),
        "digit_ratio": _count(u, "[0-9]") / n,
        "host_digits": _count(host, "[0-9]"),
        "hyphens": _count(host, "-"),
        "entropy": _entropy(u),
        "host_entropy": _entropy(host),
        "parameters": _count(u, "[?&][^=&#]+="),
        "fragment": u.contains("#").cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


SUFFIX_FEATURES = ("suffix_rate", "suffix_rows")


def _tree_sql(node, names: list[str]) -> str:
    """A trained tree's JVM node as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def train(labelled: DataFrame, names: list[str], train_rows: int = TRAIN_ROWS) -> str:
    """SQL for the score (over 0: block) of rows with feature columns ``names``; ``labelled`` has them, ``label`` and ``h`` (a hash)."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return "1.0D" if 1.0 in counts else "-1.0D"
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    share = min(1.0, train_rows / sum(counts.values()))
    sample = labelled if share == 1.0 else labelled.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = materialise(sample.select("label", *names).repartition(TRAIN_PARTS), "url-sample")  # boosting reads it again and again
    data = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=7).fit(data)
    trees = [_tree_sql(t._call_java("rootNode"), names) for t in model.trees]
    return " + ".join(f"{w!r}D * ({t})" for w, t in zip(model.treeWeights, trees))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the trees' margin (over 0: block)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, decided = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided, "bucket": suffix_bucket(F.col("host"))})
    blocked = (F.col("decided") == "block").cast("double")
    labelled = rows.where("decided IS NOT NULL").withColumn("label", blocked)
    by = labelled.groupBy("bucket").agg(F.sum("label").alias("b"), F.count("*").cast("double").alias("n"))
    total = labelled.agg(F.sum("label").alias("b"), F.count("*").alias("n")).first()
    prior = total["b"] / total["n"] if total["n"] else 0.0
    rate = (F.col("b") + PRIOR_ROWS * prior) / (F.col("n") + PRIOR_ROWS)
    small = F.broadcast(by.select("bucket", rate.alias("suffix_rate"), F.col("n").alias("suffix_rows")))  # SUFFIX_BUCKETS rows at most
    features = lexical(F.col("url"), F.col("host"), F.col("path"))

    def with_features(df: DataFrame) -> DataFrame:
        return df.join(small, "bucket", "left").withColumns(
            features | {"suffix_rate": F.coalesce("suffix_rate", F.lit(prior)), "suffix_rows": F.log1p(F.coalesce("suffix_rows", F.lit(0.0)))}
        )

    names = [*features, *SUFFIX_FEATURES]
    score = train(with_features(labelled).withColumn("h", F.xxhash64("url")).select("label", "h", *names), names, train_rows)
    judged = with_features(rows).withColumn("score", F.expr(score))
    verdict = F.coalesce("decided", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
