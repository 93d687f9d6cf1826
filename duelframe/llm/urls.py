"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Trees learn from the URLs that rules decide (block 1, allow 0): distinct ones, at most about FIT_ROWS / 2 of each class
by hash, weighted by their rows and the class's share. Features: lengths, path depth, share of digits, character
entropy, parameter counts, marks, and the smoothed block rates of the host's last one and two labels, counted over all
rows that rules decide. A training row takes its rates from the other folds of URLs, so its own label is not in them.
Only DataFrame functions and Spark ML are used.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; trees judge it by its
text (null as empty). If the rules decide no URL, or all alike, there is nothing to learn: the verdict is then the
only one seen, ``allow`` if none. Among rules of equal length the first listed wins. Repeated rows each get a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.session import stage

from .common import checked_join

FIT_ROWS = 20_000
FOLDS = 10
TREES, DEPTH = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        """``allow org/`` or ``block example.org/es/``."""
        action, target = line.split()
        host, slash, rest = target.partition("/")
        return cls(action, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (text, action); null if none fits."""
    out = F.lit(None).cast("struct<text:string,action:string>")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = host & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def occurrences(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits per character; characters are counted by what is left without them."""
    n = F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    share = F.transform(kinds, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    total = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, total).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.lit(1), F.length(url))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": occurrences(path, "/"),
        "labels": occurrences(host, "."), "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")), "mark_ratio": F.length(F.regexp_replace(url, "[A-Za-z0-9/.:]", "")) / n,
        "dashes": occurrences(host, "-"), "entropy": entropy(url), "parameters": F.when(query == "", 0).otherwise(occurrences(query, "&") + 1),
        "values": occurrences(query, "="), "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
        "first_segment": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)), "secure": F.startswith(url, F.lit("https")).cast("int"),
    }


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS))


def suffix_counts(known: DataFrame, labels: int) -> tuple[DataFrame, DataFrame]:
    """Blocked and all rows by suffix, and the same by suffix and fold, over all of ``known`` (url, host, label, n)."""
    name = f"s{labels}"
    parts = known.groupBy(suffix(F.col("host"), labels).alias(name), fold_of(F.col("url")).alias("fold")).agg(
        F.sum(F.col("label") * F.col("n")).alias(f"fold_bad{labels}"), F.sum("n").alias(f"fold_n{labels}"))
    parts = stage(parts, f"suffix{labels}_folds")
    whole = parts.groupBy(name).agg(F.sum(f"fold_bad{labels}").alias(f"bad{labels}"), F.sum(f"fold_n{labels}").alias(f"n{labels}"))
    return stage(whole, f"suffix{labels}"), parts


def with_features(rows: DataFrame, counts: list[tuple[DataFrame, DataFrame]], train: bool = False) -> tuple[DataFrame, list[str]]:
    """``rows`` (url, host, path) with the features beside them; rates of ``train`` rows leave their own fold out."""
    columns = lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    out = rows.withColumns({c: e.cast("double") for c, e in columns.items()})
    names = list(columns)
    for labels, (whole, parts) in enumerate(counts, 1):
        out = checked_join(out.withColumn(f"s{labels}", suffix(F.col("host"), labels)), whole, f"s{labels}", "left")
        bad, n = F.coalesce(f"bad{labels}", F.lit(0)), F.coalesce(f"n{labels}", F.lit(0))
        if train:
            out = checked_join(out.withColumn("fold", fold_of(F.col("url"))), parts, [f"s{labels}", "fold"], "left")
            bad, n = bad - F.coalesce(f"fold_bad{labels}", F.lit(0)), n - F.coalesce(f"fold_n{labels}", F.lit(0))
        out = out.withColumns({f"rate{labels}": (bad + 1) / (n + 2), f"seen{labels}": F.log1p(n.cast("double"))})
        names += [f"rate{labels}", f"seen{labels}"]
    return out, names


def fit_sample(known: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """About FIT_ROWS / 2 distinct URLs of each class of ``known`` (url, label, n), all of a smaller class, with their ``weight``."""
    share = {c: min(1.0, FIT_ROWS / 2 / size) for c, size in sizes.items()}
    own = F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    drawn = F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < own * (1 << 40)
    return known.where(drawn).withColumn("weight", F.col("n") / own)


def judge(pages: DataFrame, rules: list[str], carry: list[str] | None = None) -> DataFrame:
    """``carry`` (page_id), host, path, rule, verdict and the trees' ``p_block`` for every row of ``pages`` (url)."""
    carry = carry or ["page_id"]
    parsed = [Rule.parse(r) for r in rules]
    rows = pages.select(*[F.col(c).alias(f"__llm_{c}") for c in carry], "url")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fit", rule_of(parsed))
    known = rows.where("fit is not null").select("url", "host", "path", (F.col("fit.action") == "block").cast("int").alias("label"))
    known = stage(known.groupBy("url", "host", "path", "label").agg(F.count("*").alias("n")), "url_known")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        out = rows.withColumn("p_block", F.lit(float(min(sizes, default=0))))
    else:
        counts = [suffix_counts(known, n) for n in (1, 2)]
        train, names = with_features(stage(fit_sample(known, sizes), "url_sample"), counts, train=True)
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        ready = assembler.transform(train).select("features", F.col("label").cast("double").alias("label"), "weight")
        ready = stage(ready, "url_features").coalesce(2)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64, weightCol="weight").fit(ready)
        scored, _ = with_features(rows, counts)
        out = model.transform(assembler.transform(scored)).withColumn("p_block", vector_to_array("probability")[1])
    guess = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select(*[F.col(f"__llm_{c}").alias(c) for c in carry], "host", "path", F.col("fit.text").alias("rule"),
                      F.coalesce("fit.action", guess).alias("verdict"), "p_block")
