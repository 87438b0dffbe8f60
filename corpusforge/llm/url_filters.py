"""URL filters: list rules first, then gradient-boosted trees on lexical features.

DataFrame and ML-pipeline operations only. The trees are trained on labelled URLs: by default a URL is unwanted
if its host names a known kind of unwanted site, and wanted if not; the rules' verdicts are no labels, as they don't say
what a page is. The number of training rows is bounded by ``sample_rows``, taken evenly from both classes by a hash of
the distinct URLs. Suffix statistics are counted over all labelled URLs but those of a host's own fold, so no host's label
comes back to it that way.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule, and is judged
by its (empty) features; without labelled URLs of both kinds the method allows; repeated rows get the
same result each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import LOWER, UPPER
from corpusforge.session import checkpointed

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Host words that label a URL as unwanted.
UNWANTED = ("pills", "casino", "adult", "porn", "viagra", "xxx", "bets", "bet365", "poker", "jackpot", "escort", "replica", "payday", "spam", "ads-", "adserver", "tracker")
#: The suffixes' table is broadcast while it has at most so many rows; beyond that its join is salted.
BROADCAST_ROWS = 200_000
FOLDS, SALTS = 5, 16
#: None tells one host from all others: trees that know a few hosts by heart say nothing of new ones.
FEATURES = ("url_chars", "path_chars", "query_chars", "depth", "labels", "digit_ratio", "hyphens", "params", "entropy", "tail_digits", "has_fragment", "is_https", "suffix_share", "suffix_log_n")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + p * F.log2(F.greatest(p, F.lit(1e-9))))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of a URL itself to (host, path, url)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    double = lambda c: c.cast("double")
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return urls.withColumns(
        {
            "suffix": F.array_join(F.slice(F.split(host, "\\."), F.greatest(F.size(F.split(host, "\\.")) - 1, F.lit(1)), F.lit(2)), "."),
            "url_chars": double(F.length(url)), "path_chars": double(F.length(path)), "query_chars": double(F.length(query)),
            "depth": double(F.size(F.split(path, "/"))), "labels": double(F.size(F.split(host, "\\."))),
            "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
            "hyphens": double(F.length(host) - F.length(F.replace(host, F.lit("-")))),
            "params": F.when(query == "", 0.0).otherwise(double(F.size(F.split(query, "&")))),
            "entropy": _entropy(url), "tail_digits": double(F.length(F.regexp_extract(path, "([0-9]*)[^0-9]*$", 1))),
            "has_fragment": double(url.contains("#").cast("int")), "is_https": double(url.startswith("https:").cast("int")),
        }
    )


def default_labels(host: Column) -> Column:
    """1 if the host names a known kind of unwanted site, else 0; null without a host."""
    unwanted = F.lit(False)
    for word in UNWANTED:
        unwanted = unwanted | host.contains(word)
    return F.when(host != "", unwanted.cast("double"))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, fold, suffix_share, suffix_log_n): the share of unwanted URLs and the number of URLs, without the hosts of that fold."""
    own = labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("own_bad"), F.count("*").alias("own_n"))
    every = own.groupBy("suffix").agg(F.sum("own_bad").alias("bad"), F.sum("own_n").alias("n"))
    folds = every.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))))
    rest = folds.join(own, ["suffix", "fold"], "left").select("suffix", "fold", (F.col("bad") - F.coalesce("own_bad", F.lit(0.0))).alias("bad"), (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"))
    return rest.select("suffix", "fold", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("suffix_share"), F.log1p("n").alias("suffix_log_n"))


def judge_urls(pages: DataFrame, label: Column | None = None, rules=RULES, sample_rows: int = 4000, trees: int = 8, depth: int = 3, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """host, path, rule, verdict and the trees' score for every row of ``pages`` (url).

    ``label`` gives 1.0 (block), 0.0 (allow) or null from url, host, path and suffix.
    """
    named = [F.col(k).alias(f"kept_{k}") for k in keep]
    rows = lexical(pages.select(*named, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    rows = rows.withColumn("label", default_labels(F.col("host")) if label is None else label)
    rows = checkpointed(rows)
    labelled = rows.where("label is not null")
    known = checkpointed(suffix_statistics(labelled))
    small = known.count() <= BROADCAST_ROWS

    def with_suffix(df: DataFrame) -> DataFrame:
        if small:
            joined = df.join(F.broadcast(known), ["suffix", "fold"], "left")
        else:
            salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            joined = df.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS))).join(salted, ["suffix", "fold", "salt"], "left").drop("salt")
        return joined.fillna({"suffix_share": 0.5, "suffix_log_n": 0.0})

    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    half = sample_rows // 2
    # Repeated URLs count once, so that one of them can't fill a class.
    wanted = ["label", "url", "suffix", "fold", *(f for f in FEATURES if not f.startswith("suffix_"))]
    distinct = labelled.select(*wanted).dropDuplicates(["url"])
    taken = [distinct.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(half) for v in (0.0, 1.0)]
    sample = checkpointed(assemble.transform(with_suffix(taken[0].union(taken[1]))).select("features", "label"))
    shown = [F.col(f"kept_{k}").alias(k) for k in keep]
    listed = F.col("fit.verdict")
    if sample.select("label").distinct().count() < 2:
        return rows.select(*shown, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(listed, F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, stepSize=0.3).fit(sample)
    scored = model.transform(assemble.transform(with_suffix(rows))).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(*shown, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(listed, method).alias("verdict"), "score")
