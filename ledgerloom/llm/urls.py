"""URL filters: host and path rules, and a character language-model ratio [native].

URLs that a rule decides are the examples: those allowed and those blocked each
train a variable-order Markov model of characters. The orders are 0 to 3; a
context's distribution is smoothed with that of the next shorter one (as many
added counts as ``WEIGHT``), so a context never seen falls back on it. Any
other URL is judged by the difference of its two log-likelihoods over its
length; the threshold is calibrated on the examples.

Everything is DataFrame functions. Letters are folded to 32 symbols, so the
models have at most 32^4 numbers whatever the size of the input; they travel as
one array from a scalar subquery, and scoring shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: (host, path prefix, verdict), the rules of the query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Added counts of the shorter context's distribution.
WEIGHT = 4.0
#: Symbols: end of text, a-z, 0 for digits, and . / - and _ for all else.
_SYMBOLS = "$" + LOWER + "0./-_"
_N, _CONTEXTS = 32, 32**3
#: Steps of the calibrated threshold, in log-likelihood a character.
_STEP = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    # a query or fragment right after the host leaves no path
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (host plus path) that fits; null if none does.

    A rule fits its host and all subdomains, where the path starts with its own. Of
    equally long rules the first in the list wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][0]) + len(rules[i][1]), -i))
    for h, p, v in (rules[i] for i in order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _codes(url: Column) -> Column:
    """The URL's symbols as numbers 0 to 31, closed by the end."""
    folded = F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]", "0"), "[^a-z0./-]", "_")
    each = F.filter(F.split(folded, ""), lambda c: c != "")
    return F.concat(F.transform(each, lambda c: F.instr(F.lit(_SYMBOLS), c) - 1), F.array(F.lit(0)))


def _windows(codes: Column) -> Column:
    """For each symbol the number of its three predecessors and itself, base 32 (ends stand before the text)."""
    before = lambda i, k: F.when(i > k, F.element_at(codes, F.greatest(i - k, F.lit(1)))).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(codes)), lambda i: (((before(i, 3) * _N + before(i, 2)) * _N + before(i, 1)) * _N + F.element_at(codes, i)).cast("int"))


def ratio_table(examples: DataFrame, url: str, accepted: Column) -> DataFrame:
    """One row with ``ratios``: for each context of three symbols and each symbol the
    logarithm of its probability if accepted over that if rejected (32^4 doubles)."""
    spark = examples.sparkSession
    # the codes are a column of their own: inside the lambda they would be made anew for each symbol
    coded = examples.select(accepted.alias("yes"), _codes(F.col(url)).alias("__c"))
    seen = coded.select("yes", F.explode(_windows(F.col("__c"))).alias("w")).groupBy("w").agg(F.sum(F.col("yes").cast("double")).alias("a"), F.sum((~F.col("yes")).cast("double")).alias("r"))
    # counts by order: o symbols of context, symbol s
    orders = seen.select(F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.pmod("w", F.lit(_N ** (o + 1))).alias("g"), "a", "r") for o in range(4)])).alias("x")).select("x.*")
    counts = orders.groupBy("o", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    level = lambda o: spark.range(_N ** (o + 1)).select(F.col("id").cast("int").alias("g")).join(counts.filter(F.col("o") == o).drop("o"), "g", "left").select("g", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("r", F.lit(0.0)).alias("r"), F.shiftright("g", 5).alias("c"))
    below = None
    for o in range(4):
        own = level(o)
        totals = own.groupBy("c").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        own = own.join(totals, "c")
        if below is None:
            pa_, pr_ = F.lit(1.0 / _N), F.lit(1.0 / _N)
        else:
            own = own.withColumn("b", F.pmod("g", F.lit(_N**o)).cast("int")).join(below, "b")
            pa_, pr_ = F.col("pa"), F.col("pr")
        below = own.select(F.col("g").alias("b"), ((F.col("a") + WEIGHT * pa_) / (F.col("ta") + WEIGHT)).alias("pa"), ((F.col("r") + WEIGHT * pr_) / (F.col("tr") + WEIGHT)).alias("pr"))
    rows = below.select(F.shiftright("b", 5).alias("c"), F.struct("b", F.log(F.col("pa") / F.col("pr")).alias("x")).alias("e")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]).alias("xs"))
    # 32^3 contexts of 32 numbers, however large the input
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "xs"))), lambda e: e["xs"])).alias("ratios"))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, score and verdict (allow or block) to every row.

    A rule's verdict stands; all other URLs go by the models' ratio (``score``), trained
    on the distinct URLs that rules decide. A null or malformed URL has an empty host and path and is
    judged by its text (null: empty). With no examples of a kind all scores are 0 and the verdict
    is allow. Repeated rows each get the same result; columns named like an output are replaced, others stay.
    """
    host, path = host_and_path(F.col(url))
    parted = pages.withColumns({"host": host, "path": path})
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.withColumns({"rule": text, "__v": verdict})
    examples = ruled.filter("__v is not null").groupBy(F.col(url).alias("__u")).agg(F.first("__v").alias("v")).withColumn("yes", F.col("v") == "allow")
    ratios = ratio_table(examples, "__u", F.col("yes"))

    def scored(df: DataFrame, url: str) -> DataFrame:
        """Add ``score``: the mean log ratio of the URL's symbols (0 where there is no model)."""
        with_all = df.withColumn("__c", _codes(F.col(url))).withColumns({"__r": ratios.scalar(), "__w": _windows(F.col("__c"))})
        total = F.aggregate("__w", F.lit(0.0), lambda acc, w: acc + F.element_at("__r", w + 1))
        return with_all.withColumn("score", F.coalesce(total / F.size("__w"), F.lit(0.0))).drop("__c", "__r", "__w")

    # calibration: the threshold with the most balanced accuracy over the examples, in steps; the middle of the best
    # a number of partitions that is given stays: few bytes take long to score
    spread = examples.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__u")
    steps = scored(spread, "__u").select(F.floor(F.col("score") / _STEP).cast("long").alias("bin"), "yes").groupBy("bin").agg(F.sum(F.col("yes").cast("double")).alias("a"), F.sum((~F.col("yes")).cast("double")).alias("r"))
    bins = steps.agg(F.array_sort(F.collect_list(F.struct("bin", "a", "r"))).alias("s"), F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + e[f])
    gain = F.transform("s", lambda b: F.struct(
        (total(F.filter("s", lambda e: e["bin"] >= b["bin"]), "a") / F.greatest("ta", F.lit(1.0)) + total(F.filter("s", lambda e: e["bin"] < b["bin"]), "r") / F.greatest("tr", F.lit(1.0))).alias("g"), b["bin"].alias("bin")))
    best = bins.select(F.when((F.col("ta") > 0) & (F.col("tr") > 0), F.element_at(F.array_sort(gain), -1)["bin"] * _STEP).alias("t"))
    judged = scored(ruled, url).withColumn("__t", F.coalesce(best.scalar(), F.lit(-1e9)))
    own = F.when(F.col("score") >= F.col("__t"), "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce("__v", own)).drop("__v", "__t")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the rules, else by the models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op3_urls": op3_urls}
ORACLES: dict[str, str] = {}
