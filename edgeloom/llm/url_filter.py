"""URL filters: rules first, then the ratio of two character language models. DataFrame functions only.

URLs that a rule allows or blocks are the accepted and rejected text that two variable-order Markov
models learn from, over all rows. A model of order n interpolates down to the uniform distribution
(Witten-Bell): P(c | context) = (n(context c) + t(context) P(c | shorter context)) / (n(context) +
t(context)), t being the number of different characters seen there, so unseen contexts fall through
to shorter ones. A URL's score is the mean log-likelihood difference over its characters and an end
mark. Three sixteenths of the distinct URLs, by hash, are held out of the models; the threshold is the
one that tells accepted from rejected URLs among these best (sum of both hit rates).

Each distinct URL is cut into windows once; window counts are aggregated before any join, models
are tables of distinct windows that grow with the corpus and are joined, never broadcast by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, lower_ascii

ORDER, BIN = 5, 0.01
#: First hex digits of the MD5 of texts that the threshold is set on and the models don't see.
HELD_OUT = ("0", "1", "2")
#: A text of one row in so many or more is hot; that many texts can be hot at most.
HOT_SHARE = 200
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_PAD, _STOP = "\x02", "\x03"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, name, verdict) of the longest rule that fits, or null; ties go to the first in name."""
    found = F.lit(None)
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _windows(texts: DataFrame, order: int) -> DataFrame:
    """texts with one row per character and end mark, window holding it and the order - 1 before."""
    padded = F.concat(F.lit(_PAD * (order - 1)), F.col("text"), F.lit(_STOP))
    rows = texts.withColumn("padded", padded).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") + 1)))
    return rows.withColumn("window", F.substring(F.col("padded"), F.col("at"), F.lit(order))).drop("padded", "at", "text")


def log_ratios(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """(window, ratio): log P_accepted - log P_rejected of each window(window, accepted, rejected)."""
    table = None
    for k in range(1, order + 1):
        gram = F.substring(F.col("window"), order - k + 1, k)
        level = windows.groupBy(gram.alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        context = W.partitionBy(F.substring("gram", 1, k - 1))
        if table is not None:
            level = level.withColumn("shorter", F.substring("gram", 2, k - 1)).join(table, "shorter")
        for side in ("accepted", "rejected"):
            lower = F.lit(1.0 / 256) if table is None else F.col(f"{side}_p")
            seen, kinds = F.sum(side).over(context), F.sum((F.col(side) > 0).cast("long")).over(context)
            level = level.withColumn(f"{side}_q", F.when(seen > 0, (F.col(side) + kinds * lower) / (seen + kinds)).otherwise(lower))
        table = level.select(F.col("gram").alias("shorter"), F.col("accepted_q").alias("accepted_p"), F.col("rejected_q").alias("rejected_p"))
    return table.select(F.col("shorter").alias("window"), (F.log("accepted_p") - F.log("rejected_p")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The score from which on accepted text is told from rejected best; 0 if there is only one of them."""
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).where("a + r > 0")
    rows = bins.orderBy("bin").collect()  # as many rows as there are bins of 0.01 nats within the models' range
    a, r = sum(x.a for x in rows), sum(x.r for x in rows)
    if not a or not r:
        return 0.0
    best, at, below_a, below_r = -1.0, 0.0, 0, 0
    for x in rows:
        gain = (a - below_a) / a + below_r / r
        if gain > best:
            best, at = gain, x.bin * BIN
        below_a, below_r = below_a + x.a, below_r + x.r
    return at


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules=RULES, order: int = ORDER) -> DataFrame:
    """One row per page row: (id, host, path, rule, verdict, score).

    host stands after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path follows
    up to "?", "#" or the end; both are empty for a null URL or one without "://". The longest rule
    whose host is the URL's or a parent domain of it, and whose path starts the URL's, gives rule and
    verdict; otherwise rule is null and the models decide: allow from the threshold on, which is 0
    unless both accepted and rejected URLs are held out. Every URL has a score, long ones over their
    whole length; a null URL scores as an empty one. Repeated rows are answered alike; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(lower_ascii(F.col(url_col).cast("string")), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.regexp_replace(text, "^[^:/?#]*://", "").alias("text"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("rule")["verdict"]
    texts = rows.groupBy("text").agg(F.count_if(verdict == "allow").alias("accepted"), F.count_if(verdict == "block").alias("rejected"), F.count("*").alias("n"))
    texts = cut(texts.withColumns({"key": F.struct(F.xxhash64("text"), F.hash("text")), "held": F.substring(F.md5("text"), 1, 1).isin(*HELD_OUT)}))
    seen = [F.when(F.col("held"), 0).otherwise(F.col(c)).alias(c) for c in ("accepted", "rejected")]
    cuts = _windows(texts.select("key", "text", *seen), order)
    ratios = log_ratios(cuts.groupBy("window").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), order)
    scores = cuts.select("key", "window").join(ratios, "window").groupBy("key").agg((F.sum("ratio") / F.count("*")).alias("score"))
    scored = cut(texts.join(scores, "key").select("text", "accepted", "rejected", "held", "n", "score"))
    at = F.lit(_threshold(scored.where("held")))
    total = scored.agg(F.sum("n")).first()[0] or 0
    hot = scored.where(F.col("n") * HOT_SHARE >= total).select("text", F.col("score").alias("hot"))
    found = rows.join(F.broadcast(hot), "text", "left")  # so that no task gets all rows of a frequent URL
    judged = found.where("hot IS NOT NULL").withColumn("score", F.col("hot")).unionByName(found.where("hot IS NULL").join(scored.select("text", "score"), "text"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("rule")["name"].alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
