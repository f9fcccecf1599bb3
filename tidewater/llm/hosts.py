"""Rules on urls, and trust spread over the links between hosts, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: verdict by rule: a host with all its subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-4, 0.5
#: Host tables up to this many rows are sent to every executor; longer ones are joined by shuffle.
SENT_HOSTS = 100_000
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def with_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z in lower case) and path: both empty where the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def _rule_of(rules):
    """The longest rule that fits host and path, as (rule, verdict); null if none does."""
    out = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        hit = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links from host to another host in `href` attributes with a host of their own, counted."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")
    dst = F.translate("link", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = pages.filter("host <> ''").select(F.col("host").alias("src"), link).select("src", dst.alias("dst"))
    return found.filter("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def _spread(edges: DataFrame, seeds: DataFrame, damping: float, settled: float) -> DataFrame:
    """Personalised PageRank: (host, mass). seeds: (host, seed), edges: (src, dst, share).

    Mass is the sum over all walks from the seeds; a round takes the walks one link
    further, reduced map-side before the shuffle, and writes them to the shared folder.
    Rounds end when what is still under way is below `settled` and reaches no
    host for the first time, so that hosts at any distance get their mass. What hosts
    without links hold would go back to the seeds in proportion; leaving it out and
    bringing the sum to 1 at the end comes to the same.
    """
    start = written(seeds.filter("seed > 0").select("host", "seed"), "seeds")
    total = start.agg(F.sum("seed")).first()[0]
    if not total:
        return start.withColumnRenamed("seed", "mass")
    way = start.select("host", (F.col("seed") / total).alias("mass"))
    if edges.isEmpty():
        return way
    walks = way
    while True:
        met = edges.join(way, edges.src == way.host).select(F.col("dst").alias("host"), (F.col("share") * F.col("mass") * damping).alias("mass"))
        way = written(met.groupBy("host").agg(F.sum("mass").alias("mass")), "way")
        under_way = way.agg(F.sum("mass")).first()[0] or 0.0
        if under_way < settled and way.join(walks.select("host"), "host", "left_anti").isEmpty():
            break
        walks = written(walks.unionByName(way).groupBy("host").agg(F.sum("mass").alias("mass")), "walks")
    return walks.withColumn("mass", F.col("mass") / walks.agg(F.sum("mass")).first()[0])


def propagate(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust, score) of hosts that either reaches; score = trust / (trust + distrust).

    edges: (src, dst, links). Trust starts at trusted (host, seed) and follows
    links; distrust starts at blocked (host, seed) and goes against them, to hosts
    that link to blocked ones.
    """
    out_of = edges.groupBy("src").agg(F.sum("links").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    along = written(edges.join(out_of, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share")), "along")
    against = written(edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("all")).alias("share")), "against")
    trust = _spread(along, trusted, damping, settled).withColumnRenamed("mass", "trust")
    distrust = _spread(against, blocked, damping, settled).withColumnRenamed("mass", "distrust")
    both = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    return both.withColumn("score", F.col("trust") / (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of pages: page_id, host, path, rule, verdict, host_score.

    Where a rule fits, its verdict holds. Else the host is judged: hosts with more
    allowed than blocked pages are trusted seeds, hosts with more than half of
    their pages blocked are blocked seeds (by numbers of pages); a host is blocked
    if its score is below the threshold. Hosts that neither reaches, and pages
    without a host, have no score and are allowed. Repeated rows are judged alike;
    extra columns are ignored; an empty table gives no rows.
    """
    rows = with_url(pages.select("page_id", "url", "html")).withColumn("hit", _rule_of(rules))
    judged = written(rows.select("page_id", "host", "path", "hit"), "judged")
    per = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("hit.verdict") == "allow").alias("allowed"), F.count_if(F.col("hit.verdict") == "block").alias("blocked"))
    per = written(per, "hosts")
    trusted = per.filter("allowed > blocked").select("host", F.col("allowed").cast("double").alias("seed"))
    blocked = per.filter("2 * blocked > n").select("host", F.col("blocked").cast("double").alias("seed"))
    edges = written(host_edges(rows), "edges")
    scores = propagate(edges, trusted, blocked).select(F.col("host").alias("scored"), F.col("score").alias("host_score"))
    scores = written(scores, "scores")
    if scores.count() <= SENT_HOSTS:
        scores = F.broadcast(scores)
    out = judged.join(scores, judged.host == scores.scored, "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("host_score") < threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "host_score")
