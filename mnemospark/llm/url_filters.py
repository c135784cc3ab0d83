"""URL filters: rules by host and path, and trust and distrust that spread over the links between hosts.

A page's rule decides where one fits. What is left goes by its host: hosts with allowed pages are trusted seeds, hosts
with blocked pages are blocked seeds, each by the share of its pages. Trust spreads along links by personalised
PageRank, distrust against them, as who links to bad hosts is suspect. Both are taken as a share of what reaches a
host from all hosts alike, so that they do not shrink as the graph grows; a threshold on them decides each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import blank, materialize, split_join

#: Share of a host's mass that follows its links; the rest starts anew from the seeds.
DAMPING = 0.85
#: Rounds of propagation: what further rounds would move is at most DAMPING ** (ROUNDS + 1) of the seeds' mass.
ROUNDS = 20
#: Rounds whose plan runs as one job; then the scores are written.
ROUNDS_OF_JOB = 5
#: Score of a whole seed. Scores are integers, so that no sum hangs on its order.
UNIT = 1_000_000_000
#: A host is blocked where its distrust, a share of 0 to 1, is at least this and exceeds its trust.
BLOCK_SHARE, MILLION = 0.6, 1_000_000
#: Labels of the longest host name; longer ones have no parents.
MOST_LABELS = 127

#: An absolute link: all attributes named href, with or without quotes and scheme.
LINK = "[hH][rR][eE][fF][ \\t\\n\\f\\r]{0,20}=[ \\t\\n\\f\\r]{0,20}[\"']?[ \\t\\n\\f\\r]{0,20}(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<> \\t\\n\\f\\r]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and ruled (its verdict) to rows (host, path, ...): of the rules (host, path, verdict) whose host is the
    row's or one that holds it, and whose path begins the row's, the longest; of equally long ones that of the longer
    host, and a block before an allowance. Only the hosts' own rules travel: a host meets the table once."""
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", "\\."))), F.lit(0))).first()[0]
    if not deepest:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    hosts = pages.select("host").distinct()
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, deepest + 1)]))
    rule = F.struct((F.char_length("r.host") + F.char_length("r.path")).alias("long"), F.char_length("r.host").alias("host_long"), F.col("r.verdict").alias("verdict"), F.col("r.host").alias("host"), F.col("r.path").alias("path"))
    tails = hosts.select(F.col("host").alias("__h"), F.explode(ends).alias("__end"))
    own = tails.join(rules.distinct().alias("r"), F.col("__end") == F.col("r.host")).groupBy(F.col("__h").alias("host")).agg(F.collect_list(rule).alias("__rules"))
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"])))
    joined = split_join(pages, own, "host", "left").withColumn("__best", best)
    return joined.withColumns({"rule": F.concat("__best.host", "__best.path"), "ruled": F.col("__best.verdict")}).drop("__rules", "__best")


def parent_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, links): each host and the domain that holds it, both ways, one link each, up to domains of two labels.

    A domain answers for its subdomains: m.site.example stands next to www.site.example. Addresses of numbers and
    names of over MOST_LABELS labels have no parents.
    """
    labels = F.size(F.split("host", "\\."))
    named = hosts.where((labels > 2) & (labels <= MOST_LABELS) & ~F.col("host").rlike("(^|\\.)[0-9][^.]*$"))
    chain = named.select(F.explode(F.transform(F.sequence(F.lit(3), labels), lambda k: F.struct(_end("host", k).alias("src"), _end("host", k - 1).alias("dst")))).alias("e"))
    up = chain.select("e.src", "e.dst").distinct()
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("links", F.lit(1).cast("bigint"))


def _end(host: str, labels: Column) -> Column:
    """The last so many labels of a host."""
    parts = F.split(host, "\\.")
    return F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, of pages (host, html)."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(blank(html), F.lit(LINK), 1)).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def _shares(links: DataFrame, seeds: DataFrame, a: str, b: str, mark: str) -> DataFrame:
    """(a, b, share): the share of a's mass that goes to b, for nodes marked as those of one direction; what rules judge of b takes none."""
    whole = links.groupBy(a).agg(F.sum("links").alias("whole"))
    open_ = seeds.select(F.col("host").alias(b), (1 - F.col("trust") - F.col("distrust")).alias("rest"))
    part = split_join(split_join(links, whole, a), open_, b, "left")
    share = F.col("links").cast("double") / F.col("whole") * F.coalesce("rest", F.lit(1.0))
    return part.select(F.concat(F.lit(mark), a).alias("a"), F.concat(F.lit(mark), b).alias("b"), share.alias("share")).where("share > 0")


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, trust_all, distrust, distrust_all): what reaches each host over links (src, dst, links) from seeds (host, trust, distrust), shares of 0 to 1.

    score = (1 - DAMPING) * seed + DAMPING * what arrives, for trust along the links and for distrust against them; the
    second of each is the same with every host as a whole seed. What rules judge of a host takes nothing from its
    links, so that a blocked host passes on its own distrust alone. What arrives is returned, without a host's own seed.
    The two directions are parts of one graph without a link between them, so that a round is one join and one sum. A
    host with very many links is split in the join; sums are taken before they are shuffled.
    """
    edges = materialize(_shares(links, seeds, "src", "dst", "t").unionByName(_shares(links, seeds, "dst", "src", "d")))
    start = lambda mark, c: seeds.select(F.concat(F.lit(mark), "host").alias("node"), _units(F.col(c).cast("double") * (UNIT * (1 - DAMPING)) + 0.5).alias("seeded"), _units(F.lit(UNIT * (1 - DAMPING) + 0.5)).alias("all"))
    base = materialize(start("t", "trust").unionByName(start("d", "distrust")))
    scores = base
    for done in range(1, rounds + 1):
        moved = split_join(edges, scores.withColumnRenamed("node", "a"), "a")
        moved = moved.select(F.col("b").alias("node"), *[_units(F.col(c).cast("double") * F.col("share") * DAMPING).alias(c) for c in ("seeded", "all")])
        if done < rounds:
            moved = moved.unionByName(base)
        scores = moved.groupBy("node").agg(F.sum("seeded").alias("seeded"), F.sum("all").alias("all"))
        if done % ROUNDS_OF_JOB == 0 or done == rounds:
            scores = materialize(scores)
    of = lambda mark, c: F.coalesce(F.sum(F.when(F.substring("node", 1, 1) == mark, F.col(c))), F.lit(0))
    return scores.groupBy(F.expr("substring(node, 2)").alias("host")).agg(of("t", "seeded").alias("trust"), of("t", "all").alias("trust_all"), of("d", "seeded").alias("distrust"), of("d", "all").alias("distrust_all"))


def _units(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def host_shares(seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """(host, trust, distrust) in millionths: the share of its pages that rules judge so, and for the rest of them the share of what its links bring that comes from such seeds."""
    rest = 1 - F.col("s.trust") - F.col("s.distrust")
    share = lambda c: F.col(f"s.{c}") + rest * F.coalesce(F.try_divide(F.col(f"a.{c}"), F.col(f"a.{c}_all")), F.lit(0.0))
    joined = seeds.alias("s").join(scores.alias("a"), "host", "left")
    return joined.select("host", *[_units(share(c) * MILLION + 0.5).alias(c) for c in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, host, path, rule, verdict (allow or block), trust, distrust (its host's, in millionths).

    ``rules``: (host, path, verdict), few beside the hosts but of any number. A page that no rule fits is judged by its
    host: blocked where distrust is at least BLOCK_SHARE and exceeds trust, else allowed. A null url, or one without
    ``://``, has an empty host and path, which no rule fits and no link reaches: allowed. A null or empty html has no
    links. Repeated rows count and return as they are, null keys too; an empty table gives none.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    judged = materialize(with_rules(rows, rules))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    seeds = materialize(hosts.select("host", (F.col("allowed") / F.col("pages")).alias("trust"), (F.col("blocked") / F.col("pages")).alias("distrust")))
    linked = host_links(pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")))
    links = materialize(linked.unionByName(parent_links(seeds.select("host"))).groupBy("src", "dst").agg(F.sum("links").alias("links")))
    out = split_join(judged, host_shares(seeds, spread(links, seeds)), "host", "left")
    bad = F.coalesce((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= round(BLOCK_SHARE * MILLION)), F.lit(False))
    score = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), score("trust"), score("distrust"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, ``host/path``) as a table (host, path, verdict); the path begins with the first slash."""
    rows = [(rule.partition("/")[0], rule[len(rule.partition("/")[0]) :], verdict) for verdict, rule in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")
