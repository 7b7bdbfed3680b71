"""URL filter: fixed rules first, then a path-template tree per host (native DataFrame code).

Rules name a host and the beginning of a path, with a verdict; a rule fits its host and all
subdomains, the longest one that fits decides. Other pages get the verdict of the tree.

The tree: runs of digits and long hexadecimal strings in a path are wildcards by their kind. Pages are
counted by host and such a masked path (partial aggregation, so hot hosts shrink where they lie). Level
by level, a node with many children of which most are rare is variable: its rare children
become the one child ``*``. Every node has its labelled pages and the bad ones among them. A branch whose share of bad
pages doesn't differ from its siblings' (two-proportion z-test) is merged with them: pages are judged by
the deepest branch that does differ, and by the host or by all pages if none does. The share is smoothed
with the share of the level above as if ``WEIGHT`` more pages had it; a template is rejected if its smoothed share of
bad pages is at least ``PURITY``.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; labels with a null
id or value are ignored, repeated ones of one id count once (the worst); without labels nothing is
rejected; repeated rows count as pages each; an empty table gives an empty result; every segment of a
path is a level of its own, so the deepest path sets the number of rounds; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.tables import written

# Fixed rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEPTH = 4                 # levels that the SQL spells out; the tree has a level for every segment
MANY_CHILDREN = 12        # distinct children from which on a node may be variable
LITERAL_SHARE = 0.05      # of a variable node's pages: children above stay literal
Z = 2.576
WEIGHT = 10.0
PURITY = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):   # longer ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def masked(path: Column) -> Column:
    """The path with digits and long hexadecimal strings as wildcards."""
    hexed = F.regexp_replace(path, r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{12,}\b", "{h}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def _templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, masked, n, labelled, bad) with ``nodes``: the template of each level's node.

    One round per level, over the paths that reach it, down to the deepest segment.
    """
    rows = paths.withColumns({"segments": F.slice(F.split("masked", "/"), 2, (1 << 31) - 1),
                              "node": F.lit(""), "nodes": F.array().cast("array<string>")})
    columns = ["host", "masked", "n", "labelled", "bad", "segments", "node", "nodes"]
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    done = []
    for level in range(deepest):
        done.append(rows.where(F.size("segments") <= level).select(columns))
        here = rows.where(F.size("segments") > level).withColumn("child", F.get("segments", F.lit(level)))
        children = here.groupBy("host", "node", "child").agg(F.sum("n").alias("__n"))
        nodes = children.groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("__kinds"), F.sum("__n").alias("__all"))
        # One row per node and literal child: everything else of a variable node is the wildcard.
        literal = children.join(nodes, ["host", "node"]).where(
            (F.col("__kinds") < MANY_CHILDREN) | (F.col("__n") >= LITERAL_SHARE * F.col("__all"))).select(
            "host", "node", "child", F.lit(True).alias("__literal"))
        step = here.join(literal, ["host", "node", "child"], "left")
        name = F.concat("node", F.lit("/"), F.when(F.col("__literal"), F.col("child")).otherwise(F.lit("*")))
        rows = step.withColumn("node", name).withColumn("nodes", F.concat("nodes", F.array("node")))
        rows = written(rows.select(columns), "url-level")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _different(n: Column, bad: Column, n2: Column, bad2: Column) -> Column:
    """Two-proportion z-test of a branch against its siblings."""
    pool = F.try_divide(bad + bad2, n + n2)
    spread = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), n2)))
    return (spread > 0) & (F.abs(F.try_divide(bad, n) - F.try_divide(bad2, n2)) >= Z * spread)


def tree(pages: DataFrame) -> DataFrame:
    """host, masked, template and smoothed ``purity`` (share of bad pages) of every masked path.

    ``pages``: host, path, ``bad`` (null without a label).
    """
    paths = written(pages.groupBy("host", masked(F.col("path")).alias("masked")).agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
        F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0).cast("long"))).alias("bad")), "url-paths")
    rows = written(_templates(paths).select("host", "masked", "labelled", "bad", F.concat(
        F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("node"))),
        F.transform("nodes", lambda x, i: F.struct((i + 1).alias("level"), x.alias("node")))).alias("chain")),
        "url-templates")
    each = rows.select("host", "masked", "labelled", "bad", F.posexplode("chain").alias("i", "c"), "chain").select(
        "host", "masked", "labelled", "bad", F.col("c.level").alias("level"), F.col("c.node").alias("node"),
        F.when(F.col("i") > 0, F.get("chain", F.col("i") - 1)["node"]).alias("parent"))
    stats = written(each.groupBy("host", "level", "node", "parent").agg(
        F.sum("labelled").alias("n"), F.sum("bad").alias("b")), "url-nodes")
    everything = stats.where("level = 0").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))  # one row
    up = stats.select("host", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"),
                      F.col("n").alias("up_n"), F.col("b").alias("up_b"))
    known = stats.join(up, ["host", "level", "parent"], "left").join(F.broadcast(everything))
    whole_n, whole_b = F.coalesce("up_n", "all_n"), F.coalesce("up_b", "all_b")
    above = F.coalesce(F.try_divide(whole_b, whole_n), F.lit(0.0))
    judged = known.select(
        "host", "level", "node",
        _different(F.col("n"), F.col("b"), whole_n - F.col("n"), whole_b - F.col("b")).alias("differs"),
        ((F.col("b") + WEIGHT * above) / (F.col("n") + WEIGHT)).alias("purity"),
        F.coalesce(F.try_divide("all_b", "all_n"), F.lit(0.0)).alias("overall"))
    best = F.max(F.when(F.coalesce("differs", F.lit(False)), F.struct("level", "node", "purity")))
    return each.join(judged, ["host", "level", "node"]).groupBy("host", "masked").agg(
        best.alias("best"), F.max("overall").alias("overall")).select(
        "host", "masked", F.col("best.node").alias("template"),
        F.coalesce("best.purity", "overall").alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of ``pages`` (page_id, url).

    ``labels``: page_id and ``bad`` boolean.
    """
    host, path = host_and_path(F.col("url"))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "page_id", "left")
    rows = written(rows.select("page_id", "host", "path", "bad"), "url-pages")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = rows.withColumns({"masked": masked(F.col("path")), "rule": name, "ruled": verdict})
    by_tree = tree(rows)
    out = told.join(by_tree, ["host", "masked"], "left")
    method = F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
                      "template", "purity")
