"""URL filter: host rules first, then a path-template tree that judges what no rule fits.

Every distinct (host, path) is a leaf of its host's tree. Depth by depth, variable segments (numbers, hexadecimal ids,
dates) become wildcards that keep their file extension, and where a node still has many literal children, those whose
labelled block share does not differ from the share of all its literal children (a two-proportion z test) merge into one
wildcard branch. Labels are the verdicts of the rules; a url that no rule fits takes the purity of the deepest template
on its path that has labels: (blocked + 1) / (labelled + 2), and is blocked at 0.8 or more. A host's root is no template.
Trees are per host: where no template of the own host on a url's path has labels, its purity is 0.5 and it is allowed. Labels
can be given as a table (host, path, blocked); else they are the rules' verdicts.

Defined results: null urls and urls without "://" have empty host and path and are allowed; repeated rows are judged
each; paths deeper than `depth` keep their rest as one last segment; an empty table gives an empty result; other columns
are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import common

# Fixed values: (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DEPTH = 8
FANOUT = 16
PURITY = 0.8
_VARIABLE = r"^(?:[0-9]+|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F]*[0-9][0-9a-fA-F]{7,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})((?:\.[A-Za-z0-9]{1,5})?)$"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones, being longer, win
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def templates(leaves: DataFrame, *, depth: int = DEPTH, fanout: int = FANOUT) -> DataFrame:
    """Add `template` (array of segments) to rows of distinct host and path with labelled and blocked counts."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", depth)
    rows = leaves.withColumn("_segs", F.when(F.col("path").isin("", "/"), F.array().cast("array<string>")).otherwise(segments)).withColumn("_n", F.size("_segs"))
    rows = rows.withColumn("template", F.transform("_segs", lambda s: F.regexp_replace(s, _VARIABLE, "*$1")))
    rows = common.materialise(rows.drop("_segs"), "leaves")
    deepest = rows.agg(F.max("_n")).head()[0] or 0
    for d in range(1, deepest + 1):
        here = rows.where(F.col("_n") >= d).select("host", F.slice("template", 1, d - 1).alias("_up"), F.element_at("template", d).alias("_seg"), "labelled", "blocked")
        children = here.where(~F.startswith("_seg", F.lit("*"))).groupBy("host", "_up", "_seg").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        nodes = children.groupBy("host", "_up").agg(F.count(F.lit(1)).alias("kids"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b")).where(F.col("kids") > fanout)
        if nodes.limit(1).count() == 0:
            continue
        rest = F.greatest(F.col("all_l") - F.col("l"), F.lit(1))
        share = (F.col("all_b") + 1) / (F.col("all_l") + 2)
        z = (F.col("b") / F.greatest("l", F.lit(1)) - (F.col("all_b") - F.col("b")) / rest) / F.sqrt(share * (1 - share) * (1 / F.greatest("l", F.lit(1)) + 1 / rest))
        alike = ((F.col("l") > 0) & (F.col("all_l") > F.col("l")) & (F.abs(z) < 1.96)) | (F.col("all_l") == 0)
        merged = children.join(nodes, ["host", "_up"]).where(alike).select("host", "_up", "_seg", F.lit(True).alias("_merge"))
        keyed = rows.withColumn("_up", F.slice("template", 1, d - 1)).withColumn("_seg", F.when(F.col("_n") >= d, F.get("template", F.lit(d - 1))))
        new = F.transform("template", lambda s, i: F.when((i == d - 1) & F.col("_merge").isNotNull(), F.lit("*")).otherwise(s))
        rows = common.materialise(keyed.join(merged, ["host", "_up", "_seg"], "left").withColumn("template", new).select(*rows.columns), "leaves")
    return rows.drop("_n")


def judge(pages: DataFrame, labels: DataFrame | None = None, *, rules=RULES, depth: int = DEPTH, fanout: int = FANOUT, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url."""
    host, path = parsed(F.col("url").cast("string"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "_known": verdict})
    leaves = seen.groupBy("host", "path").agg(F.count("_known").alias("labelled"), F.count_if(F.col("_known") == "block").alias("blocked"))
    if labels is not None:
        known = labels.groupBy("host", "path").agg(F.count("blocked").alias("labelled"), F.count_if("blocked").alias("blocked"))
        leaves = leaves.select("host", "path").join(known, ["host", "path"], "left").fillna(0, ["labelled", "blocked"])
    leaves = common.materialise(templates(leaves, depth=depth, fanout=fanout), "templates")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("template")), lambda i: F.slice("template", F.lit(1), i))
    ends = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    up = ends.where(F.size("template") > 0).select("host", "template", "labelled", "blocked", F.explode(prefixes).alias("node"))
    nodes = up.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    score = ((F.col("b") + 1) / (F.col("l") + 2)).alias("p")
    best = up.select("host", "template", "node").join(nodes.where("l > 0"), ["host", "node"]).groupBy("host", "template").agg(F.max_by(score, F.size("node")).alias("purity"))
    judged = leaves.join(best, ["host", "template"], "left")
    judged = judged.select("host", "path", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.coalesce("purity", F.lit(0.5)).alias("purity"))
    own = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return seen.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("_known", own).alias("verdict"), "template", "purity")


def op3_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
