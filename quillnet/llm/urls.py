"""URL filters: a path-template tree for each host, in DataFrame operations only.

1. Segments that are numbers, or hexadecimal ids, become ``*``. Pages are then counted by (host, segments), before anything
   else is grouped, so a host with a third of all pages is a few counts.
2. The tree is built from the root down, one pass over the counts for each level, as deep as the deepest path. Under every
   template, a child that is rare among many becomes ``*`` (the template takes any value there).
3. Rules label pages. Children of one template are then compared by their shares of blocked pages, in the order of these
   shares: where two neighbours do not differ (two-proportion z), they are one branch, written ``{a|b}``, and so are all children
   without labels. What follows them is counted together from there on. A template has at most some twenty children at this point.
4. A template's purity is its own share of blocked pages, smoothed by that of its parent, which is smoothed by its own
   parent's, and so on up to the host, its site (last two labels) and all pages. Templates of purity ``min_purity`` or more are
   rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillnet.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^([0-9]+|[0-9a-f]*[0-9][0-9a-f]{7,})([.][a-z]{1,5})?$"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains, if the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(url.contains("://"), F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(url.contains("://"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """The path's segments without their variable parts."""
    return F.transform(F.split(F.substring(path, 2, 1 << 30), "/"), lambda x: F.regexp_replace(x, VARIABLE, "*"))


def _in_common(least: Column, most: Column) -> Column:
    """How many segments two paths have in common at their beginnings; of the least and the largest of some paths, all of them have these."""
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(least), F.size(most))), lambda i: F.try_element_at(least, i) == F.try_element_at(most, i))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")


def _branches(level: DataFrame, max_children: int, z: float) -> DataFrame:
    """(host, template, child) -> (name, l, b): the branch to which a child belongs, its labelled and blocked pages."""
    parent = ["host", "template"]
    children = cut(level.groupBy(*parent, "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]))
    wide = children.groupBy(*parent).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))
    rare = (F.col("k") > max_children) & (F.col("n") * max_children < F.col("all"))
    named = children.join(wide, parent).select(
        *parent, "child", "labelled", "blocked", F.when(rare, "*").otherwise(F.col("child")).alias("kind")
    )
    named = cut(named)
    kinds = named.groupBy(*parent, "kind").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    # At most 2 * max_children + 1 kinds for each template from here on.
    share = F.try_divide("b", "l")
    order = W.partitionBy(*parent).orderBy(share, "kind")
    l0, b0 = F.lag("l").over(order), F.lag("b").over(order)
    both = (b0 + F.col("b")) / (l0 + F.col("l"))
    apart = F.abs(share - b0 / l0) > z * F.sqrt(both * (1 - both) * (F.lit(1.0) / l0 + F.lit(1.0) / F.col("l")))
    starts = F.when((F.col("l") > 0) & ((F.coalesce(l0, F.lit(0)) == 0) | apart), 1).otherwise(0)
    kinds = kinds.select(*parent, "kind", "l", "b", starts.alias("starts"), share.alias("share"))
    kinds = kinds.withColumn("branch", F.sum("starts").over(order))
    branch = kinds.groupBy(*parent, "branch").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"), F.sum("l").alias("l"), F.sum("b").alias("b")
    )
    name = F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise(F.concat(F.lit("{"), F.array_join("kinds", "|"), F.lit("}")))
    branch = branch.select(*parent, F.explode("kinds").alias("kind"), name.alias("name"), "l", "b")
    return named.join(branch, [*parent, "kind"]).select(*parent, "child", "name", "l", "b")


def filter_urls(
    pages: DataFrame,
    rules: list[Rule] | None = None,
    url_col: str = "url",
    min_purity: float = 0.8,
    max_children: int = 10,
    weight: float = 10.0,
    z: float = 1.96,
) -> DataFrame:
    """Adds host, path, rule, template, purity and verdict (allow or block) to every row.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the
    end; both empty for a null url or one without ``://``. A rule's verdict stands; else the template's. Without labelled
    pages every purity is 0. All segments count, however deep a path is. Segments that all pages below a template have in common are
    levels of the tree like others, but one pass adds them all: passes go by how often paths part, not by their depth. Repeated rows are judged each; an empty table gives no rows; columns that bear a new name are
    replaced, others may have any name.
    """
    rules = RULES if rules is None else rules
    new = ("host", "path", "rule", "template", "purity", "verdict")
    keep = [c for c in pages.columns if c.lower() not in new]
    own = F.struct(*keep) if keep else F.lit(None)
    url = F.col("url")
    parsed = pages.select(own.alias("page"), F.col(url_col).alias("url")).select(
        "page", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path")
    )
    parsed = parsed.select(
        "*", _matched(rules, F.col("host"), F.col("path")).alias("found"), _segments(F.col("path")).alias("segments")
    )
    key = ["host", "segments"]
    counts = parsed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("found").alias("labelled"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked"),
    )
    chain = F.array().cast("array<struct<l:bigint,b:bigint>>")
    # rest: the segments that are not yet in the template.
    tree = cut(counts.select("*", F.col("segments").alias("rest"), F.lit("").alias("template"), chain.alias("chain")))
    parent, done = ["host", "template"], None
    while True:
        here = tree.where(F.size("rest") == 0)
        done = here if done is None else done.unionByName(here)
        live = tree.where(F.size("rest") > 0)
        if not live.limit(1).count():
            break
        groups = live.groupBy(*parent).agg(F.min("rest").alias("least"), F.max("rest").alias("most"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        groups = groups.select(*parent, _in_common(F.col("least"), F.col("most")).alias("run"), "l", "b")
        live = cut(live.join(groups, parent))
        run = F.col("run")
        together = live.where(run > 0).select(
            *key, "n", "labelled", "blocked",
            F.slice("rest", run + 1, F.size("rest")).alias("rest"),
            F.concat("template", F.lit("/"), F.array_join(F.slice("rest", F.lit(1), run), "/")).alias("template"),
            F.concat("chain", F.array_repeat(F.struct("l", "b"), run)).alias("chain"),
        )
        parting = live.where(run == 0).drop("l", "b", "run").withColumn("child", F.col("rest")[0])
        apart = parting.join(_branches(parting, max_children, z), [*parent, "child"]).select(
            *key, "n", "labelled", "blocked",
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
            F.concat("template", F.lit("/"), "name").alias("template"),
            F.array_append("chain", F.struct("l", "b")).alias("chain"),
        )
        tree = cut(together.unionByName(apart))
    tree = cut(done.drop("rest"))
    tree = tree.withColumn("site", F.substring_index("host", ".", -2))

    def votes(by: list[str], a: str, b: str) -> DataFrame:
        return tree.groupBy(*by).agg(F.sum("labelled").alias(a), F.sum("blocked").alias(b))

    def smoothed(a: Column, b: Column, prior: Column) -> Column:
        return (b + prior * weight) / (a + weight)

    total = tree.agg(F.sum("labelled").alias("la"), F.sum("blocked").alias("ba"))
    base = F.coalesce(F.try_divide("ba", "la"), F.lit(0.0))
    hosts = (
        votes(["site", "host"], "lh", "bh")
        .join(votes(["site"], "ls", "bs"), "site")
        .join(F.broadcast(total))
        .select("host", smoothed(F.col("lh"), F.col("bh"), smoothed(F.col("ls"), F.col("bs"), base)).alias("prior"))
    )
    leaves = tree.groupBy("host", "template").agg(
        F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first(F.slice("chain", 1, F.size("chain") - 1)).alias("above")
    )
    above = F.aggregate("above", F.col("prior"), lambda p, s: smoothed(s["l"], s["b"], p))
    leaves = leaves.join(hosts, "host").select("host", "template", smoothed(F.col("l"), F.col("b"), above).alias("purity"))
    templates = tree.select(*key, "template").join(leaves, ["host", "template"])
    judged = parsed.join(cut(templates), key)
    return judged.select(
        *[F.col("page")[c].alias(c) for c in keep],
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.concat("host", "template").alias("template"),
        "purity",
        F.coalesce(F.col("found.verdict"), F.when(F.col("purity") >= min_purity, "block").otherwise("allow")).alias("verdict"),
    )
