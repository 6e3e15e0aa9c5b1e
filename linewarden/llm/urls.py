"""URL verdicts by host rules and by a tree of path templates.

Rules come first: the longest one that fits host and path decides. For the other pages a
tree of templates is grown for each host, one path segment a level. Below a node, the
segments with too few labelled pages for a test become one wildcard, and all others are
fixed names, however many. Fixed siblings whose labelled pages are not distinguishable
(two-proportion test) are merged into one branch. A
branch is judged by the share of bad pages among its labelled ones, smoothed towards that
of its parent's other pages, so a label counts once on any level; a template is rejected if that purity of bad pages reaches the limit.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no
rule and belongs to the tree of the empty host; null labels are no labels; a url with
several labels counts as often; repeated pages are pages of their own; an empty table
gives no rows. Every segment of a path is generalised. A branch with too few labels for
any fixed name below it ends there: the rest of its paths is one wildcard tail, whose
mark is the branch itself. Extra columns of pages are kept, those named like an added one
replaced.

The tree grows on distinct paths whose variable segments are already wildcards. Their
counts are partial aggregates, so a host or template with a third of all pages is no hot
group; a level is an aggregate over (host, branch, segment). Siblings are compared by their
distinct counts of labelled and bad pages, of which n labels make at most about n^(2/3).
There are as many levels as the deepest path of a branch with enough labels has segments.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm.common import stored, without

# Fixed rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Names of fewer labelled pages than this are one wildcard, as are numbers and long hex names.
LABELS_LEAST = 10
#: Two siblings are merged if their shares differ by less than this many deviations.
ALIKE = 1.96
#: Pages that the share of the parent's other pages counts for.
SMOOTHING = 10.0
REJECT = 0.5
ADDED = ("host", "path", "rule", "verdict", "template", "purity")
ANY, END = "*", "$"


def located(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    known = F.col("url").contains("://")
    rest = F.expr("substring(url, position('://' in url) + 3)")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns(
        {
            "host": F.when(known, low).otherwise(F.lit("")),
            "path": F.when(known, path).otherwise(F.lit("")),
        }
    )


def ruled() -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        h, p = F.col("host"), F.col("path")
        fits = ((h == host) | h.endswith(f".{host}")) & p.startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def general_path(path: Column) -> Column:
    """All segments, with variable ones as wildcards, and an end mark."""
    parts = F.array_remove(F.split(path, "/"), "")
    number = r"^[0-9]+([._-].*)?$"
    name = r"^[0-9a-fA-F-]{16,}$"
    parts = F.transform(
        parts, lambda s: F.when(s.rlike(number) | s.rlike(name), F.lit(ANY)).otherwise(s)
    )
    return F.array_join(F.concat(parts, F.array(F.lit(END))), "/")


def merged(children: DataFrame) -> DataFrame:
    """Gives siblings of a node a common branch where their labels are alike or too few.

    Siblings are sorted by their share of bad pages, and a branch ends where two
    neighbours differ. Those of equal counts are one row of the comparison.
    """
    node = Window.partitionBy("host", "branch")
    order = node.orderBy("share", "labelled")
    total = F.col("bad") + F.lag("bad").over(order)
    both = F.col("labelled") + F.lag("labelled").over(order)
    pooled = total / both
    spread = F.sqrt(
        pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.lag("labelled").over(order))
    )
    apart = F.abs(F.col("share") - F.lag("share").over(order)) > F.lit(ALIKE) * spread
    few = F.col("labelled") < LABELS_LEAST
    keys = ["host", "branch", "labelled", "bad"]
    known = children.where(~few)
    alike = known.groupBy(*keys).agg(F.min("segment").alias("least"), F.count("*").alias("names"))
    alike = alike.withColumn("share", F.col("bad") / F.col("labelled"))
    alike = alike.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = alike.withColumn("group", F.sum("new").over(run))
    group = Window.partitionBy("host", "branch", "group")
    more = F.sum("names").over(group) > 1
    label = F.concat(F.when(more, F.lit("~")).otherwise(F.lit("=")), F.min("least").over(group))
    known = known.join(alike.select(*keys, label.alias("label")), keys)
    unknown = children.where(few).withColumn("label", F.lit(ANY))
    return known.select(*children.columns, "label").unionByName(unknown)


def smoothed(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + F.lit(SMOOTHING) * above) / (labelled + F.lit(SMOOTHING))


def grow(paths: DataFrame, prior: float) -> DataFrame:
    """host, general, template and purity of every distinct path.

    ``paths`` has host, general, labelled and bad; ``prior`` is the purity above the roots.
    """
    rows = paths.withColumns(
        {
            "segs": F.split("general", "/"),
            "branch": F.lit(""),
            "purity": F.lit(prior).cast("double"),
            "above": F.lit(prior).cast("double"),
        }
    )
    columns = rows.columns
    done = rows.limit(0)
    for depth in count():
        at = rows.withColumn("segment", F.get("segs", F.lit(depth)))
        if depth:
            ends = F.col("segment").isNull() | (F.col("l") < LABELS_LEAST)
            done = done.unionByName(at.where(ends).select(*columns))
            at = at.where(~ends).drop("l")
        if at.isEmpty():
            break
        keys = ["host", "branch", "segment"]
        counts = at.groupBy(*keys).agg(
            F.sum("labelled").alias("labelled"),
            F.sum("bad").alias("bad"),
            F.max("above").alias("above"),
        )
        counts = stored(counts, f"branches-{depth}")
        labels = merged(counts)
        branch = ["host", "branch", "label"]
        judged = labels.groupBy(*branch).agg(
            F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.max("above").alias("above")
        )
        # What a branch is smoothed towards holds none of its own labels.
        node = Window.partitionBy("host", "branch")
        others, bad = F.sum("l").over(node) - F.col("l"), F.sum("b").over(node) - F.col("b")
        judged = judged.withColumn("next_above", smoothed(bad, others, F.col("above")))
        judged = judged.withColumn("next", smoothed(F.col("b"), F.col("l"), F.col("next_above")))
        table = labels.select(*keys, "label").join(
            judged.select(*branch, "next", "next_above", "l"), branch
        )
        rows = stored(
            at.join(table, keys)
            .withColumn("branch", F.concat_ws("/", "branch", "label"))
            .withColumn("purity", F.col("next"))
            .withColumn("above", F.col("next_above"))
            .select(*columns, "l"),
            f"level-{depth}",
        )
    return done.select("host", "general", F.col("branch").alias("template"), "purity")


def judge(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """All pages with host, path, rule, template, purity and verdict.

    ``marks`` has url and bad (0 or 1): the labelled urls.
    """
    rows = located(without(pages, *ADDED)).withColumn("__general", general_path(F.col("path")))
    zero = F.lit(0).cast("long")
    seen = rows.select("host", F.col("__general").alias("general"), zero.alias("l"), zero.alias("b"))
    known = located(marks.where("bad IS NOT NULL")).select(
        "host",
        general_path(F.col("path")).alias("general"),
        F.lit(1).cast("long").alias("l"),
        F.col("bad").cast("long").alias("b"),
    )
    paths = seen.union(known).groupBy("host", "general")
    paths = stored(paths.agg(F.sum("l").alias("labelled"), F.sum("b").alias("bad")), "paths")
    total = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    tree = grow(paths, (total[0] or 0) / total[1] if total[1] else 0.0)
    rule, by_rule = ruled()
    tree = tree.select(
        F.col("host").alias("__host"), F.col("general").alias("__path"), "template", "purity"
    )
    out = rows.join(
        tree, (F.col("host") == F.col("__host")) & (F.col("__general") == F.col("__path")), "left"
    )
    rejected = F.coalesce(F.col("purity") >= F.lit(REJECT), F.lit(False))
    by_tree = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(by_rule, by_tree)}).drop(
        "__general", "__host", "__path"
    )
