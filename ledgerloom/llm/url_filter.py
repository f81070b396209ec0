"""URL filters: rules first, then a tree of path templates per host, whose like branches are merged, judged by smoothed
labelled purity."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, numbered

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Parts that the paths below one template are dealt into.
SALTS = 32
REST = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, REST, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, REST, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>, or null. A rule fits its host and all subdomains if the
    path starts with the rule's path; of equally long ones the first listed wins."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*fits)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def with_sums(rows: DataFrame, sums: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with the sums of their group, where there are any. The rows of a hot group are dealt out by a part of the
    hash of `by` too, and its sums are copied to each part."""
    there = sums.withColumnsRenamed({k: f"__of{i}" for i, k in enumerate(keys)}).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.pmod(F.hash(by), F.lit(SALTS)) == F.col("__part")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"__of{i}")
    return rows.join(there, same, "left").drop("__part", *[f"__of{i}" for i in range(len(keys))])


def apart(good: str, bad: str, all_good: str, all_bad: str) -> Column:
    """How many standard errors the purity of a branch is above (or below) that of all; 0 without labels."""
    p = (F.col(all_good) + 1) / (F.col(all_good) + F.col(all_bad) + 2)
    k = F.col(good) + F.col(bad)
    return F.when(k > 0, (F.col(good) / k - p) / F.sqrt(p * (1 - p) / k)).otherwise(0.0)


def like_branches(odd: DataFrame, z: float) -> DataFrame:
    """__host, __t, seg, branch: the odd siblings of each template (with side, + or -, of their pool) in branches.

    Siblings of one side stay together, but for those that differ from what is pooled there by more than `z` standard
    errors: these are split again by side, until none differs. A sibling that ends alone keeps its segment as the
    branch; those that end together share a wildcard, `*` with the sides that led to it."""
    keys, named = ["__host", "__t", "side"], None
    while named is None or not odd.isEmpty():
        pooled = odd.groupBy(*keys).agg(F.sum("good").alias("side_good"), F.sum("bad").alias("side_bad"))
        tested = with_sums(odd, pooled, keys, "seg").withColumn("apart", apart("good", "bad", "side_good", "side_bad"))
        tested = materialize(tested.drop("side_good", "side_bad"), "tested")
        stay = tested.where(F.abs("apart") <= z).drop("apart")
        named = stay if named is None else named.unionByName(stay)
        moved = tested.where(F.abs("apart") > z).withColumn("side", F.concat("side", F.when(F.col("apart") > 0, "+").otherwise("-")))
        odd = materialize(moved.drop("apart"), "odd")
    together = with_sums(named, named.groupBy(*keys).agg(F.count("*").alias("members")), keys, "seg")
    # a literal that looks like a wildcard is written as its percent code
    literal = F.regexp_replace("seg", r"^\*", "%2A")
    return together.select("__host", "__t", "seg", F.when(F.col("members") == 1, literal).otherwise(F.concat(F.lit("*"), "side")).alias("branch"))


def build_tree(urls: DataFrame, depth: int | None = None, support: int = 8, z: float = 1.64) -> DataFrame:
    """The templates of labelled urls: __host, __segs, template for every distinct path shape in `urls`.

    urls: __host, __segs, n, good, bad, one row per distinct shape. Level by level, below each template of a host, a
    segment is variable and becomes the wildcard `*` unless it has `support` rows and its labelled purity differs from
    that of all siblings together by more than `z` standard errors, however many siblings there are (so one without a
    label, like no other branch as much as unlike, is variable too). Those that differ are merged with one another
    where they are alike (see like_branches); one that is like no other stays literal. Counts only are joined.

    All levels are walked, unless `depth` asks for the first ones only (the rest is then `*`). Below a template with
    fewer rows than `support`, or with labels of one kind only (no segment is then more than one standard error from
    its siblings, and z is at least 1), no segment can stay literal, so its paths end in wildcards at once and aren't
    carried on.
    """
    if z < 1:
        raise ValueError("z must be at least 1")
    tree, done, level, node = urls.withColumn("__t", F.lit("")), None, 0, ["__host", "__t"]
    while True:
        rest = F.size("__segs") - level
        total = tree.where(rest > 0).groupBy(*node).agg(*[F.sum(c).alias("all_" + c) for c in ("n", "good", "bad")])
        total = total.where((F.col("all_n") >= support) & (F.least("all_good", "all_bad") > 0))
        ends = tree.where(rest <= 0).withColumns({c: F.lit(None).cast("long") for c in ("all_n", "all_good", "all_bad")})
        tree = materialize(with_sums(tree.where(rest > 0), total, node, "__segs").unionByName(ends), "tree")
        wild = F.concat("__t", F.repeat(F.lit("/*"), F.greatest(rest, F.lit(0))))
        last = depth is not None and level >= depth
        ended = tree.where(F.lit(True) if last else F.col("all_n").isNull()).select("__host", "__segs", "n", "good", "bad", wild.alias("template"))
        done = ended if done is None else done.unionByName(ended)
        tree = tree.where("all_n is not null")
        if last or tree.isEmpty():
            return done
        seg = F.get("__segs", F.lit(level))
        here = tree.groupBy(*node, seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")], *[F.first(c).alias(c) for c in ("all_good", "all_bad")])
        here = here.where(F.col("n") >= support).withColumn("apart", apart("good", "bad", "all_good", "all_bad")).where(F.abs("apart") > z)
        side = F.when(F.col("apart") > 0, "+").otherwise("-")
        odd = materialize(here.select(*node, "seg", "good", "bad", side.alias("side")), "odd")
        level += 1
        tree = tree.drop("all_n", "all_good", "all_bad")
        if odd.isEmpty():  # all are alike: nothing to join
            tree = tree.withColumn("__t", F.concat("__t", F.lit("/*")))
            continue
        found = materialize(like_branches(odd, z), "branches").withColumnsRenamed({"__host": "h", "__t": "t", "seg": "s"})
        tree = tree.join(found, (F.col("__host") == F.col("h")) & (F.col("__t") == F.col("t")) & (seg == F.col("s")), "left")
        tree = tree.withColumn("__t", F.concat("__t", F.lit("/"), F.coalesce(F.col("branch"), F.lit("*"))))
        tree = materialize(tree.drop("h", "t", "s", "branch"), "tree")


def judge_urls(pages: DataFrame, labels: DataFrame, threshold: float = 0.3, weight: float = 4.0, depth: int | None = None, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """pages with host, path, rule, template, purity and verdict (allow or block).

    labels: (key, good) with good 1 or 0; rows with a null in either are left out, rows that repeat a key all count.
    A template's purity is its share of good labels, smoothed by `weight` pseudo-labels at the share of all labels;
    below `threshold` it is blocked. A rule, where one fits, decides instead. Null urls and ones without `://` have an
    empty host and path and no template of their own kind (the empty one); null keys are judged, but carry no label.
    Columns of pages with the names of the new columns are replaced. Empty tables: empty result, or without labels
    a purity of 0.5 for every template.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict")
    kept = pages.drop(*[c for c in new if c not in (key, url)])
    rows, own = numbered(kept)
    rows = rows.withColumns({"host": host_of(F.col(own[url])), "path": path_of(F.col(own[url]))})
    rows = rows.withColumn("__segs", segments(F.col("path")))
    known = labels.select(F.col(labels.columns[0]).alias("__key"), F.col(labels.columns[1]).cast("int").alias("__good")).where("__key is not null and __good is not null")
    # written first, so that the join has plain shuffles on both sides and Spark can split a hot (or null) key
    known = materialize(known.groupBy("__key").agg(F.sum("__good").alias("good"), F.sum(1 - F.col("__good")).alias("bad")), "known")
    narrow = rows.select(F.col("host").alias("__host"), "__segs", F.col(own[key]).alias("__key"))
    shapes = narrow.join(known, "__key", "left").groupBy("__host", "__segs").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = build_tree(materialize(shapes, "shapes"), depth)
    prior = tree.agg(F.try_divide(F.sum("good"), F.sum("good") + F.sum("bad"))).first()[0]
    prior = F.lit(0.5 if prior is None else float(prior))
    nodes = tree.groupBy("__host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    nodes = nodes.select("__host", "template", ((F.col("g") + weight * prior) / (F.col("g") + F.col("b") + weight)).alias("purity"))
    judged = materialize(with_sums(tree.select("__host", "__segs", "template"), nodes, ["__host", "template"], "__segs"), "judged").withColumnsRenamed({"__host": "__h", "__segs": "__s"})
    out = rows.join(judged, (F.col("host") == F.col("__h")) & (F.col("__segs") == F.col("__s")), "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    carried = [F.col(c).alias(name) for name, c in own.items() if name not in new]
    out = out.withColumn("__rule", rule)
    return out.select(*carried, "host", "path", F.col("__rule.rule").alias("rule"), "template", "purity", F.coalesce(F.col("__rule.verdict"), method).alias("verdict"))
