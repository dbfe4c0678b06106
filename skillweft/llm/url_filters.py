"""URL filters by a tree of path templates per host.

A url's path is a list of segments.  Segments that look variable (numbers, long codes)
become wildcards, and so does a segment where its parent has so many different children
that none of them is typical.  What remains is a tree of templates per host, whose
leaves count labelled urls (allowed and blocked).  The tree is generalised from the top
down: what a level has joined under a wildcard is one parent for the next.

Of sibling branches that differ in one segment, those with labels are put into
``SHARES`` groups by their blocked share; the groups are taken in order and merged with the
ones before as long as a two-proportion test, corrected for the number of groups,
finds them alike; a branch without labels is left to its prior.  A
template is rejected when its smoothed share of blocked labels,

    (blocked + strength * prior) / (labelled + strength),

exceeds one half; the prior of a template is the smoothed share of the same template
over all hosts, whose own prior is the share over all labelled urls.

Labels come from rules (host, path, block): a rule fits its host and all subdomains and
every path that starts with its path; the rule with the longest host and path wins, of
equally long ones the one with the longer host.  Urls with a rule are judged by it, all
others by their template.

Every step is a grouping of (host, template), (host, parent, segment) or (host, branch,
share group) rows with partial sums, so a host with a third of all urls is one row per
task in the shuffles, and siblings meet as ``SHARES`` sums at most, however many there are.
All segments of a path enter the tree; where ``depth`` is given, paths deeper than that
end in one wildcard for the rest.  Levels at which no host has many segments need no step.

Cases: a null url, or one without ``://``, has an empty host and path and the template
of the empty path; without labels the prior is one half and nothing is rejected;
repeated rows are judged alike and counted each; other columns are kept by none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.components import stored

REST = "**"
ANY = "*"
SHARES = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z in lower case, path)."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, bool]]) -> tuple[Column, Column]:
    """(the winning rule as text, whether it blocks); null where none fits."""
    name = blocks = None
    for rule_host, rule_path, block in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text, flag = F.lit(rule_host + rule_path), F.lit(block)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        blocks = F.when(fits, flag) if blocks is None else blocks.when(fits, flag)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return name, blocks


def segment_shape(segment: Column) -> Column:
    """A wildcard for segments that are numbers or codes, else the segment.

    The file extension stays, since it tells kinds of pages apart.
    """
    name = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    end = F.regexp_extract(segment, r"(?s)^.*?(\.[A-Za-z]{1,5})?$", 1)
    number = name.rlike(r"^[0-9]+$")
    code = name.rlike(r"^[0-9A-Fa-f-]{8,}$") & name.rlike(r"[0-9]")
    long_mixed = (F.char_length(name) >= 16) & name.rlike(r"[0-9]")
    return F.when(number | code | long_mixed, F.concat(F.lit(ANY), end)).otherwise(segment)


def _smoothed(blocked: Column, labelled: Column, prior: Column, strength: float) -> Column:
    return (blocked + strength * prior) / (labelled + strength)


def templates(
    urls: DataFrame, depth: int | None = None, rare_children: int = 20, typical: float = 0.01
) -> DataFrame:
    """``urls`` with a column ``template`` (array of segments).

    A segment becomes a wildcard where its parent has more than ``rare_children``
    different children and it makes up less than ``typical`` of them.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    none = F.array().cast("array<string>")
    shaped = F.transform(parts if depth is None else F.slice(parts, 1, depth), segment_shape)
    tail = none if depth is None else F.when(F.size(parts) > depth, F.array(F.lit(REST))).otherwise(none)
    slash = F.when(F.endswith("path", F.lit("/")), F.array(F.lit(""))).otherwise(none)
    rows = urls.withColumn("shape", F.concat(shaped, tail, slash))
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")).withColumn("template", F.col("shape"))
    shapes = stored(shapes, "url-shapes")
    kinds = shapes.select("host", F.posexplode("shape").alias("level", "segment")).distinct().groupBy("host", "level").count()
    busy = kinds.filter(F.col("count") > rare_children).select("level").distinct().orderBy("level")
    for level in [r[0] for r in busy.collect()]:  # as many as paths have levels
        shapes = stored(_generalised(shapes, level, rare_children, typical), "url-shapes")
    general = shapes.select("host", "shape", "template")  # a join of two plain tables can split hot hosts
    return rows.join(general, ["host", "shape"], "left").withColumn(
        "template", F.coalesce("template", "shape")
    ).drop("shape")


def _generalised(shapes: DataFrame, level: int, rare_children: int, typical: float) -> DataFrame:
    """``shapes`` with wildcards at one level, under the parents as they are generalised so far."""
    at = F.get("template", F.lit(level))
    nodes = shapes.withColumn("parent", F.slice("template", F.lit(1), F.lit(level))).withColumn("segment", at)
    children = nodes.filter("segment is not null").groupBy("host", "parent", "segment").agg(F.sum("n").alias("count"))
    parents = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("total"))
    rare = children.join(parents.filter(F.col("kinds") > rare_children), ["host", "parent"]).filter(
        (F.col("count") < typical * F.col("total")) & ~F.startswith("segment", F.lit(ANY)) & (F.col("segment") != "")
    ).select("host", "parent", "segment", F.lit(True).alias("rare"))
    template = F.transform(
        "template", lambda s, i: F.when((i == level) & F.coalesce("rare", F.lit(False)), ANY).otherwise(s))
    return nodes.join(rare, ["host", "parent", "segment"], "left").select("host", "shape", "n", template.alias("template"))


def judge_templates(
    rows: DataFrame, strength: float = 2.0, alike: float = 1.96, min_labels: int = 5
) -> DataFrame:
    """``host``, ``template``, merged ``branch`` and whether it is ``rejected``.

    ``rows`` has ``host``, ``template`` and ``blocks`` (null where not labelled).
    """
    block = F.coalesce(F.col("blocks").cast("int"), F.lit(0))
    leaves = rows.groupBy("host", "template").agg(
        F.sum(block).cast("double").alias("bad"), F.count("blocks").cast("double").alias("labelled")
    )
    # siblings: leaves of one host that differ in one segment only, seen from each place
    seen = leaves.select("*", F.posexplode(F.concat("template", F.array(F.lit(None).cast("string")))).alias("at", "segment"))
    seen = seen.filter("segment is not null and segment <> ''").withColumn(
        "branch", F.transform("template", lambda s, i: F.when(i == F.col("at"), ANY).otherwise(s))
    )
    share = F.col("bad") / F.col("labelled")
    place = ["host", "branch", "at"]
    siblings = seen.groupBy(*place).agg(F.count(F.lit(1)).alias("siblings"))
    known = seen.filter("labelled > 0").withColumn("low", F.floor(share * (SHARES - 1)))
    sums = known.groupBy(*place, "low").agg(
        F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count(F.lit(1)).alias("members"),
        F.min("segment").alias("first"), F.max("segment").alias("last"),
    ).withColumn("high", F.col("low"))
    parts = ("low", "high", "bad", "labelled", "members", "first", "last")
    sets = sums.groupBy(*place).agg(
        F.array_sort(F.collect_list(F.struct(*parts))).alias("known"), F.sum("members").alias("members")  # SHARES at most
    ).filter("members > 1")
    # by the bound on normal tails, this many tests together err as rarely as one at ``alike``
    sets = sets.withColumn("limit", F.sqrt(F.lit(alike**2) + 2 * F.log(F.greatest(F.size("known") - 1, F.lit(1)))))

    def differs(group: Column, sibling: Column) -> Column:
        both = group["labelled"] + sibling["labelled"]
        pooled = (group["bad"] + sibling["bad"]) / both
        spread = F.sqrt(pooled * (1 - pooled) * (1 / group["labelled"] + 1 / sibling["labelled"]))
        return F.abs(group["bad"] / group["labelled"] - sibling["bad"] / sibling["labelled"]) > F.col("limit") * spread

    def add(groups: Column, sibling: Column) -> Column:
        last = F.element_at(groups, -1)
        joined = F.struct(
            last["low"].alias("low"), sibling["high"].alias("high"), (last["bad"] + sibling["bad"]).alias("bad"),
            (last["labelled"] + sibling["labelled"]).alias("labelled"), (last["members"] + sibling["members"]).alias("members"),
            F.least(last["first"], sibling["first"]).alias("first"), F.greatest(last["last"], sibling["last"]).alias("last"),
        )
        return F.when(differs(last, sibling), F.array_append(groups, sibling)).otherwise(
            F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(joined))
        )

    groups = sets.select(
        *place, F.explode(F.aggregate(F.slice("known", F.lit(2), F.size("known")), F.slice("known", F.lit(1), F.lit(1)), add)).alias("g"),
    ).filter((F.col("g.members") > 1) & (F.col("g.labelled") >= min_labels)).join(siblings, place)
    # a group that is not all of the siblings is named by its first and last
    named = F.when(F.col("g.members") == F.col("siblings"), F.lit(ANY)).otherwise(F.concat(
        F.lit("{"), F.col("g.first"), F.when(F.col("g.members") == 2, ",").otherwise(".."), F.col("g.last"), F.lit("}")))
    groups = groups.withColumn("name", named).select(
        *place, F.explode(F.sequence("g.low", "g.high")).alias("low"),
        F.struct(
            F.col("g.labelled").alias("all_labelled"), F.negative("at").alias("order"), F.col("g.bad").alias("all_bad"),
            F.transform("branch", lambda s, i: F.when(i == F.col("at"), F.col("name")).otherwise(s)).alias("branch"),
        ).alias("one"),
    )
    # joined on the share group as well and as plain tables, so that a hot place is dealt out
    choice = stored(known.select(*place, "low", "template"), "url-siblings").join(
        stored(groups, "url-groups"), [*place, "low"]).groupBy("host", "template").agg(F.max("one").alias("best"))
    branches = leaves.join(choice, ["host", "template"], "left").select(
        "host", "template",
        F.coalesce("best.branch", "template").alias("branch"),
        F.coalesce("best.all_bad", "bad").alias("bad"),
        F.coalesce("best.all_labelled", "labelled").alias("labelled"),
    )
    everywhere = leaves.groupBy("template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled"))
    overall = leaves.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    share = (overall["bad"] / overall["labelled"]) if overall["labelled"] else 0.5
    prior = _smoothed(F.col("t_bad"), F.col("t_labelled"), F.lit(share), strength)
    purity = _smoothed(F.col("bad"), F.col("labelled"), prior, strength)
    return branches.join(everywhere, "template").select(
        "host", "template", "branch", purity.alias("blocked_share"), (purity > 0.5).alias("rejected")
    )


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, bool]], depth: int | None = None
) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``template``, ``blocked_share``, ``verdict``."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, blocks = rule_of(F.col("host"), F.col("path"), rules)
    rows = templates(rows.withColumns({"rule": rule, "blocks": blocks}), depth)
    judged = stored(judge_templates(rows), "url-verdicts")
    blocked = F.coalesce("blocks", "rejected")
    return rows.join(judged, ["host", "template"], "left").select(
        "page_id", "host", "path", "rule", F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"),
        "blocked_share", F.when(blocked, "block").otherwise("allow").alias("verdict"),
    )
