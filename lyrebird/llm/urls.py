"""URL filters: host and path rules, and for all other pages a tree of path templates with labelled purity.

The tree grows level by level over all hosts at once, to the paths' ends or LEVELS deep, where the rest of a path counts as
one segment. At a node, segments that look like numbers,
hashes or dates, or that have too few pages to tell anything, become the wildcard; labelled branches whose rates of bad
pages don't differ significantly are merged, and so are those with too few labels. A template is rejected by its
smoothed rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.llm.shared import materialise

#: A branch of its own has so many pages, whatever its node's size; below a node with fewer there is only the wildcard.
LEAST_PAGES = 5
#: Branches of a node are first pooled by rates in steps of 1 / RATES.
RATES = 32
#: Levels of the tree, and so rounds, whatever the depth of a path: what is left of it at the last one is one segment.
LEVELS = 16
#: Smoothing: labelled pages that the host's and the corpus's rates count as. Significance of a difference of rates.
WEIGHT, Z = 5.0, 1.96
#: A template is rejected from this smoothed rate of bad pages. A branch with fewer labels is pooled with its like.
REJECT, LEAST_LABELS = 0.5, 5
VARIABLE = r"^([0-9]+|[0-9a-fA-F-]{8,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)(\.[A-Za-z0-9]{1,5})?$"

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to /, ?, # or end, A-Z lower-cased. Path: then up to ?, # or end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def junk_text(html: Column) -> Column:
    """1 if what html shows has more than one symbol (# * $ % | & < >) in ten words, else 0; null if it shows no word."""
    shown = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    n_symbols, n_words = F.regexp_count(shown, F.lit(r"[#*$%|]|&(amp|lt|gt);")), F.regexp_count(shown, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(n_words > 0, (10 * n_symbols > n_words).cast("int"))


def _grow(rows: DataFrame, level: int) -> DataFrame:
    """Paths one level further down: template gets the branch that the next segment belongs to; more: it has branches.

    A row is a host's path, with its number of pages. All have a segment at this level. Below a branch with under LEAST_PAGES pages all segments are wildcards.
    """
    parts = F.array_remove(F.split("path", "/"), "")
    at_end = level == LEVELS - 1
    seg = F.array_join(F.slice(parts, level + 1, F.greatest(F.size(parts), F.lit(1))), ">") if at_end else F.get(parts, F.lit(level))
    at = rows.withColumn("seg", F.when(seg.rlike(VARIABLE), F.lit("*")).otherwise(seg))
    # The rows' own columns are named apart, so that no join meets a clash.
    counts = at.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "n_bad")))
    own = F.when(F.col("n") >= LEAST_PAGES, F.col("seg")).otherwise(F.lit("*"))
    sums = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("n_bad").alias("n_bad"))
    literal = counts.withColumn("branch", own).groupBy("host", "template", "branch").agg(*sums)
    known = F.col("labelled") >= LEAST_LABELS
    step_of = F.when(known, F.floor(RATES * F.col("n_bad") / F.col("labelled"))).otherwise(F.lit(-1))
    literal = materialise(literal.withColumn("bin", step_of.cast("int")), "url-branches")
    # At most RATES + 2 bins a node, in the order of their rates; a significant step begins a new group.
    ends = (F.min("branch").alias("first"), F.max("branch").alias("last"), F.count("*").alias("k"))
    bins = literal.groupBy("host", "template", "bin").agg(*sums, *ends)
    rate = (F.col("n_bad") + 0.5) / (F.col("labelled") + 1.0)
    side = Window.partitionBy("host", "template", F.col("bin") >= 0).orderBy("bin")
    before = lambda c: F.lag(c).over(side)
    pooled = (F.col("n_bad") + before("n_bad") + 0.5) / (F.col("labelled") + before("labelled") + 1.0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 1.0) + 1 / (before("labelled") + 1.0)))
    step = F.when(before("rate").isNotNull() & (F.col("rate") - before("rate") > Z * error), 1).otherwise(0)
    grouped = bins.withColumn("rate", rate).withColumn("step", step).withColumn("grp", F.sum("step").over(side))
    group = Window.partitionBy("host", "template", F.col("bin") >= 0, "grp")
    first, last, k = F.min("first").over(group), F.max("last").over(group), F.sum("k").over(group)
    middle = F.when(k > 2, F.concat(F.lit("|+"), k - 2, F.lit("|"))).otherwise(F.lit("|"))
    name = F.when(k == 1, first).otherwise(F.concat(F.lit("{"), first, middle, last, F.lit("}")))
    names = grouped.select("host", "template", "bin", name.alias("name"), F.sum("n").over(group).alias("pages"))
    table = materialise(literal.join(names, ["host", "template", "bin"]).select("host", "template", "branch", "name", "pages"), "url-names")
    literals = table.where(F.col("branch") != "*").select("host", "template", F.col("branch").alias("seg"), "name", "pages")
    wild = table.where(F.col("branch") == "*").select("host", "template", F.col("name").alias("wild"), F.col("pages").alias("wild_pages"))
    out = at.join(literals, ["host", "template", "seg"], "left").join(wild, ["host", "template"], "left")
    below = F.lit(0) if at_end else F.size(parts) - (level + 1)
    more = (below > 0) & (F.coalesce("pages", "wild_pages") >= LEAST_PAGES)
    rest = F.when(more, F.lit("")).otherwise(F.concat(F.repeat(F.lit("/*"), F.least(below, F.lit(LEVELS))), F.when(below > LEVELS, "/**").otherwise("")))
    down = out.withColumns({"template": F.concat("template", F.lit("/"), F.coalesce("name", "wild"), rest), "more": more})
    return materialise(down.drop("seg", "name", "pages", "wild", "wild_pages"), "url-rows")


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, bad: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template, n_labelled and block_rate of each row.

    A rule's verdict stands, and labels its page. bad (1 or 0, null: no label) labels pages without a rule. Those get their
    template's verdict: block if its rate of bad ones is REJECT or more. Each rate is smoothed towards that of the branch
    above, the host's towards the corpus's and this towards none, so a template without labels has its parent's rate, and
    one with few is near it. n_labelled counts the template's own. A null url, or one without "://", has an empty host and path and is judged with its like; urls may be
    of any length. Repeated rows count each and get equal verdicts, whatever the other columns hold; a null page_id is passed
    through. No pages give no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), *([bad.cast("int").alias("bad")] if bad is not None else []))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    label = (F.col("by_rule") == "block").cast("int")
    rows = rows.withColumn("bad", label if bad is None else F.coalesce(label, "bad"))
    rows = materialise(rows, "url-pages")
    sums = (F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    # The tree grows on distinct paths with their counts; pages get their path's verdict at the end.
    depth = F.size(F.array_remove(F.split("path", "/"), ""))
    now = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *sums).withColumns({"template": F.lit(""), "more": depth > 0})
    now = materialise(now, "url-paths")
    paths, level = now.where("NOT more"), 0
    while not (going := now.where("more")).isEmpty():
        now = _grow(going, level)
        paths, level = paths.unionByName(now.where("NOT more")), level + 1
    paths = materialise(paths.drop("more"), "url-templates-of-paths")
    sums = tuple(F.sum(c).alias(c) for c in ("labelled", "n_bad"))
    total = paths.agg(*sums).first()
    prior = (total["n_bad"] or 0) / ((total["labelled"] or 0) + 2 * WEIGHT)
    templates = materialise(paths.groupBy("host", "template").agg(*sums), "url-templates")
    parts = F.split("template", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    nodes = templates.select("host", "labelled", "n_bad", F.explode(F.array_union(above, F.array("template"))).alias("node"))
    nodes = materialise(nodes.groupBy("host", "node").agg(F.sum("labelled").alias("node_labelled"), F.sum("n_bad").alias("node_bad")), "url-nodes")
    chain = F.sort_array(F.collect_list(F.struct("depth", "node_labelled", "node_bad")))
    chains = templates.select("host", "template", "labelled", "n_bad", F.posexplode(above).alias("depth", "node")).join(nodes, ["host", "node"])
    chains = chains.groupBy("host", "template", "labelled", "n_bad").agg(chain.alias("chain"))
    smooth = lambda n_bad, labelled, towards: (n_bad + WEIGHT * towards) / (labelled + WEIGHT)
    parent_rate = F.aggregate("chain", F.lit(float(prior)), lambda rate, x: smooth(x["node_bad"], x["node_labelled"], rate))
    judged = chains.select("host", "template", F.col("labelled").alias("n_labelled"), smooth(F.col("n_bad"), F.col("labelled"), parent_rate).alias("block_rate"))
    of_path = materialise(paths.select("host", "path", "template").join(judged, ["host", "template"]), "url-judged")
    out = rows.join(of_path, ["host", "path"])
    by_template = F.when(F.col("block_rate") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "n_labelled", "block_rate")
