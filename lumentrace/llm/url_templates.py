"""URL filtering by fixed rules and by path templates, in DataFrame functions alone.

Paths form a tree per host. From the root down, a segment that is a number, a hexadecimal string or
a mixture of letters and digits becomes ``*``, a number with an extension ``*.`` and the extension, and so does every segment at a place that
has more than ``max_children`` different ones. Labels are the verdicts of the rules, wherever one fits.

Templates of a host that differ in their first literal segment alone have one shape. They are merged where
their shares of blocked labels don't differ from the shape's by more than chance lets expect; a template with fewer than
``min_labelled`` labels can't differ and joins by its shape. So labels reach templates that have none.

A template's purity, its share of blocked labels, is smoothed down the tree: from all urls to those of the domain (the host's
last two names), to the domain's shape, to the domain's template, to the host's merged template, each with the one before as
its prior. A template is rejected if its purity reaches ``threshold`` and ``min_labelled`` labels or more stand behind it at the
nearest of these places below all urls that has so many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (host, path, verdict). A rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_DEPTH, MAX_CHILDREN = 4, 32
MIN_LABELLED, PRIOR_WEIGHT, THRESHOLD, MERGE_DEVIATIONS = 5, 10.0, 0.8, 1.96
#: Shapes of segments that vary from page to page.
VARIABLE = "^([0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})$|[A-Za-z][0-9]+[A-Za-z]"
#: Fixed value: a number with an extension.
NUMBERED = r"^[0-9]+\.([A-Za-z]{1,5})$"
#: Fixed value: a host's last two names.
DOMAIN = r"[^.]*(?:\.[^.]*)?$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(at > 0, path).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Rules are a short list given by the caller."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def templates(paths: DataFrame, max_depth: int = MAX_DEPTH, max_children: int = MAX_CHILDREN) -> DataFrame:
    """(host, path, ..., template) for distinct (host, path); segments beyond ``max_depth`` become ``**``."""
    cur = paths.withColumn("_s", F.filter(F.split("path", "/", -1), lambda x: x != "")).withColumn("template", F.lit(""))
    for d in range(1, max_depth + 1):
        own = F.get("_s", F.lit(d - 1))
        seg = F.when(F.size("_s") >= d, F.when(own.rlike(NUMBERED), F.regexp_replace(own, NUMBERED, "*.$1")).when(own.rlike(VARIABLE), F.lit("*")).otherwise(own))
        cur = cur.withColumn("_seg", seg)
        kids = cur.where("_seg is not null").groupBy("host", "template", "_seg").agg(F.count("*").alias("n"))
        wide = kids.groupBy("host", "template").agg(F.count("*").alias("_kids")).where(F.col("_kids") > max_children)
        cur = cur.join(wide, ["host", "template"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("_kids").isNotNull(), F.lit("*")).otherwise(F.col("_seg")))
        cur = cur.withColumn("template", F.when(F.col("_seg").isNull(), F.col("template")).otherwise(step)).drop("_kids", "_seg")
        cur = written(cur, "url-level") if d < max_depth else cur
    return cur.withColumn("template", F.when(F.size("_s") > max_depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_s")


def _smoothed(bad: str, labelled: str, prior: Column) -> Column:
    return (F.coalesce(F.col(bad), F.lit(0)) + PRIOR_WEIGHT * prior) / (F.coalesce(F.col(labelled), F.lit(0)) + PRIOR_WEIGHT)


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_depth: int = MAX_DEPTH, max_children: int = MAX_CHILDREN,
    min_labelled: int = MIN_LABELLED, threshold: float = THRESHOLD, hidden: Column | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, learned, template, labelled, purity.

    learned is the templates' own verdict, labelled the number of labels behind it; verdict is the rule's where one fits. ``hidden``, over host and path,
    marks urls whose rule is no label and gives no verdict, for trials of what is learned. Null urls and urls without ``://`` have an empty host and path, no rule and
    the root's template. Null and repeated ids and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path")).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    if hidden is not None:
        rows = rows.withColumn("_rule", F.when(~hidden, F.col("_rule")))
    blocked = F.count_if(F.col("_rule.verdict") == "block")
    paths = written(rows.groupBy("host", "path").agg(F.count("_rule").alias("l"), blocked.alias("b")), "url-paths")
    tree = written(templates(paths, max_depth, max_children), "url-templates")
    masked = F.regexp_replace("template", "^((?:/\\*)*)/[^*/][^/]*", "$1/{}")
    leaves = tree.groupBy("host", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    leaves = written(leaves.withColumns({"shape": masked, "domain": F.regexp_extract("host", DOMAIN, 0)}), "url-leaves")
    total = leaves.agg(F.sum("b"), F.sum("l")).first()
    everywhere = F.lit((total[0] or 0) / total[1] if total[1] else 0.0)

    def counts(l: str, b: str, *keys: str) -> DataFrame:
        return leaves.groupBy(*keys).agg(F.sum("l").alias(l), F.sum("b").alias(b))

    # merging within a host: by chance where both sides have labels, by shape where one has too few
    pooled = leaves.where(F.col("l") >= min_labelled).groupBy("host", "shape").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    share, pool = F.col("b") / F.col("l"), F.col("pb") / F.col("pl")
    chance = F.sqrt(pool * (1 - pool) * (1 / F.col("l") + 1 / F.col("pl")))
    few = F.col("l") < min_labelled
    alike = F.when(few, F.lit(True)).otherwise(F.coalesce(F.abs(F.when(~few, share) - pool) <= MERGE_DEVIATIONS * chance, F.lit(False)))
    met = leaves.join(pooled, ["host", "shape"], "left").withColumn("alike", alike)
    # sparse templates learn from a shape only as far as its labelled ones agree
    groups = met.where("alike").groupBy("host", "shape").agg(F.sum("l").alias("gl"), F.sum("b").alias("gb"), F.count("*").alias("gn"))
    met = met.join(groups, ["host", "shape"], "left").withColumn("merged", F.col("alike") & (F.col("gn") > 1))
    met = met.join(counts("dl", "db", "domain"), "domain", "left").join(counts("sl", "sb", "domain", "shape"), ["domain", "shape"], "left").join(counts("tl", "tb", "domain", "template"), ["domain", "template"], "left")
    met = met.withColumns({"ml": F.when(F.col("merged"), F.col("gl")).otherwise(F.col("l")), "mb": F.when(F.col("merged"), F.col("gb")).otherwise(F.col("b"))})
    purity = everywhere
    for bad, labelled in (("db", "dl"), ("sb", "sl"), ("tb", "tl"), ("mb", "ml")):
        purity = _smoothed(bad, labelled, purity)
    behind = F.coalesce(*[F.when(F.col(c) >= min_labelled, F.col(c)) for c in ("ml", "tl", "sl", "dl")], F.col("ml")).cast("long")
    final = met.select("host", F.col("template").alias("leaf"), F.when(F.col("merged"), F.col("shape")).otherwise(F.col("template")).alias("template"), behind.alias("labelled"), F.round(purity, 6).alias("purity"))
    known = tree.select("host", "path", F.col("template").alias("leaf")).join(final, ["host", "leaf"]).select("host", "path", "template", "labelled", "purity")
    learned = F.when((F.col("labelled") >= min_labelled) & (F.col("purity") >= threshold), "block").otherwise("allow")
    return rows.join(known, ["host", "path"]).select(
        F.col("page").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), learned.alias("learned"), "template", "labelled", "purity"
    )


def oracle(max_depth: int = MAX_DEPTH) -> str:
    """DuckDB SQL for ``judged`` over ``pages`` with the fixed rules and parameters."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))", h + p, v) for h, p, v in ordered]
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + " end"
    levels, last = [], "t0"
    for d in range(1, max_depth + 1):
        levels.append(f"""
s{d} as (select *, case when len(s) >= {d} then case when regexp_matches(s[{d}], '{NUMBERED}', 's') then regexp_replace(s[{d}], '{NUMBERED}', '*.\\1') when regexp_matches(s[{d}], '{VARIABLE}', 's') then '*' else s[{d}] end end as seg from {last}),
w{d} as (select host, template, true as wide from (select distinct host, template, seg from s{d} where seg is not null) group by all having count(*) > {MAX_CHILDREN}),
t{d} as (select s{d}.host, path, l, b, s, case when seg is null then s{d}.template else s{d}.template || '/' || case when wide then '*' else seg end end as template
  from s{d} left join w{d} on s{d}.host = w{d}.host and s{d}.template = w{d}.template)""")
        last = f"t{d}"
    purity = "(select p from prior)"
    for bad, labelled in (("db", "dl"), ("sb", "sl"), ("tb", "tl"), ("mb", "ml")):
        purity = f"(({bad} + {PRIOR_WEIGHT} * {purity}) / ({labelled} + {PRIOR_WEIGHT}))"
    return f"""
with u as (select page_id, url, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw from u),
r as (select page_id, translate(raw, '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path from h),
v as (select *, {rule} as rule, {verdict} as ruled from r),
t0 as (select host, path, count(rule) as l, count(*) filter (ruled = 'block') as b, list_filter(string_split(path, '/'), lambda x: x <> '') as s, '' as template from v group by host, path),
{",".join(levels)},
tree as (select host, path, l, b, case when len(s) > {max_depth} then template || '/**' else template end as leaf from {last}),
leaves as (select host, leaf, sum(l) as l, sum(b) as b, regexp_replace(leaf, '^((?:/\\*)*)/[^*/][^/]*', '\\1/{{}}') as shape, regexp_extract(host, '{DOMAIN}') as domain from tree group by host, leaf),
prior as (select coalesce(sum(b) / nullif(sum(l), 0), 0) as p from leaves),
pooled as (select host, shape, sum(l) as pl, sum(b) as pb from leaves where l >= {MIN_LABELLED} group by all),
m as (select leaves.*, case when leaves.l < {MIN_LABELLED} then true else abs(b / l - pb / pl) <= {MERGE_DEVIATIONS} * sqrt((pb / pl) * (1 - pb / pl) * (1 / l + 1 / pl)) end as alike
  from leaves left join pooled on leaves.host = pooled.host and leaves.shape = pooled.shape),
k as (select *, sum(l) filter (alike) over g as gl, sum(b) filter (alike) over g as gb, alike and count(*) filter (alike) over g > 1 as merged,
  sum(l) over (partition by domain) as dl, sum(b) over (partition by domain) as db, sum(l) over (partition by domain, shape) as sl, sum(b) over (partition by domain, shape) as sb,
  sum(l) over (partition by domain, leaf) as tl, sum(b) over (partition by domain, leaf) as tb from m window g as (partition by host, shape)),
n as (select *, case when merged then gl else l end as ml, case when merged then gb else b end as mb from k),
p as (select host, leaf, case when merged then shape else leaf end as template, round({purity}, 6) as purity,
  cast(case when ml >= {MIN_LABELLED} then ml when tl >= {MIN_LABELLED} then tl when sl >= {MIN_LABELLED} then sl when dl >= {MIN_LABELLED} then dl else ml end as bigint) as labelled from n),
j as (select *, case when labelled >= {MIN_LABELLED} and purity >= {THRESHOLD} then 'block' else 'allow' end as learned from p)
select v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, learned) as verdict, learned, template, labelled, purity
from v join tree on v.host = tree.host and v.path = tree.path join j on tree.host = j.host and tree.leaf = j.leaf
"""
