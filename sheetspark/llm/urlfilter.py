"""URL filter: rules for hosts and paths, and a path-template tree for what no rule fits.

Per host, paths are put into a tree of segments. Numbers in a segment are one sign; a segment that is one
of many below its parent, each with a small share, is variable and becomes a wildcard, level by level from
the root, for as long as a parent has paths enough for that. Templates that differ in one segment only, at
whichever level, are siblings; those whose labels do not differ from the other siblings' more than chance
allows are merged, and a template counts with the merge that has most labels. It is rejected if the share
of bad ones among its labelled pages, smoothed towards the share of all, is high enough.

Labels of pages come from the caller (1 bad, 0 good, null none). Everything is DataFrame operations: pages
are first counted by host and path shape, each level of the tree is settled as a table, and the rows of a
key that a large part of all rows have, be it a host, a shape or a template, are dealt over tasks.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, settle, spread_join

#: Children above which those with less than one part in ``SHARE`` of their parent's pages are variable.
FAN, SHARE = 16, 20
#: Smoothing weight of the share of all, share from which a template is rejected, and the deviations and
#: slack within which branches are alike.
WEIGHT, REJECT, DEVIATIONS, SLACK = 4.0, 0.8, 1.96, 0.02


@dataclass(frozen=True)
class Rule:
    """``host/path`` and allow or block; it fits the host and its subdomains, and paths that start alike."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equal ones, that with the longer host), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """A path with every run of digits as one 0."""
    return F.regexp_replace(path, "[0-9]+", "0")


def segments(path: Column) -> Column:
    """What stands between a path's slashes, as an array; an empty path has no segments."""
    parts = F.split(path, "/")
    return F.slice(parts, 2, F.size(parts))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, norm, n, labelled, bad) with their template: variable segments as ``*``, from the root down.

    A level is looked at as long as some parent has more than ``FAN`` shapes below it; where none has, no
    segment further down can be variable.
    """
    tree, k = settle(shapes.select("*", segments(F.col("norm")).alias("segs"), F.lit("").alias("prefix"))), 0
    below = ["host", "prefix"]
    while True:
        deep = tree.where(F.size("segs") > k)
        most = deep.groupBy(*below).count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            break
        children = settle(deep.groupBy(*below, F.get("segs", F.lit(k)).alias("seg")).agg(F.sum("n").alias("own")))
        wide = settle(children.groupBy(*below).agg(F.count("*").alias("fan"), F.sum("own").alias("whole")).where(F.col("fan") > FAN))
        variable = settle(spread_join(children, wide, below, narrow=False).where(F.col("own") * SHARE < F.col("whole")).select(*below, "seg", F.lit("*").alias("wild")))
        named = spread_join(tree.withColumn("seg", F.get("segs", F.lit(k))), variable, [*below, "seg"], how="left", narrow=False)
        longer = F.concat("prefix", F.lit("/"), F.coalesce("wild", "seg"))
        tree = settle(named.withColumn("prefix", F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(longer)).select(*tree.columns))
        k += 1
    rest = F.when(F.size("segs") > k, F.concat(F.lit("/"), F.array_join(F.slice("segs", k + 1, F.greatest(F.size("segs"), F.lit(1))), "/"))).otherwise(F.lit(""))
    return tree.withColumn("template", F.concat("prefix", rest)).drop("segs", "prefix")


def judged(tree: DataFrame) -> DataFrame:
    """(host, template, rejected): each template's verdict by smoothed purity, alike siblings merged."""
    leaf = ["host", "template"]
    leaves = settle(tree.groupBy(*leaf).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    total = leaves.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    overall = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    # a template's key at a level: all of it but the segment there
    w, places = F.col("w"), F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))
    keys = F.transform(places, lambda k: F.struct(k.alias("level"), F.xxhash64(k, F.slice(w, F.lit(1), k - 1), F.slice(w, k + 1, F.size(w))).alias("key")))
    known = leaves.where("labelled > 0").withColumn("w", segments(F.col("template")))
    at = settle(known.select(*leaf, "labelled", "bad", F.inline(keys)))
    group = ["host", "level", "key"]  # siblings: few, as most of many children are one wildcard
    pools = at.groupBy(*group).agg(F.sum("labelled").alias("pool_l"), F.sum("bad").alias("pool_b"))
    others_l, others_b = F.nullif(F.col("pool_l") - F.col("labelled"), F.lit(0)), F.col("pool_b") - F.col("bad")
    pool = F.col("pool_b") / F.col("pool_l")
    chance = F.lit(DEVIATIONS) * F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / F.col("labelled") + F.lit(1.0) / others_l)) + F.lit(SLACK)
    alike = settle(at.join(pools, group).where(F.abs(F.col("bad") / F.col("labelled") - others_b / others_l) <= chance).select(*group, "template", "labelled", "bad"))
    merged = alike.groupBy(*group).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    ways = leaves.select(*leaf, F.lit(0).alias("level"), F.col("labelled").alias("l"), F.col("bad").alias("b")).unionByName(alike.join(merged, group).select(*leaf, "level", "l", "b"))
    best = ways.groupBy(*leaf).agg(F.max_by(F.struct("l", "b"), F.struct("l", -F.col("level"))).alias("x"))
    purity = (F.col("x.b") + F.lit(WEIGHT * overall)) / (F.col("x.l") + F.lit(WEIGHT))
    return best.select(*leaf, ((F.col("x.l") > 0) & (purity >= REJECT)).alias("rejected"))


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", label: Callable[[Column, Column, Column], Column] | None = None,
    evidence: Callable[[Column], Column] | None = None, html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), template.

    ``label`` makes a label column of (host, path, the rule's verdict); without it rules' verdicts are the
    labels, and where no rule fits, what ``evidence`` makes of the page's ``html_col``.

    Defined cases: a null url or one without ``://`` has an empty host and path, as a host of its own;
    repeated rows count each and get equal values; a null id is carried along; an empty table gives no rows;
    no labels at all: everything no rule blocks is allowed; a segment that is a star is taken for a
    wildcard; a null html is no evidence; other columns are not read.
    """
    url = F.col("url").cast("string")
    seen = evidence(F.col("html").cast("string")) if evidence else F.lit(None)
    columns = {"page_id": id_col, "url": url_col} | ({"html": html_col} if evidence else {})
    host, path = host_and_path(url)
    split = pick(pages, **columns).select("page_id", host.alias("host"), path.alias("path"), seen.cast("int").alias("seen"))
    split = split.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "seen", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("by_rule"), shape(F.col("path")).alias("norm"))
    said = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0).otherwise(F.col("seen"))
    marked = settle(split.withColumn("label", label(F.col("host"), F.col("path"), F.col("by_rule")) if label else said).drop("seen"))
    shapes = marked.groupBy("host", "norm").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.coalesce(F.col("label"), F.lit(0))).cast("long").alias("bad"))
    tree = settle(templates(shapes))
    by_shape = settle(spread_join(tree.select("host", "norm", "template"), judged(tree), ["host", "template"], narrow=False))
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return spread_join(marked, by_shape, ["host", "norm"], narrow=False).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


#: The rules of the query.
RULES = [Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block")]
#: A small labelled table: words that tell bad pages where they stand in a page by themselves.
BAD_WORDS = ("adult", "ads", "bets", "betting", "casino", "escort", "jackpot", "payday", "pills", "poker", "porn", "replica", "roulette", "spam", "viagra", "warez", "xxx")
_BAD = "(^|[^0-9A-Za-z])(" + "|".join(BAD_WORDS) + ")([^0-9A-Za-z]|$)"


def page_evidence(html: Column) -> Column:
    """1 for pages with a bad word anywhere in their html, 0 for others, null without html."""
    return F.when(html.isNotNull(), html.rlike(_BAD).cast("int"))


#: Levels of the tree that the SQL spells out; the query goes as deep as its paths need.
SQL_LEVELS = 6


def oracle_sql() -> str:
    """The query as DuckDB SQL."""
    cases = "".join(
        f" when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then {i}"
        for i, r in sorted(enumerate(RULES), key=lambda x: (-len(x[1].text), -len(x[1].host), x[1].text))
    )
    of = lambda what: "case rule_at" + "".join(f" when {i} then '{getattr(r, what)}'" for i, r in enumerate(RULES)) + " end"
    levels, source = "", "cut"
    for k in range(1, SQL_LEVELS + 1):
        levels += f""",
c{k} as (select host, prefix, segs[{k}] as seg, sum(n) as own from {source} where len(segs) >= {k} group by all),
p{k} as (select host, prefix, count(*) as fan, sum(own) as whole from c{k} group by all),
n{k} as (select host, prefix, seg, case when fan > {FAN} and own * {SHARE} < whole then '*' else seg end as w from c{k} join p{k} using (host, prefix)),
t{k} as (
  select s.host, s.norm, s.labelled, s.bad, s.n, s.segs, case when w is null then s.prefix else s.prefix || '/' || w end as prefix
  from {source} s left join n{k} on s.host = n{k}.host and s.prefix = n{k}.prefix and s.segs[{k}] = n{k}.seg
)"""
        source = f"t{k}"
    return f"""
with hosts as (
  select page_id, html, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as after from pages
), cut_urls as (
  select page_id, html, translate(regexp_extract(after, '(?s)^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(after, '(?s)^[^/?#]*([^?#]*)', 1) as path from hosts
), ruled as (select *, case{cases} end as rule_at, regexp_replace(path, '[0-9]+', '0', 'g') as norm from cut_urls),
named as (select *, {of("text")} as rule, {of("verdict")} as by_rule from ruled),
marked as (select * exclude (html), case when by_rule = 'block' then 1 when by_rule = 'allow' then 0 when html is not null then cast(regexp_matches(html, '{_BAD}') as int) end as label from named),
shapes as (select host, norm, count(*) as n, count(label) as labelled, coalesce(sum(label), 0) as bad from marked group by host, norm),
cut as (select *, string_split(norm, '/')[2:] as segs, '' as prefix from shapes){levels},
tree as (select host, norm, labelled, bad, prefix || case when len(segs) > {SQL_LEVELS} then '/' || array_to_string(segs[{SQL_LEVELS + 1}:], '/') else '' end as template from t{SQL_LEVELS}),
leaves as (select host, template, sum(labelled) as labelled, sum(bad) as bad from tree group by all),
overall as (select case when sum(labelled) > 0 then sum(bad)::double / sum(labelled)::double else 0 end as g from leaves),
known as (select *, string_split(template, '/')[2:] as w from leaves where labelled > 0),
ways as (select host, template, labelled::double as labelled, bad::double as bad, w, unnest(range(1, len(w) + 1)) as level from known),
placed as (select *, w[1:level - 1] as ahead, w[level + 1:] as behind from ways),
pools as (select host, level, ahead, behind, sum(labelled) as pool_l, sum(bad) as pool_b from placed group by all),
alike as (
  select placed.* from placed join pools using (host, level, ahead, behind)
  where pool_l - labelled > 0 and abs(bad / labelled - (pool_b - bad) / (pool_l - labelled)) <= {DEVIATIONS} * sqrt(pool_b / pool_l * (1.0 - pool_b / pool_l) * (1.0 / labelled + 1.0 / (pool_l - labelled))) + {SLACK}
), merged as (select host, level, ahead, behind, sum(labelled) as l, sum(bad) as b from alike group by all),
every as (
  select host, template, 0 as level, labelled::double as l, bad::double as b from leaves
  union all select host, template, level, l, b from alike join merged using (host, level, ahead, behind)
), best as (select *, row_number() over (partition by host, template order by l desc, level) as way from every),
verdicts as (select host, template, l > 0 and (b + {WEIGHT} * g) / (l + {WEIGHT}) >= {REJECT} as rejected from best, overall where way = 1)
select page_id, host, path, rule, coalesce(by_rule, case when rejected then 'block' else 'allow' end) as verdict, template
from marked join tree using (host, norm) join verdicts using (host, template)
"""
