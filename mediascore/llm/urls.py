"""URL filter with a path-template tree, in DataFrame functions only.

Explicit rules decide first, and label the urls that they fit.  For the rest a
tree of path templates is grown for each host, one level after another, over
the counts of distinct path shapes:

* shape: runs of digits in a segment become {n}, long hexadecimal segments {h};
* generalise: where a node has many children and few urls for each, the
  segment varies and its children become one wildcard child;
* merge: of the other children, those with enough labelled urls whose share of
  blocked ones does not differ from their parent's (a z-test) become one
  branch; the rest, and children without labels, stay apart;
* reject: a template is blocked if its labelled purity reaches the threshold.
  It is smoothed, as by two more labels, towards that of the same template on
  all hosts, (blocked + 1) / (labelled + 2); so a template that has no labels
  on its host is judged as elsewhere, and one that has none at all has 1/2.

Segments beyond DEPTH are one tail segment of the template: a level costs a
round of jobs, and paths may have thousands of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.session import materialize

DEPTH = 4
MANY, FEW = 10, 3.0  # children at least, urls a child at most, of a varying segment
LABELLED, Z = 5, 1.0  # labelled urls at least, z at most, of a branch that merges
PURITY = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules``:
    (verdict, rule); a rule fits its host and all subdomains if the path starts
    with the rule's; of equally long ones the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in reversed(sorted(rules, key=lambda x: -len(x[1]))):
        at = r.find("/")
        name, start = (r[:at], r[at:]) if at >= 0 else (r, "")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> list[Column]:
    """The shaped segments of levels 1 to DEPTH, null beyond the path's end, and the tail's mark."""
    parts = F.split(path, "/")
    shaped = lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    levels = [F.when(F.size(parts) > k, shaped(F.try_element_at(parts, F.lit(k + 1)))) for k in range(1, DEPTH + 1)]
    return [*levels, F.when(F.size(parts) > DEPTH + 1, F.lit("**"))]


def templates(paths: DataFrame) -> DataFrame:
    """Grow the trees.  ``paths``: host, s1.., n, blocked, allowed for each
    distinct shape.  Adds template and purity."""
    t = paths.withColumn("template", F.lit(""))
    for k in range(1, DEPTH + 2):
        s = f"s{k}"
        kids = t.where(F.col(s).isNotNull()).groupBy("host", "template", s).agg(F.sum("n").alias("kn"), F.sum("blocked").alias("kb"), F.sum("allowed").alias("ka"))
        # a parent's sums come from its children's, so no node's urls meet in one task
        parents = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("kn").alias("pn"), F.sum("kb").alias("pb"), F.sum("ka").alias("pa"))
        share = (F.col("pb") + 1) / (F.col("pb") + F.col("pa") + 2)
        labelled = F.col("kb") + F.col("ka")
        z = F.abs(F.col("kb") / labelled - share) / F.sqrt(share * (1 - share) / labelled)
        kind = (
            F.when((F.col("kids") >= MANY) & (F.col("pn") / F.col("kids") < FEW), "*")
            .when((F.col("kids") > 1) & (labelled >= LABELLED) & (z < Z), "{~}")
            .otherwise(F.col(s))
        )
        named = kids.join(parents, ["host", "template"]).select(
            F.col("host").alias("h"), F.col("template").alias("above"), F.col(s).alias("seg"), F.concat("template", F.lit("/"), kind).alias("below")
        )
        joined = t.join(named, (F.col("host") == F.col("h")) & (F.col("template") == F.col("above")) & (F.col(s) == F.col("seg")), "left")
        # each level is read twice by the next: written, it is computed once
        t = materialize(joined.withColumn("template", F.coalesce("below", "template")).drop("h", "above", "seg", "below"), "level")
    sums = t.groupBy(F.col("host").alias("h"), F.col("template").alias("tt")).agg(F.sum("blocked").alias("tb"), F.sum("allowed").alias("ta"))
    # a row for each host and template, and one for each template
    sums = materialize(sums, "templates")
    overall = sums.groupBy(F.col("tt").alias("ot")).agg(((F.sum("tb") + 1) / (F.sum("tb") + F.sum("ta") + 2)).alias("everywhere"))
    purity = (F.col("tb") + 2 * F.col("everywhere")) / (F.col("tb") + F.col("ta") + 2)
    sums = sums.join(overall, F.col("tt") == F.col("ot")).select("h", "tt", purity.alias("purity"))
    return t.join(sums, (F.col("host") == F.col("h")) & (F.col("template") == F.col("tt"))).drop("h", "tt")


def judge(pages: DataFrame, rules: list[tuple[str, str]], *keep: Column) -> DataFrame:
    """Adds to the columns ``keep`` of each page: host, path, rule (null if
    none fits), template and purity (null where a rule decides) and verdict.
    A null url, or one without ://, has empty host and path and is judged like
    any other; repeated rows are judged alike and count as often as they
    occur; no rows give no rows.  Only url is read besides ``keep``, whose names must
    not be those of the added columns."""
    rows = pages.select(*keep, F.col("url").alias("__url"))
    kept = rows.columns[:-1]
    parsed = rows.select("*", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    levels = [c.alias(f"s{k}") for k, c in enumerate(shapes(F.col("path")), 1)]
    names = [f"s{k}" for k in range(1, DEPTH + 2)]
    all_ = parsed.select(*[F.col(f"`{c}`") for c in kept], "host", "path", rule.alias("rule"), verdict.alias("__verdict"), F.struct(*levels).alias("__s"))
    flat = all_.select("host", "__s.*", "__verdict")
    counted = flat.groupBy("host", *names).agg(
        F.count("*").alias("n"),
        F.sum((F.col("__verdict") == "block").cast("long")).alias("b"),
        F.sum((F.col("__verdict") == "allow").cast("long")).alias("a"),
    )
    counted = materialize(counted.select("host", *names, "n", F.coalesce("b", F.lit(0)).alias("blocked"), F.coalesce("a", F.lit(0)).alias("allowed")), "paths")
    key = lambda cols: F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]))
    tree = templates(counted).select(key([F.col("host"), *[F.col(x) for x in names]]).alias("__key"), "template", "purity")
    # a page that a rule decides needs no template; its key, its own url, meets none and keeps the join even
    free = key([F.col("host"), *[F.col(f"__s.{x}") for x in names]])
    asked = all_.withColumn("__ask", F.when(F.col("__verdict").isNull(), free).otherwise(F.concat_ws("", F.lit("#"), F.col("host"), F.col("path"))))
    out = asked.join(tree, F.col("__ask") == F.col("__key"), "left")
    decided = F.coalesce("__verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "template", "purity", decided.alias("verdict"))


def oracle(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict) of judge()."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def case(what) -> str:
        arms = []
        for v, r in sorted(rules, key=lambda x: -len(x[1])):
            at = r.find("/")
            name, start = (r[:at], r[at:]) if at >= 0 else (r, "")
            arms.append(f"WHEN (host = {q(name)} OR ends_with(host, {q('.' + name)})) AND starts_with(path, {q(start)}) THEN {q(what(v, r))}")
        return "CASE " + " ".join(arms) + " ELSE NULL END"

    seg = lambda k: f"parts[{k + 1}]"
    shaped = lambda k: (
        f"CASE WHEN len(parts) > {k} THEN CASE WHEN regexp_full_match({seg(k)}, '[0-9a-fA-F-]{{16,}}') THEN '{{h}}' ELSE regexp_replace({seg(k)}, '[0-9]+', '{{n}}', 'g') END END AS s{k}"
    )
    names = [f"s{k}" for k in range(1, DEPTH + 2)]
    same = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in names)
    host = f"translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    steps = [
        f"p0 AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"p1 AS (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled, string_split(path, '/') AS parts FROM p0)",
        f"p2 AS (SELECT *, {', '.join(shaped(k) for k in range(1, DEPTH + 1))}, CASE WHEN len(parts) > {DEPTH + 1} THEN '**' END AS s{DEPTH + 1} FROM p1)",
        f"t0 AS (SELECT host, {', '.join(names)}, count(*) AS n, count(*) FILTER (ruled = 'block') AS blocked, count(*) FILTER (ruled = 'allow') AS allowed, '' AS template FROM p2 GROUP BY ALL)",
    ]
    for k in range(1, DEPTH + 2):
        cols = ", ".join(f"t.{x}" for x in ["host", *names, "n", "blocked", "allowed"])
        steps += [
            f"k{k} AS (SELECT host, template, s{k} AS seg, sum(n) AS kn, sum(blocked) AS kb, sum(allowed) AS ka FROM t{k - 1} WHERE s{k} IS NOT NULL GROUP BY ALL)",
            f"q{k} AS (SELECT host, template, count(*) AS kids, sum(kn) AS pn, (sum(kb) + 1)::DOUBLE / (sum(kb) + sum(ka) + 2) AS share FROM k{k} GROUP BY ALL)",
            f"m{k} AS (SELECT k.host, k.template, k.seg, k.template || '/' || CASE WHEN kids >= {MANY} AND pn::DOUBLE / kids < {FEW} THEN '*'"
            f" WHEN kids > 1 AND kb + ka >= {LABELLED} AND abs(kb::DOUBLE / (kb + ka) - share) / sqrt(share * (1 - share) / (kb + ka)) < {Z} THEN '{{~}}' ELSE k.seg END AS below"
            f" FROM k{k} k JOIN q{k} q ON k.host = q.host AND k.template = q.template)",
            f"t{k} AS (SELECT {cols}, coalesce(m.below, t.template) AS template FROM t{k - 1} t LEFT JOIN m{k} m ON t.host = m.host AND t.template = m.template AND t.s{k} = m.seg)",
        ]
    last = f"t{DEPTH + 1}"
    steps.append(f"o AS (SELECT template, (sum(blocked) + 1)::DOUBLE / (sum(blocked) + sum(allowed) + 2) AS everywhere FROM {last} GROUP BY template)")
    steps.append(
        f"u AS (SELECT l.*, (sum(blocked) OVER w + 2 * everywhere)::DOUBLE / (sum(blocked) OVER w + sum(allowed) OVER w + 2) AS purity"
        f" FROM {last} l JOIN o ON o.template = l.template WINDOW w AS (PARTITION BY l.host, l.template))"
    )
    return (
        f"WITH {', '.join(steps)} SELECT p2.page_id, p2.host, p2.path, p2.rule, coalesce(p2.ruled, CASE WHEN u.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict"
        f" FROM p2 JOIN u ON p2.host = u.host AND {same('p2', 'u')}"
    )
