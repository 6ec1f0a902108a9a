"""URL filter: rules, and a ratio of character language models where no rule decides.

Two smoothed variable-order Markov models over characters, one of accepted URLs and one of rejected
ones, are trained on the URLs that the rules decide. Orders up to ``ORDER`` are blended by Witten-Bell
weights, from the longest context seen down to the even distribution. A URL's score is the sum of its
characters' log ratios (accepted over rejected) divided by its length. A quarter of the decided URLs, by a
hash of the URL, is kept from training: the score that best parts these, found on a histogram, is the
calibrated threshold, and URLs below it are blocked.

Everything is DataFrame expressions. Characters outside a small alphabet are one symbol, so each
model's table has at most ``len(ALPHABET) + 2`` to the power of ``ORDER`` + 1 rows whatever the corpus;
tables are broadcast if the grams that occur are ``BROADCAST_GRAMS`` at most, and joined by shuffle beyond; log ratios are whole micro-units, so sums do not depend on their order. The grams of a URL are made and
summed within the task that read it.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged
by its (possibly no) characters; without characters, or without decided URLs of both kinds on both
sides of the split, the verdict is allow; rows that repeat page_id and url give as many rows; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import cut

#: Rules as the query is asked for: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 3
#: Symbols of the models. All digits are 0; what is not here is ~; ^ stands before the URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./:-_?=&#%"
OTHER, BEFORE = "~", "^"
MICRO, BIN = 1_000_000, 10_000
#: One in so many decided URLs calibrates; grams at most in a broadcast table.
HELD, BROADCAST_GRAMS = 4, 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    lower = F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    return F.regexp_replace(lower, f"[^{ALPHABET.replace('-', chr(92) + '-')}]", OTHER)


def grams(urls: DataFrame, *keys: str) -> DataFrame:
    """keys and gram: each symbol with the ORDER symbols before it; one null for an empty URL."""
    line = urls.select(*keys, F.split(F.concat(F.lit(BEFORE * ORDER), symbols(F.col("url"))), "").alias("line"))
    n = F.size("line") - ORDER
    each = F.when(n > 0, F.arrays_zip(*[F.slice("line", k + 1, n).alias(f"s{k}") for k in range(ORDER + 1)]))
    return line.select(*keys, F.explode_outer(each).alias("s")).select(*keys, F.concat(*[F.col(f"s.s{k}") for k in range(ORDER + 1)]).alias("gram"))


def _sides(small: bool):
    return F.broadcast if small else (lambda df: df)


def _model(counts: DataFrame, small: bool) -> DataFrame:
    """gram and p: for each full gram, blended over all orders. counts: gram, n of one kind of URL, with n = 0 where only the other kind has the gram."""
    side = _sides(small)
    alphabet = len(ALPHABET) + 1
    p = F.lit(1.0 / alphabet)
    out = counts.select("gram", "n")
    for order in range(ORDER + 1):
        symbol = F.substring("gram", ORDER + 1 - order, order + 1)
        context = F.substring("gram", ORDER + 1 - order, order)
        own = counts.groupBy(symbol.alias("s")).agg(F.sum("n").alias("n"))
        per = own.where("n > 0").groupBy(F.substring("s", 1, order).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        out = out.withColumns({f"s{order}": symbol, f"c{order}": context})
        out = out.join(side(own.select(F.col("s").alias(f"s{order}"), F.col("n").alias(f"n{order}"))), f"s{order}", "left")
        out = out.join(side(per.select(F.col("c").alias(f"c{order}"), F.col("total").alias(f"t{order}"), F.col("kinds").alias(f"k{order}"))), f"c{order}", "left")
        total, kinds = F.coalesce(f"t{order}", F.lit(0)), F.coalesce(f"k{order}", F.lit(0))
        p = F.when(total > 0, (F.coalesce(f"n{order}", F.lit(0)) + kinds * p) / (total + kinds)).otherwise(p)
    return out.select("gram", p.alias("p"))


def train(decided: DataFrame, everything: DataFrame) -> tuple[DataFrame, bool]:
    """gram and ratio (micro-units) for every gram of ``everything``, as a table, and whether it may be broadcast. decided: url, verdict."""
    # counts of one class, and the grams of all URLs, are aggregated where they are read; both are bounded by the alphabet
    known = grams(decided, "verdict").where("gram IS NOT NULL").groupBy("gram").agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")])
    every = grams(everything).where("gram IS NOT NULL").groupBy("gram").agg(F.lit(0).cast("long").alias("allow"), F.lit(0).cast("long").alias("block"))
    counts = cut(known.unionByName(every).groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
    small = counts.count() <= BROADCAST_GRAMS
    good, bad = (_model(counts.select("gram", F.col(v).alias("n")), small) for v in ("allow", "block"))
    ratios = good.withColumnRenamed("p", "a").join(bad.withColumnRenamed("p", "b"), "gram").select("gram", F.round(F.log(F.col("a") / F.col("b")) * MICRO).cast("long").alias("ratio"))
    return cut(ratios, "ratios"), small


def held_out(url: Column) -> Column:
    """One in HELD (a power of two up to 16) by the first digit of the MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int"), F.lit(HELD)) == 0


def _scores(urls: DataFrame, ratios: DataFrame, small: bool) -> DataFrame:
    """urls (row, url) as row and score (micro-units a symbol, null without symbols). Rows of one key are alike, and so are their scores."""
    joined = grams(urls, "row").join(_sides(small)(ratios), "gram", "left")
    return joined.groupBy("row").agg(F.floor(F.sum("ratio") / F.count("ratio")).cast("long").alias("score"))


def threshold(scores: DataFrame) -> int | None:
    """The score that parts allow from block best, by the sum of both rates; None if one of them is missing. scores: verdict, score."""
    bins = scores.where("score IS NOT NULL").groupBy(F.floor(F.col("score") / BIN).cast("long").alias("bin")).agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")])
    # a bin for each hundredth: as many rows as ratios have hundredths
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gain = F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(whole) - F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.sum("allow").over(whole)
    both = bins.withColumns({"b": F.sum("block").over(whole), "a": F.sum("allow").over(whole)}).where("a > 0 AND b > 0")
    best = both.select("bin", gain.alias("gain")).orderBy(F.desc("gain"), "bin").first() if not both.isEmpty() else None
    return None if best is None else best["bin"] * BIN


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log ratio a symbol, null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    row = F.sha2(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("none"))), 256)
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path, "row": row})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    decided = rows.where("verdict IS NOT NULL").select("url", "verdict")
    ratios, small = train(decided.where(~held_out(F.col("url"))), rows.select("url"))
    scores = cut(_scores(rows.select("row", "url"), ratios, small), "scores")
    judged = rows.withColumn("held", held_out(F.col("url"))).drop("url").join(scores, "row", "left")
    least = threshold(judged.where("verdict IS NOT NULL AND held").select("verdict", "score"))
    by_model = F.when(F.col("score") < F.lit(least), "block").otherwise("allow") if least is not None else F.lit("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score") / MICRO).alias("score"))


def _blended(kind: str) -> str:
    """SQL: the probability of a gram in the model of one kind, order by order."""
    p = str(1.0 / (len(ALPHABET) + 1))
    for k in range(ORDER + 1):
        total, kinds = f"coalesce({kind}_t{k}.total, 0)", f"coalesce({kind}_t{k}.kinds, 0)"
        p = f"(CASE WHEN {total} > 0 THEN (coalesce({kind}_n{k}.n, 0) + {kinds} * {p}) / ({total} + {kinds}) ELSE {p} END)"
    return p


def _tables(kind: str) -> str:
    """SQL: counts of symbols after contexts of each order, and of contexts, in the training URLs of one kind."""
    return ", ".join(
        f"{kind}_n{k} AS MATERIALIZED (SELECT substr(g, {ORDER + 1 - k}) AS s, count(*)::DOUBLE AS n FROM gr JOIN rows USING (page) WHERE verdict = '{kind}' AND NOT held GROUP BY 1), "
        f"{kind}_t{k} AS MATERIALIZED (SELECT left(s, {k}) AS c, sum(n) AS total, count(*)::DOUBLE AS kinds FROM {kind}_n{k} GROUP BY 1)"
        for k in range(ORDER + 1)
    )


_JOINS = " ".join(f"LEFT JOIN {kind}_n{k} ON {kind}_n{k}.s = substr(g, {ORDER + 1 - k}) LEFT JOIN {kind}_t{k} ON {kind}_t{k}.c = substr(g, {ORDER + 1 - k}, {k})" for kind in ("allow", "block") for k in range(ORDER + 1))
_FITS = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' END" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
#: DuckDB SQL for the query.
ORACLE = f"""
WITH parts AS (SELECT row_number() OVER () AS page, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT *, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ru AS (SELECT *, coalesce({', '.join(_FITS)}) AS rule FROM hp),
rows AS MATERIALIZED (SELECT *, CASE rule {' '.join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)} END AS verdict, (instr('0123456789abcdef', left(md5(coalesce(url, '')), 1)) - 1) % {HELD} = 0 AS held,
  '{BEFORE * ORDER}' || regexp_replace(translate(lower(coalesce(url, '')), '123456789', '000000000'), '[^{ALPHABET.replace('-', chr(92) + '-')}]', '{OTHER}', 'g') AS line FROM ru),
gr AS MATERIALIZED (SELECT page, unnest(list_transform(range(1, len(line) - {ORDER - 1}), lambda i: substr(line, i, {ORDER + 1}))) AS g FROM rows),
{_tables("allow")}, {_tables("block")},
one AS MATERIALIZED (SELECT DISTINCT g FROM gr),
ra AS MATERIALIZED (SELECT g, round(ln({_blended("allow")} / {_blended("block")}) * {MICRO})::BIGINT AS ratio FROM one {_JOINS}),
sc AS (SELECT page, floor(sum(ratio) / count(*))::BIGINT AS score FROM gr JOIN ra USING (g) GROUP BY page),
sr AS MATERIALIZED (SELECT rows.*, score FROM rows LEFT JOIN sc USING (page)),
bi AS (SELECT floor(score / {BIN})::BIGINT AS bin, sum((verdict = 'allow')::INT)::DOUBLE AS a, sum((verdict = 'block')::INT)::DOUBLE AS b FROM sr WHERE held AND verdict IS NOT NULL AND score IS NOT NULL GROUP BY 1),
ga AS (SELECT bin, coalesce(sum(b) OVER w, 0) / sum(b) OVER () - coalesce(sum(a) OVER w, 0) / sum(a) OVER () AS gain, sum(a) OVER () AS oa, sum(b) OVER () AS ob FROM bi WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT first(bin ORDER BY gain DESC, bin) * {BIN} AS least FROM ga WHERE oa > 0 AND ob > 0)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN least IS NOT NULL AND score < least THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN score / {MICRO} END AS score FROM sr, th
"""
