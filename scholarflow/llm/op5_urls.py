"""URL filter by a character language-model ratio, in DataFrame operations only.

Urls that a rule allows or blocks are the accepted and rejected examples. Each class has a
variable-order Markov model over characters, with Witten-Bell smoothing from three characters of
context down to none; a url's score is the difference of its two log-likelihoods divided by its
length. Two thirds of the examples train the models, the others calibrate the threshold, which lies
between the two means in proportion to the standard deviations.

All counts come from one table of 4-grams, so that the text is exploded once for training and once
for scoring; frequent grams are salted in the scoring join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER, ALPHABET, SALT = 4, 256.0, 16
START, END = "\x02" * (ORDER - 1), "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host to `?`, `#` or the end; empty if there is no `://`."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character and end of each url: the character with the three before it."""
    padded = F.concat(F.lit(START), "url", F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("url") + 1))
    return urls.select(*keep, padded.alias("_s"), at.alias("_i")).select(*keep, F.col("_s").substr(F.col("_i"), F.lit(ORDER)).alias("gram"))


def log_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio) for every 4-gram of `urls` (url, n_allow, n_block: examples of each class to learn from).

    ratio is ln P_allow - ln P_block of the gram's last character after its first three. A gram that no
    example has gets what shorter contexts give, down to 1 / 256.
    """
    counts = grams(urls, "n_allow", "n_block").groupBy("gram").agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b"))
    counts = checkpointed(counts)
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # shorter grams are sums of longer ones
        levels.append(levels[-1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    below = None
    for k, level in enumerate(reversed(levels), 1):
        context = level.groupBy(F.expr(f"substring(gram, 1, {k - 1})").alias("ctx")).agg(
            F.sum("a").alias("na"), F.count(F.when(F.col("a") > 0, 1)).alias("ta"), F.sum("b").alias("nb"), F.count(F.when(F.col("b") > 0, 1)).alias("tb")
        )
        rows = level.withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})")).join(context, "ctx")
        if below is None:
            rows = rows.withColumns({"qa": F.lit(1 / ALPHABET), "qb": F.lit(1 / ALPHABET)})
        else:
            shorter = below.select(F.col("gram").alias("short"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            rows = rows.withColumn("short", F.expr(f"substring(gram, 2, {k - 1})")).join(shorter, "short")
        smooth = lambda n, total, kinds, q: F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(q)) / (F.col(total) + F.col(kinds))).otherwise(F.col(q))
        below = rows.select("gram", smooth("a", "na", "ta", "qa").alias("pa"), smooth("b", "nb", "tb", "qb").alias("pb"))
    return below.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict.

    A null or empty url fits no rule and scores 0 against the threshold. Without examples of a class
    the threshold is 0, and a url at the threshold is allowed.
    """
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("kind", kind)
    learn = F.crc32("url") % 3 != 1
    urls = parsed.filter("url is not null").groupBy("url").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    urls = urls.select("url", "kind", learn.alias("learn"), *[F.when(learn & (F.col("kind") == k), F.col("n")).otherwise(0).alias(f"n_{k}") for k in ("allow", "block")])
    # the checkpoint fixes the numbers of the urls, which stand for them in the exploded rows
    urls = checkpointed(urls.withColumn("uid", F.monotonically_increasing_id()))
    ratios = checkpointed(log_ratios(urls))
    salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    of = grams(urls.withColumn("salt", F.pmod(F.crc32("url"), F.lit(SALT)).cast("int")), "uid", "salt").join(salted, ["gram", "salt"])
    scores = of.groupBy("uid").agg(F.round(F.sum("ratio") / F.count(F.lit(1)), 9).alias("score"))
    scored = checkpointed(urls.join(scores, "uid").select("url", "kind", "learn", "score"))
    of_kind = lambda k: F.when(F.col("kind") == k, F.col("score"))
    stats = scored.filter("not learn").agg(*[f(of_kind(k)).alias(f"{n}_{k}") for k in ("allow", "block") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    spread = F.col("s_allow") + F.col("s_block")
    middle = F.when(spread > 0, (F.col("m_allow") * F.col("s_block") + F.col("m_block") * F.col("s_allow")) / spread).otherwise((F.col("m_allow") + F.col("m_block")) / 2)
    # one row, whatever the input
    limit = F.broadcast(stats.select(F.coalesce(F.round(middle, 9), F.lit(0.0)).alias("threshold"), F.lit(1).alias("one")))
    judged = parsed.join(scored.select("url", "score"), "url", "left").withColumn("one", F.lit(1)).join(limit, "one")
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.col("threshold"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("kind", by_model).alias("verdict"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rest = "substring(url, instr(url, '://') + 3)"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{pick(k, h, p)}'" for k, h, p in ordered) + " end"
    levels = []
    for k in range(ORDER - 1, 0, -1):
        levels.append(f"g{k} as (select substring(gram, 2, {k}) as gram, sum(a) as a, sum(b) as b from g{k + 1} group by 1)")
    for k in range(1, ORDER + 1):
        below, q = (f"join p{k - 1} q on q.gram = substring(g.gram, 2, {k - 1})", ("q.pa", "q.pb")) if k > 1 else ("", (f"1.0::double/{ALPHABET}",) * 2)
        smooth = lambda n, q: f"case when c.n{n} > 0 then (g.{n} + c.t{n} * {q}) / (c.n{n} + c.t{n}) else {q} end"
        levels.append(
            f"""c{k} as (select substring(gram, 1, {k - 1}) as ctx, sum(a)::double as na, count(case when a > 0 then 1 end)::double as ta, sum(b)::double as nb, count(case when b > 0 then 1 end)::double as tb from g{k} group by 1),
p{k} as (select g.gram, {smooth("a", q[0])} as pa, {smooth("b", q[1])} as pb from g{k} g join c{k} c on c.ctx = substring(g.gram, 1, {k - 1}) {below})"""
        )
    chain = ",\n".join(levels)
    return f"""
with parsed as (
  select page_id, url, host, path, {case(lambda k, h, p: h + p)} as rule, {case(lambda k, h, p: k)} as kind from (
    select page_id, url,
      case when contains(url, '://') then translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') else '' end as host,
      case when contains(url, '://') then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path
    from pages) x),
folds as (select url, any_value(kind) as kind, count(*) as n from parsed where url is not null group by url),
crc as (select f.*, ({_CRC}) % 3 <> 1 as learn from folds f),
grams as (select c.url, c.kind, c.learn, c.n, substring(repeat(chr(2), {ORDER - 1}) || c.url || chr(3), i::int, {ORDER}) as gram from crc c, unnest(range(1, length(c.url) + 2)) as t(i)),
g{ORDER} as (select gram, sum(case when learn and kind = 'allow' then n else 0 end)::double as a, sum(case when learn and kind = 'block' then n else 0 end)::double as b from grams group by 1),
{chain},
scored as (select url, any_value(kind) as kind, any_value(learn) as learn, round(sum(ln(pa) - ln(pb)) / count(*), 9) as score from grams join p{ORDER} using (gram) group by url),
stats as (select avg(score) filter (kind = 'allow') ma, stddev_pop(score) filter (kind = 'allow') sa, avg(score) filter (kind = 'block') mb, stddev_pop(score) filter (kind = 'block') sb from scored where not learn),
lim as (select coalesce(round(case when sa + sb > 0 then (ma * sb + mb * sa) / (sa + sb) else (ma + mb) / 2 end, 9), 0) as threshold from stats)
select page_id, host, path, rule, coalesce(p.kind, case when coalesce(s.score, 0) >= lim.threshold then 'allow' else 'block' end) as verdict
from parsed p left join scored s using (url), lim
"""


#: CRC-32 of the url's UTF-8 bytes: DuckDB has no such function, so bits are folded one by one.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(f.url)) + 1), lambda i: ('0x' || substring(hex(encode(f.url)), (2 * i - 1)::int, 2))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""

SQL = _sql()
