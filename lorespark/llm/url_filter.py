"""7: URL filters. Rules first; else the ratio of two character language models, of accepted and of rejected URLs.

Both models are variable-order Markov models: the estimate with a longer context is smoothed by the next shorter one.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: Longest context in characters, strength of the shorter context's estimate, size of the alphabet.
ORDER = 3
STRENGTH = 4.0
ALPHABET = 256.0
#: Grams (about 60 bytes each) that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_GRAMS = 250_000
#: Rules that are tested one by one, in one expression; longer lists are joined.
MAX_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD = "\x02" * ORDER

Rule = tuple[str, str]  # verdict (allow or block), host/path prefix


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host and path: after the first ://, the host up to / ? # (A-Z lower-cased), the path up to ? or #."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, the first listed of equally long ones; null if none."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, tail = rule.partition("/")
        same = (host == name) | host.endswith("." + name)
        fits.append(F.when(same & path.startswith(slash + tail), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def with_rules(urls: DataFrame, rules: list[Rule], most: int = MAX_RULES) -> DataFrame:
    """urls (url distinct, host, path) with rule and verdict, as matched_rule has them; null if none fits.

    More than `most` rules are joined by the host's ends and by a beginning of the path: a rule by its longest one of 0, 1,
    2, 4, ... characters, so a url makes one probe for each end and such length, however many rules a host has.
    """
    if len(rules) <= most:
        rows = urls.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
        return rows.select(*urls.columns, F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))
    listed = []
    for place, (verdict, rule) in enumerate(rules):
        name, slash, tail = rule.partition("/")
        tail = slash + tail
        size = 1 << (len(tail).bit_length() - 1) if tail else 0
        listed.append((name, tail[:size], size, tail, rule, verdict, place))
    schema = "name string, head string, size int, tail string, rule string, verdict string, place int"
    table = small(urls.sparkSession.createDataFrame(listed, schema))
    sizes = F.array(*[F.lit(n) for n in sorted({row[2] for row in listed})])
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = urls.select("url", "path", F.explode(ends).alias("name")).withColumn("size", F.explode(sizes)).where(F.length("path") >= F.col("size"))
    held = probes.withColumn("head", F.substr("path", F.lit(1), F.col("size"))).join(table, ["name", "size", "head"]).where(F.startswith("path", "tail"))
    best = held.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), -F.col("place"))).alias("m"))
    return urls.join(best, "url", "left").select(*urls.columns, F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """key and, for each character of the url, the gram of that character and the ORDER characters before it."""
    padded = F.concat(F.lit(_PAD), F.coalesce("url", F.lit("")))
    places = F.sequence(F.lit(1), F.length(F.coalesce("url", F.lit(""))))
    cut = F.when(F.length("url") > 0, F.transform(places, lambda i: F.substr(padded, i, F.lit(ORDER + 1))))
    return rows.select(key, F.explode(cut).alias("gram"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """gram and the log ratio of its last character's probabilities, from rows (verdict, gram)."""
    table = grams.groupBy("gram").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).cast("double").alias("a0"),
        F.count(F.when(F.col("verdict") == "block", 1)).cast("double").alias("r0"),
    )
    table = materialize(table, "gram-counts")
    rows = table.select("gram", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pr"))
    for k in range(ORDER + 1):
        tail = F.substr("gram", F.lit(ORDER + 1 - k))
        counted = table.groupBy(tail.alias("tail")).agg(F.sum("a0").alias("a"), F.sum("r0").alias("r"))
        context = counted.groupBy(F.substr("tail", F.lit(1), F.lit(k)).alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        counted = counted.join(context, F.substr("tail", F.lit(1), F.lit(k)) == F.col("context"))
        rows = rows.join(counted, tail == F.col("tail")).select(
            "gram",
            ((F.col("a") + STRENGTH * F.col("pa")) / (F.col("ca") + STRENGTH)).alias("pa"),
            ((F.col("r") + STRENGTH * F.col("pr")) / (F.col("cr") + STRENGTH)).alias("pr"),
        )
    return rows.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def filter_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, score and verdict of every row.

    The models learn from the urls that rules accept or reject. score is the mean log ratio over a url's characters (0
    for null and empty urls); the threshold lies between the two classes' means, nearer to the one that spreads less,
    and is 0 if a class has no url. Urls are scored once however often they repeat; ids may be null or repeated; other
    columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    urls = with_host_and_path(rows.select("url").distinct())
    urls = materialize(with_rules(urls, rules), "urls")
    table = materialize(gram_scores(_grams(urls.select("verdict", "url"), "verdict")), "grams")
    scored = _grams(urls.select("url"), "url").join(small(table, BROADCAST_GRAMS), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))
    urls = urls.join(scored, "url", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    urls = materialize(urls, "scored-urls")
    side = lambda v: F.when(F.col("verdict") == v, F.col("score"))
    fit = urls.agg(
        F.avg(side("allow")).alias("ma"), F.avg(side("block")).alias("mr"), F.stddev_pop(side("allow")).alias("sa"), F.stddev_pop(side("block")).alias("sr")
    )
    spread = F.col("sa") + F.col("sr")
    line = F.when(spread > 0, (F.col("ma") * F.col("sr") + F.col("mr") * F.col("sa")) / spread).otherwise((F.col("ma") + F.col("mr")) / 2)
    line = fit.select(F.round(F.coalesce(line, F.lit(0.0)), 9).alias("line"))  # one row
    judged = urls.join(F.broadcast(line)).select(
        "url", "host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= F.col("line"), "allow").otherwise("block")).alias("verdict")
    )
    return rows.join(judged, "url").select(F.col("id").alias(id_col), "host", "path", "rule", "score", "verdict")
