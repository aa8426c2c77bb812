"""URL filters: host and path rules, and for the rest logistic regression on hashed character n-grams.

Everything runs as SQL expressions: the n-grams of host and path (each marked with its part and with its ends) are
hashed into `DIM` buckets, a URL's vector is the counts of its buckets over the root of their number, and
the weights come from a small labelled URL table by full-batch gradient descent, itself one SQL expression
over that table's single-row aggregate. The weights then stand in the plan as a literal, so scoring is one
projection over the url column, without a shuffle or a join.

Rules: a rule (host, path) fits its host and all subdomains if the URL's path begins with the rule's; the longest wins.

Defined cases: a null url, or one without `://`, has an empty host and path and gets the method's verdict for
those; no rule fits an empty path, as rules' paths begin with `/`; of fitting rules of one length that of the longer host wins
(two of one host and length cannot both fit), and equal rules are refused;
repeated rows are judged alike; empty tables give empty results; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

DIM = 1 << 14
GRAMS = (3, 4)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# The labelled table: hosts made up for it, and paths that both kinds of host get in turn.
BAD = """
casino-slots.example.com lucky-casino.example.net best-casino-bonus.example.org poker-win.example.com big-win-now.example.net
sports-bets.example.com bets-online.example.org freebets.example.net free-spins.example.com jackpot-win.example.org
cheap-meds.example.com pills-shop.example.net buy-pills.example.org discount-pills.example.com pharma-cheap.example.net
cheap-watches.example.org replica-cheap.example.com weight-loss-pills.example.net viagra-cheap.example.org generic-pills.example.com
adult-video.example.net adult-dating.example.com xxx-tube.example.org adult-chat.example.net sexy-cams.example.com
spam-links.example.net link-farm.example.com seo-spam.example.org spam-blog.example.net content-farm.example.com
ads-server.example.net ad-track.example.org click-track.example.com tracker-ads.example.net pixel-track.example.com
popup-ads.example.org banner-ads.example.com win-prize-free.example.net free-money.example.org crypto-win.example.com
""".split()  # fmt: skip
GOOD = """
library.example.com www.museum.example.org news.daily.example.net www.university.example.org blog.gardening.example.com
recipes.kitchen.example.net www.weather.example.com m.football.example.org docs.project.example.org wiki.history.example.net
www.cityhall.example.org forum.linux.example.net archive.letters.example.org www.bakery.example.com blog.travel.example.net
school.example.org m.theatre.example.com www.orchestra.example.net health.clinic.example.org www.physics.example.org
thenation.example.com thestation.example.net blog.theatre.example.org m.thering.example.com www.therapist.example.net
thenorth.example.org athens.example.com blog.ransom.example.net anderson.example.org m.hereford.example.com
www.reading.example.net oration.example.com wheaton.example.org blog.edition.example.com shandon.example.net
www.then.example.com m.other.example.net there.example.org blog.thatch.example.com nation.example.net
station.example.org www.mention.example.com lesson.example.net m.season.example.org blog.reason.example.com
bloom.example.net river.example.com www.forest.example.org stone.example.net m.meadow.example.com
train.example.org www.bridge.example.net harbour.example.com blog.market.example.org museum-shop.example.com
letters-home.example.net art-school.example.org www.book-club.example.com open-data.example.net m.city-news.example.org
""".split()  # fmt: skip
PATHS = ("/en/1042", "/en/2311/", "/de/118.html", "/fr/9015", "/es/77/", "/", "/index.html", "/en/30417", "/fr/250.html", "/de/41200/", "/es/6", "/about/team")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, bad): the labelled URL table."""
    rows = [f"('https://{h}{PATHS[i % len(PATHS)]}', {bad})" for bad, hosts in ((1, BAD), (0, GOOD)) for i, h in enumerate(hosts)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, bad)")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(chars: Column, part: str) -> Column:
    """Hash buckets of the n-grams of an array of characters."""

    def grams(n: int) -> Column:
        gram = lambda i: F.concat(F.lit(part), *[F.element_at(chars, (i + k).cast("int")) for k in range(n)])
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(DIM)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.concat(*[grams(n) for n in GRAMS])


def features(df: DataFrame) -> DataFrame:
    """df(url, ...) with __host, __path and __ids, the buckets of both."""
    df = df.withColumns({"__host": host(F.col("url")), "__path": path(F.col("url"))})
    df = df.withColumns({"__h": F.split(F.concat(F.lit("^"), "__host", F.lit("$")), ""), "__p": F.split(F.concat(F.lit("^"), "__path", F.lit("$")), "")})
    df = df.withColumns({"__h": F.filter("__h", lambda c: c != ""), "__p": F.filter("__p", lambda c: c != "")})
    return df.withColumn("__ids", F.concat(buckets(F.col("__h"), "h"), buckets(F.col("__p"), "p"))).drop("__h", "__p")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(ids: Column, weights: Column) -> Column:
    """ids count from 0; the last weight is the constant."""
    dot = F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.element_at(weights, i + 1))
    return F.element_at(weights, F.lit(-1)) + dot / F.sqrt(F.greatest(F.size(ids), F.lit(1)).cast("double"))


def fit(table: DataFrame, rounds: int = 200, rate: float = 16.0, decay: float = 0.0002, prior: float = 0.1, most: int = 20_000) -> list[float]:
    """Weights from table(url, bad): gradient descent over the whole table in each round.

    The constant is not learned but fixed by `prior`, the share of bad URLs to expect, so that a URL without
    n-grams of the table keeps that probability. The table is small by contract: over `most` rows raise ValueError.
    """
    if table.limit(most + 1).count() > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    rows = features(table.select("url", "bad").where("bad IS NOT NULL")).groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "bad", "__ids"))).alias("rows"))
    flat = rows.select(F.posexplode("rows").alias("e", "r")).select("e", F.col("r.bad").cast("double").alias("y"), (1 / F.sqrt(F.greatest(F.size("r.__ids"), F.lit(1)).cast("double"))).alias("x"), F.explode("r.__ids").alias("b"))
    # only the buckets that the table has get a slot, so a round costs no more with more buckets
    slots = flat.select("b").distinct().withColumn("slot", F.row_number().over(W.Window.orderBy("b")) - 1)
    flat = flat.join(slots, "b")
    whole = lambda df, *cols: df.groupBy().agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(cols[0])).withColumn("k", F.lit(1))  # noqa: E731  one row
    urls = whole(flat.groupBy("e").agg(F.first("y").alias("y"), F.sort_array(F.collect_list("slot")).alias("ids")), "e", "y", "ids")
    seen = whole(flat.groupBy("slot", "b").agg(F.sort_array(F.collect_list(F.struct("e", "x"))).alias("own")), "slot", "b", "own")
    data = urls.join(seen, "k").select(F.col("e").alias("rows"), F.col("slot").alias("slots"), F.greatest(F.size("e"), F.lit(1)).cast("double").alias("n"))
    rows_, slots_, n = F.col("rows"), F.col("slots"), F.col("n")

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(rows_, lambda r: r["y"] - sigmoid(logit(r["ids"], w)))

        def moved(e: Column) -> Column:
            grad = lambda s: F.aggregate(s["own"], F.lit(0.0), lambda a, o: a + F.element_at(e, o["e"] + 1) * o["x"])
            new = F.transform(slots_, lambda s, i: F.element_at(w, i + 1) * (1 - rate * decay) + grad(s) * (rate / n))
            return F.concat(new, F.array(F.element_at(w, F.lit(-1))))

        return F.element_at(F.transform(F.array(errors), moved), 1)  # the errors are made once a round

    constant = math.log(prior / (1 - prior))
    start = F.concat(F.array_repeat(F.lit(0.0), F.size(slots_)), F.array(F.lit(constant)))
    got = data.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("w"), F.transform(slots_, lambda s: s["b"]).alias("b")).first()
    out = [0.0] * DIM + [constant]
    for b, w in zip(got.b, got.w, strict=False):
        out[b] = w
    return out


def matched(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null where none fits."""
    if len({(h, p) for h, p, _ in rules}) < len(rules):
        raise ValueError("a rule occurs twice")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability of block) for every row."""
    weights = fit(labelled(spark) if table is None else table)
    literal = F.expr(f"cast(split('{','.join(map(repr, weights))}', ',') AS array<double>)")
    df = features(pages.select("page_id", "url"))
    rule, verdict = matched(F.col("__host"), F.col("__path"), rules)
    df = df.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("ruled"), sigmoid(logit(F.col("__ids"), literal)).alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
