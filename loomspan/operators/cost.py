"""Cost as a view: token rows joined with layered prices; never stored, so a price change re-prices all history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import scalars as S

LAYERS = ("user", "alias", "gateway", "community", "built-in")
# Tags of tiers; ids after this prefix are other models unless so continued.
TAGS = r"(@2027)?(>200k)?$"
GUARDED = "gemini-"
SAME_MODEL = r"^-(preview|latest|exp|\d)"
PRICE_SCHEMA = "layer string, provider string, prefix string, input double, output double, cache_read double, cache_write double, cache_write_1h double, alias string"


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """A price for each distinct (model, provider): the first layer with a hit, in it the longest prefix.

    Every prefix of the model id is looked up by equality, so there is no range join. Gateway rows match the whole id and
    their provider. An alias points at another id, priced by the layers below in one hop; a price of the same or a longer
    prefix beats it. Models without any price are not in the result.

    A model may carry the tags ``@2027`` and ``>200k``, in that order: its price is then the tier's of the entry found, where
    the user or the entry's own layer lists ``<prefix><tag>``.
    """
    bare = lambda c: S.model_id(F.regexp_replace(c, TAGS, ""))
    ids = models.select("model", "provider").distinct().withColumn("id", bare(F.col("model")))
    rates = ["input", "output", "cache_read", "cache_write", "cache_write_1h"]
    place = F.array_position(F.array(*map(F.lit, ("user", "gateway", "community", "built-in"))), F.col("layer"))
    base = F.when(F.col("layer").isin("community", "built-in"), F.lit(3)).otherwise(place)
    order = F.struct(base, -F.length("prefix"), place)

    def hits(rows: DataFrame) -> DataFrame:
        """Rows with each price entry whose prefix their ``id`` has; all columns of prices are null where there is none."""
        cut = rows.withColumn("prefix", F.explode_outer(F.transform(F.when(F.length("id") > 0, F.sequence(F.lit(1), F.length("id"))), lambda n: F.substring(F.col("id"), F.lit(1), n))))
        found = cut.join(prices.withColumnRenamed("provider", "_provider"), "prefix", "left")
        exact = (F.col("layer") != "gateway") | ((F.col("prefix") == F.col("id")) & (F.col("_provider") == F.col("provider")))
        variant = F.substr(F.col("id"), F.length("prefix") + 1)
        same = ~F.startswith(F.col("prefix"), F.lit(GUARDED)) | (variant == "") | variant.rlike(SAME_MODEL)
        return found.withColumn("layer", F.when(exact & same, F.col("layer")))

    price = F.struct("layer", "prefix", *rates)
    listed = F.coalesce(F.col("layer") != "alias", F.lit(False))
    # One pass finds a model's own price and its alias, a second one the price of the alias' target; the models are read once.
    own = hits(ids).groupBy("model", "provider").agg(
        F.min_by(price, F.when(listed, order)).alias("own"),
        F.max_by(F.struct("prefix", "alias"), F.when(F.col("layer") == "alias", F.length("prefix"))).alias("other"),
        F.max(F.when(F.col("layer") == "user", F.length("prefix"))).alias("user_length"),
    )
    aliased = F.col("other").isNotNull() & F.coalesce(F.col("user_length") < F.length("other.prefix"), F.lit(True))
    named = own.select("model", "provider", "own", aliased.alias("aliased"), F.col("other.prefix").alias("alias_prefix"), F.when(aliased, bare(F.col("other.alias"))).alias("id"))
    both = hits(named).groupBy("model", "provider").agg(
        F.first("own").alias("own"), F.first("aliased").alias("aliased"), F.first("alias_prefix").alias("alias_prefix"), F.min_by(price, F.when(listed, order)).alias("hop")
    )
    chosen = F.when(F.col("aliased"), F.when(F.col("hop").isNotNull(), F.struct(F.lit("alias").alias("layer"), F.col("alias_prefix").alias("prefix"), *(F.col(f"hop.{r}").alias(r) for r in rates)))).otherwise(F.col("own"))
    found = both.select("model", "provider", chosen.alias("_p"), F.when(F.col("aliased"), F.col("hop")).otherwise(F.col("own")).alias("_e"))
    return _tiers(found.filter("_p.layer IS NOT NULL"), prices, rates)


def _tiers(found: DataFrame, prices: DataFrame, rates: list[str]) -> DataFrame:
    """Resolved models, those of tagged ones with their tier's rates: ``@2027`` first, from there ``>200k``.

    ``_e`` is the entry found and ``_p`` what is told of it: an alias keeps its own layer and prefix.
    """
    tagged = F.regexp_extract("model", TAGS, 0)
    steps = F.when(tagged == "@2027>200k", F.array(F.lit("@2027"), F.lit("@2027>200k"), F.lit(">200k"))).when(tagged != "", F.array(tagged))
    asked = found.withColumn("tag", F.explode_outer(steps)).withColumn("prefix", F.concat("_e.prefix", "tag"))
    base = F.col("_e.layer").isin("community", "built-in")
    own = (F.col("layer") == F.col("_e.layer")) | (base & F.col("layer").isin("community", "built-in"))
    mine = (F.col("layer") == "user") | (own & ((F.col("layer") != "gateway") | (F.col("_provider") == F.col("provider"))))
    met = asked.join(prices.withColumnRenamed("provider", "_provider"), "prefix", "left")
    first = F.when(mine, F.array_position(F.array(*map(F.lit, ("user", "gateway", "community", "built-in"))), F.col("layer")))
    entry = F.struct(*rates, F.col("layer").alias("_layer"), F.col("prefix").alias("_prefix"))
    best = met.groupBy("model", "provider").agg(F.first("_p").alias("_p"), *(F.min_by(entry, F.when(F.col("tag") == t, first)).alias(n) for t, n in (("@2027", "_y"), ("@2027>200k", "_yb"), (">200k", "_b"))))
    # A long prompt's tier hangs on the year's one where there is one.
    tier = F.when(F.col("_y").isNotNull(), F.coalesce("_yb", "_y")).otherwise(F.col("_b"))
    rows = best.select("model", "provider", "_p", tier.alias("_t"))
    aliased, has = F.col("_p.layer") == "alias", F.col("_t").isNotNull()
    return rows.select(
        "model", "provider",
        F.when(has & ~aliased, F.col("_t._layer")).otherwise(F.col("_p.layer")).alias("layer"), F.when(has & ~aliased, F.col("_t._prefix")).otherwise(F.col("_p.prefix")).alias("prefix"),
        *(F.when(has, F.col(f"_t.{r}")).otherwise(F.col(f"_p.{r}")).alias(r) for r in rates),
    )


def list_cost() -> Column:
    """Dollars of a token row by its price; missing cache rates derive from the input rate."""
    read = F.coalesce("price_cache_read", F.col("price_input") * 0.1)
    short = F.coalesce("price_cache_write", F.col("price_input") * 1.25)
    long = F.coalesce("price_cache_write_1h", F.col("price_input") * 2)
    return (F.col("input") * F.col("price_input") + F.col("output") * F.col("price_output") + F.col("cache_read") * read + F.col("write_5m") * short + F.col("write_1h") * long) / 1e6


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Token rows with ``cost`` and its ``price_source``: the reported cost if above 0, else the list price, else unknown."""
    table = resolve_prices(requests, prices).select("model", "provider", "layer", *(F.col(c).alias(f"price_{c}") for c in ("input", "output", "cache_read", "cache_write", "cache_write_1h")))
    rows = requests.join(table, ["model", "provider"], "left")
    own = F.when(F.col("usd_reported") > 0, F.col("usd_reported"))
    source = F.when(own.isNotNull(), "reported").otherwise(F.col("layer"))
    cost = F.coalesce(own, list_cost())
    return rows.withColumn("cost", cost).withColumn("price_source", source).drop("layer", *(c for c in rows.columns if c.startswith("price_") and c != "price_source"))


def tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("write_5m") + F.col("write_1h")


def mode_sums(rows: DataFrame, by: list[str], modes: tuple[str, ...]) -> DataFrame:
    """Cost per billing mode side by side, the whole, unpriced tokens and the part priced through an alias."""
    return rows.groupBy(*by).agg(
        *(F.sum(F.when(F.col("mode") == m, F.col("cost")).otherwise(F.lit(0))).alias(f"cost_{m.lower()}") for m in modes),
        F.sum("cost").alias("cost"),
        F.sum(F.when(F.col("cost").isNull(), tokens()).otherwise(0)).alias("unpriced_tokens"),
        F.sum(F.when(F.col("price_source") == "alias", F.col("cost")).otherwise(F.lit(0))).alias("estimated"),
    )


def summary(rows: DataFrame, today: str, modes: tuple[str, ...]) -> DataFrame:
    """Sums of today, of the last seven days and of the month so far, by mode: one pass, a row adds to each period it lies in."""
    d = F.lit(today).cast("date")
    periods = F.array_compact(F.array(
        F.when(F.col("day") == d, "today"), F.when(F.col("day") > F.date_sub(d, 7), "week"), F.when(F.col("day") >= F.trunc(d, "month"), "month")
    ))
    since = F.least(F.date_sub(d, 6), F.trunc(d, "month"))
    return mode_sums(rows.filter((F.col("day") <= d) & (F.col("day") >= since)).withColumn("period", F.explode(periods)), ["period"], modes)


def unpriced(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` models with most unpriced tokens, and one row for the rest."""
    sums = rows.filter("cost IS NULL").groupBy("model").agg(F.sum(tokens()).alias("tokens"))
    ranked = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("tokens").desc(), "model")))  # one row a model
    name = F.when(F.col("place") <= k, F.col("model")).otherwise(F.lit("(more)"))
    return ranked.groupBy(name.alias("model")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("models"))


def price_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", "provider", "price_source").agg(F.count(F.lit(1)).alias("requests"), F.sum("cost").alias("cost"), F.sum(tokens()).alias("tokens"))


def day_costs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.sum("cost").alias("cost"), *(F.sum(F.when(F.col("hour") == h, F.col("cost")).otherwise(0.0)).alias(f"h{h}") for h in range(24)))


def project_today(rows: DataFrame, today: str, hour: int, days: int = 14, least: int = 3) -> DataFrame:
    """Today's spend with the hourly profile of the last active days for the hours ahead; unknown with too few active days.

    The current hour adds what its profile has left beyond what it already spent.
    """
    d = F.lit(today).cast("date")
    past = day_costs(rows.filter((F.col("day") < d) & (F.col("day") >= F.date_sub(d, days)))).filter("cost > 0")
    profile = past.agg(F.count(F.lit(1)).alias("active"), *(F.avg(f"h{h}").alias(f"p{h}") for h in range(hour, 24)))
    now = rows.filter(F.col("day") == d).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"), F.coalesce(F.sum(F.when(F.col("hour") == hour, F.col("cost"))), F.lit(0.0)).alias("this_hour"))
    ahead = sum((F.col(f"p{h}") for h in range(hour + 1, 24)), F.lit(0.0))
    both = profile.join(now, F.lit(True))  # one row each
    projected = F.when(F.col("active") >= least, F.col("spent") + ahead + F.greatest(F.lit(0.0), F.col(f"p{hour}") - F.col("this_hour")))
    return both.select("spent", "active", projected.alias("projected"))


def project_month(rows: DataFrame, today: str, days_left: int, today_projected: float | None, least: int = 3, days: int = 14) -> DataFrame:
    """Month to date, what today still brings, and the mean day since the first active one for each day left."""
    d = F.lit(today).cast("date")
    hist = rows.filter((F.col("day") < d) & (F.col("day") >= F.date_sub(d, days))).groupBy("day").agg(F.sum("cost").alias("cost"))
    active = F.col("cost") > 0
    sums = hist.agg(F.count_if(active).alias("active"), F.min(F.when(active, F.col("day"))).alias("first"), F.sum("cost").alias("total"))
    month = rows.filter((F.col("day") >= F.trunc(d, "month")) & (F.col("day") <= d)).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("month_to_date"), F.coalesce(F.sum(F.when(F.col("day") == d, F.col("cost"))), F.lit(0.0)).alias("spent")
    )
    rest = F.greatest(F.lit(0.0), F.lit(today_projected) - F.col("spent")) if today_projected is not None else F.lit(0.0)
    mean = F.col("total") / F.datediff(d, F.col("first"))
    both = sums.join(month, F.lit(True))  # one row each
    return both.select("month_to_date", "active", F.when(F.col("active") >= least, F.col("month_to_date") + rest + days_left * mean).alias("projected"))


def budget_state(used: Column, projected: Column, budget: float, warn_at: float = 0.8) -> Column:
    if budget <= 0:
        return F.lit("")
    return F.when(used >= budget, "over").when(F.coalesce(projected > budget, F.lit(False)) | (used >= warn_at * budget), "watch").otherwise("ok")
