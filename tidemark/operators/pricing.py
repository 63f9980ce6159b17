"""Cost of usage from a catalogue of rates: which row prices a model, and what its tiers and surcharges come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import names
from tidemark.session import is_small

# Thresholds of progressive tiers by kind of use, and of requests that are priced as a whole.
TIERS = {"input": (128_000, 200_000, 256_000, 272_000), "output": (128_000, 200_000, 256_000, 272_000), "cache_read": (200_000, 272_000), "cache_write": (200_000,)}
WHOLE_OPENAI, WHOLE_XAI = 272_000, 200_000
# Labels that name no model, providers that resell others' models, and tier words in brackets.
ROUTING = ["auto", "agent_review"]
RESELLERS = ["azure_ai", "bedrock", "openrouter", "together_ai", "fireworks_ai"]
LEVELS = "low|medium|high|xhigh|minimal|none"
# Vendors that publish their own models, and words that name no model of their own.
ORIGINALS = ["x-ai", "xai", "anthropic", "openai", "google", "meta-llama", "mistralai", "minimax", "deepseek", "z-ai", "qwen", "cohere", "perplexity", "moonshotai"]
GENERAL = ["auto", "mini", "chat", "base", "claude", "anthropic", "gemini", "model", "router", "default"]
MOST_SUFFIX, MOST_PREFIX, LEAST_NAME, LEAST_INSIDE = 4, 2, 2, 5
#: Columns of a catalogue that hold rates; a row without any is no price.
RATES = ("input", "output", "cache_read", "cache_write")
#: Stages of names: custom prices, names as they are, names inside catalogue names, shortened names.
CUSTOM, INSIDE, SHORTER = -1, 6, 8


def tiered(units: Column, base: Column, above: Column, threshold: int) -> Column:
    """Units beyond the threshold cost the upper rate, where there is one."""
    return progressive(units, base, [(threshold, above)])


def progressive(units: Column, base: Column, tiers: list[tuple[int, Column]]) -> Column:
    """Each unit at the rate of the highest tier that it lies beyond; absent rates are skipped, negative units cost nothing."""
    units = F.greatest(units.cast("double"), F.lit(0.0))
    rate = _rate(base)
    cost = units * F.coalesce(rate, F.lit(0.0))
    below = F.coalesce(rate, F.lit(0.0))
    for threshold, above in tiers:
        own = _rate(above)
        cost = cost + F.when(own.isNotNull(), F.greatest(units - threshold, F.lit(0.0)) * (own - below)).otherwise(0.0)
        below = F.coalesce(own, below)
    return cost


def _rate(rate: Column) -> Column:
    """A rate that is a finite number from 0 on, else null."""
    value = rate.cast("double")
    return F.when((value >= 0) & (value < float("inf")) & ~F.isnan(value), value)


def whole_request(units: Column, prompt: Column, base: Column, above: Column, threshold: int, inclusive: bool = False) -> Column:
    """A prompt beyond the threshold (from it on, where inclusive) prices all of its request's units at the upper rate."""
    beyond = prompt >= threshold if inclusive else prompt > threshold
    return units * F.when(beyond & above.isNotNull(), above).otherwise(base)


def cache_surcharge(cache_write: Column, one_hour: Column, input_rate: Column, write_rate: Column) -> Column:
    """What cache writes kept for an hour cost beyond their rate: twice the input rate less that rate, if more."""
    hour = F.greatest(F.least(one_hour, cache_write), F.lit(0))
    return F.coalesce(hour * F.greatest(2.0 * _rate(input_rate) - F.coalesce(_rate(write_rate), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def request_cost(usage: dict[str, Column], rates: dict[str, Column], vendor: Column) -> Column:
    """Cost of one request. usage: input, output, reasoning (billed as output), cache_read, cache_write; rates: the same with _128 ... _272 for tiers.

    Of OpenAI's models more than 272,000 units of prompt price the whole request at the upper rates, of xAI's 200,000 or more;
    all others are priced progressively.
    """
    kinds = {"input": usage["input"], "output": F.greatest(usage["output"], F.lit(0)) + F.greatest(usage["reasoning"], F.lit(0)), "cache_read": usage["cache_read"], "cache_write": usage["cache_write"]}
    prompt = sum((F.greatest(usage[k], F.lit(0)) for k in ("cache_read", "cache_write")), F.greatest(usage["input"], F.lit(0)))
    nothing = F.lit(None).cast("double")
    get = lambda k, t: rates.get(f"{k}_{t // 1000}", nothing)
    steps = sum((progressive(n, rates[k], [(t, get(k, t)) for t in TIERS[k]]) for k, n in kinds.items()), F.lit(0.0))
    flat = lambda t: sum((F.greatest(n.cast("double"), F.lit(0.0)) * F.coalesce(_rate(get(k, t)), _rate(rates[k]), F.lit(0.0)) for k, n in kinds.items()), F.lit(0.0))
    base = sum((F.greatest(n.cast("double"), F.lit(0.0)) * F.coalesce(_rate(rates[k]), F.lit(0.0)) for k, n in kinds.items()), F.lit(0.0))
    openai, xai = (vendor == "openai") & _rate(get("input", WHOLE_OPENAI)).isNotNull(), (vendor == "xai") & _rate(get("input", WHOLE_XAI)).isNotNull()
    return F.when(openai, F.when(prompt > WHOLE_OPENAI, flat(WHOLE_OPENAI)).otherwise(base)).when(xai, F.when(prompt >= WHOLE_XAI, flat(WHOLE_XAI)).otherwise(base)).otherwise(steps)


def covers(usage: dict[str, Column], rates: dict[str, Column]) -> Column:
    """Whether every kind that is used has a base rate, or all rates that are told are zero."""
    told = F.array(*rates.values())
    zero = _rate(rates["input"]).isNotNull() & _rate(rates["output"]).isNotNull() & ~F.exists(told, lambda r: r.isNotNull() & (r != 0))
    each = F.lit(True)
    for kind, n in usage.items():
        each = each & ((n <= 0) | _rate(rates["output" if kind == "reasoning" else kind]).isNotNull())
    return F.coalesce(zero, F.lit(False)) | each


def precedence(reported: Column, priced: Column, conflicted: Column) -> Column:
    """A cost that the source reports stands; rows with conflicting evidence of their model stay without one."""
    return F.when(reported.isNotNull(), reported).when(conflicted, None).otherwise(priced)


def refused(model: Column, provider: Column) -> Column:
    """Whether no rate may be looked up: routing labels, unknown brackets and providers without prices."""
    name, by = F.lower(F.trim(model)), F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    return name.isin(ROUTING) | (by == "unpriced") | F.startswith(by, F.lit("unpriced:")) | (name.rlike(r"\([^()]*\)$") & ~name.rlike(rf"\(({LEVELS})\)$"))


def candidates(models: DataFrame) -> DataFrame:
    """model_id, hint, key and stage of each name under which a distinct model may stand in the catalogue: linear in its parts.

    Stages: as written, canonical, without its path; then without up to four last parts, then without up to two first
    ones; each followed by the same with its separators alike.
    """
    ids = models.select("model_id", "hint").distinct().where(~refused(F.col("model_id"), F.col("hint")))
    name, plain, last = _names(F.col("model_id"))
    parts = F.split(last, "-")
    n = F.size(parts)
    # the number of parts that may go leaves one at least
    shorter = F.transform(F.sequence(F.lit(1), F.lit(MOST_SUFFIX)), lambda k: F.struct(F.when(k < n, F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), "-")).alias("key"), (k - 1 + SHORTER // 2).alias("stage")))
    later = F.transform(F.sequence(F.lit(1), F.lit(MOST_PREFIX)), lambda k: F.struct(F.when(k < n, F.array_join(F.slice(parts, k + 1, n), "-")).alias("key"), (k - 1 + SHORTER // 2 + MOST_SUFFIX).alias("stage")))
    first = F.array(*[F.struct(k.alias("key"), F.lit(i).alias("stage")) for i, k in enumerate((name, plain, last))])
    found = ids.select("model_id", "hint", F.explode(F.concat(first, shorter, later)).alias("c")).select("model_id", "hint", "c.key", "c.stage")
    # each name as it is, then with its separators alike
    spelt = F.array(F.struct("key", (F.col("stage") * 2).alias("stage")), F.struct(names.alias_key(F.col("key")).alias("key"), (F.col("stage") * 2 + 1).alias("stage")))
    found = found.select("model_id", "hint", F.explode(spelt).alias("c")).select("model_id", "hint", "c.key", "c.stage")
    return found.where(F.length("key") >= LEAST_NAME).groupBy("model_id", "hint", "key").agg(F.min("stage").alias("stage"))


def _names(model: Column) -> tuple[Column, Column, Column]:
    plain = names.canonical_model(model)
    return F.lower(F.trim(model)), plain, F.element_at(F.split(plain, "/"), -1)


def fragments(name: Column, least: int = LEAST_INSIDE) -> Column:
    """Every part of a name that begins and ends where a word does: before it no letter or digit, and none after it.

    A name of w words has about w * w / 2 such parts; they are the index by which names inside others are found.
    """
    size = F.length(name)
    places = F.sequence(F.lit(1), size)
    sign = lambda at: F.regexp_like(F.substr(name, at, F.lit(1)), F.lit(r"[^\p{L}\p{N}]"))
    starts = F.filter(places, lambda at: (at == 1) | sign(at - 1))
    ends = F.filter(places, lambda at: (at == size) | sign(at + 1))
    parts = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda e: e >= a + (least - 1)), lambda e: F.substr(name, a, e - a + 1))))
    return F.when(size > 0, F.array_distinct(parts))


def _found(wanted: DataFrame, rates: DataFrame, custom: DataFrame | None) -> DataFrame:
    """Every usable catalogue row of a model and hint with the stage at which its name was found."""
    told = [c for c in RATES if c in rates.columns]
    usable = F.exists(F.array(*[F.col(c).cast("double") for c in told]), lambda r: _rate(r).isNotNull()) if told else F.lit(True)
    catalogue = rates.where(usable).withColumn("__name", F.lower("key"))
    paths = catalogue.withColumn("__name", F.explode(F.array_distinct(F.array(F.col("__name"), names.alias_key(F.col("__name")), F.element_at(F.split("__name", "/"), -1)))))
    paths = F.broadcast(paths) if is_small(rates) else paths
    whole = candidates(wanted).withColumnRenamed("key", "__name").join(paths, "__name")
    # names inside others meet by their parts in an equi-join, never each with each
    ids = wanted.select("model_id", "hint").distinct().where(~refused(F.col("model_id"), F.col("hint")))
    asked = ids.select("model_id", "hint", F.explode(F.array_distinct(F.array(*_names(F.col("model_id"))))).alias("__name")).where((F.length("__name") >= LEAST_INSIDE) & ~F.col("__name").isin(GENERAL))
    parts = catalogue.withColumn("__name", F.explode(fragments(F.col("__name"))))
    inside = asked.join(parts, "__name").withColumn("stage", F.lit(INSIDE))
    found = whole.unionByName(inside.select(whole.columns))
    if custom is not None:
        own = custom.where(F.exists(F.array(*[F.col(c).cast("double") for c in told]), lambda r: _rate(r).isNotNull()) if told else F.lit(True)).withColumn("__name", F.lower("key"))
        written = ids.select("model_id", "hint", F.explode(F.array_distinct(F.array(F.lower("model_id"), F.lower(names.gateway_model(F.col("model_id")))))).alias("__name"), F.lit(CUSTOM).alias("stage"))
        found = found.unionByName(written.join(own, "__name").select("model_id", "hint", "__name", "stage", *own.drop("__name").columns), allowMissingColumns=True)
    return found


def _ordered(found: DataFrame, sources: list[str]) -> tuple[DataFrame, list[Column]]:
    """The rows found with what ranks them: stage, source, hint, who publishes the row, the longest and the first key."""
    root = F.when(F.contains("key", F.lit("/")), F.lower(F.element_at(F.split("key", "/"), 1)))
    by = F.coalesce(names.canonical_provider(F.col("provider")), names.canonical_provider(root)) if "provider" in found.columns else names.canonical_provider(root)
    hint, resold = names.canonical_provider(F.col("hint")), F.coalesce(F.coalesce(root, by).isin(RESELLERS), F.lit(False))
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    # a hint that is a reseller itself asks for resellers' rows
    wants_resold = F.coalesce(F.lower("hint").isin(RESELLERS), F.lit(False))
    source = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)) if sources and "source" in found.columns else F.lit(1)
    ranked = found.withColumns({
        "__hinted": yes(by == hint), "__vendor": yes(by == names.inferred_provider(F.col("model_id"))), "__original": yes(root.isin(ORIGINALS)), "__resold": (resold != wants_resold).cast("int"),
        "__source": F.when(source > 0, source).otherwise(len(sources) + 1), "__long": F.length("key"),
    })
    best = [F.col("stage"), F.col("__hinted").desc(), F.col("__source"), F.col("__vendor").desc(), F.col("__original").desc(), F.col("__resold"), F.col("__long").desc(), F.col("key")]
    rest = [F.col(c) for c in found.columns if c not in ("model_id", "hint", "key", "stage", "__name")]
    return ranked, [*best, *rest]


def look_up(models: DataFrame, rates: DataFrame, custom: DataFrame | None = None, sources: list[str] | None = None) -> DataFrame:
    """The catalogue row (key, and all its other columns) of each distinct model_id and hint; models without one are absent.

    rates: key, and any columns; provider and source are used where they are there, the source by the order of sources.
    Rows without a usable rate are no candidates. custom: rows of the same kind that stand before all others where the
    model is written as they are, whatever its case. All candidate names meet the catalogue in equi-joins: whole names,
    and names that stand inside a catalogue name. Of the rows found the earliest stage counts, then the hinted
    provider, the source, the vendor of the model's family, a vendor's own row, no reseller (or one, where the hint is
    a reseller), the longest and the first key.
    """
    wanted = models if "hint" in models.columns else models.withColumn("hint", F.lit(None).cast("string"))
    ranked, order = _ordered(_found(wanted, rates, custom), sources or [])
    first = ranked.withColumn("__place", F.row_number().over(Window.partitionBy("model_id", "hint").orderBy(*order))).where("__place = 1")
    kept = first.select("model_id", "hint", "key", "stage", *[c for c in rates.columns if c != "key"])
    return kept if "hint" in models.columns else kept.drop("hint")


def evidence(models: DataFrame, rates: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """How sure a price is: of each distinct model and hint the rows of its earliest stage, whether all have the same input and output rates, whether the name stood as written, and the stage."""
    wanted = models if "hint" in models.columns else models.withColumn("hint", F.lit(None).cast("string"))
    found = _found(wanted, rates, custom)
    best = found.withColumn("__first", F.min("stage").over(Window.partitionBy("model_id", "hint"))).where("stage = __first")
    told = best.dropDuplicates(["model_id", "hint", "key", *[c for c in rates.columns if c != "key"]])
    counted = told.groupBy("model_id", "hint").agg(F.count("*").alias("n_candidates"), F.count_distinct(F.struct(F.coalesce("input", F.lit(-1.0)), F.coalesce("output", F.lit(-1.0)))).alias("prices"), F.min("stage").alias("stage"))
    found = counted.select("model_id", "hint", "n_candidates", (F.col("prices") == 1).alias("consensus"), F.col("stage").isin(CUSTOM, 0).alias("exact"), "stage")
    return found if "hint" in models.columns else found.drop("hint")


def borrowed(hinted: DataFrame, canonical: DataFrame, key: str, base: tuple[str, ...], more: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """Rates that a row lacks come from the canonical row of its key if all base rates that both have agree."""
    other = canonical.select(key, *[F.col(c).alias(f"__{c}") for c in (*base, *more)])
    agree = F.lit(True)
    for c in base:
        a, b = F.col(c), F.col(f"__{c}")
        agree = agree & (a.isNull() | b.isNull() | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))))
    joined = hinted.join(other, key, "left").withColumn("__agree", F.coalesce(agree, F.lit(False)))
    return joined.select(key, *base, *[F.coalesce(F.col(c), F.when(F.col("__agree"), F.col(f"__{c}"))).alias(c) for c in more])
