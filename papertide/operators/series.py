"""Calendar series, smoothing, growth, lifecycle and co-occurrence of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertide.operators.corpus import month_number, number_month


def densify(stats: DataFrame, keys: list[str], values: list[str], first: str, last: str) -> DataFrame:
    """A row for every key and month from ``first`` to ``last`` with zeros for absent months. Only the
    keys' months are generated; the values come by an equi-join."""
    lo, hi = (int(m[:4]) * 12 + int(m[5:7]) for m in (first, last))
    calendar = stats.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_m")).withColumn("month", number_month(F.col("_m")))
    joined = calendar.join(stats.select(*keys, "month", *values), [*keys, "month"], "left")
    return joined.select(*keys, "month", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def _over(keys: list[str], frame: str) -> str:
    return f"over (partition by {', '.join(keys)} order by month {frame})"


def rolling(series: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Adds ``smooth``: mean of this and the ``width`` - 1 months before (fewer at the start)."""
    return series.withColumn("smooth", F.expr(f"avg({value}) {_over(keys, f'rows between {width - 1} preceding and current row')}"))


def ewma(series: DataFrame, keys: list[str], value: str, alpha: float = 0.35) -> DataFrame:
    """Adds ``smooth``: exponentially weighted mean that starts at the first value; a key's months
    (bounded by the calendar) are folded in order."""
    folded = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", F.col(value).cast("double").alias("v")))).alias("s"))
    points = F.aggregate(
        "s",
        F.array().cast("array<struct<month:string,smooth:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["month"].alias("month"), F.when(F.size(acc) == 0, x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * F.element_at(acc, -1)["smooth"]).alias("smooth")))),
    )
    return folded.select(*keys, F.inline(points))


def zscore(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``z``: distance from the key's mean in population deviations, a deviation of 0 counting as 1."""
    part = f"over (partition by {', '.join(keys)})"
    sd = F.expr(f"stddev_pop({value}) {part}")
    return series.withColumn("z", (F.col(value) - F.expr(f"avg({value}) {part}")) / F.when(sd == 0, 1.0).otherwise(sd))


def compare(series: DataFrame, keys: list[str], value: str, smoothing: str = "raw") -> DataFrame:
    """Keys, month, value: the ``zscore`` of the whole series, smoothed after that by rolling_3, rolling_6, ewma or, as raw, not at all."""
    z = zscore(series, keys, value).select(*keys, "month", "z")
    if smoothing == "raw":
        return z.withColumnRenamed("z", "value")
    smoothed = ewma(z, keys, "z") if smoothing == "ewma" else rolling(z, keys, "z", {"rolling_3": 3, "rolling_6": 6}[smoothing])
    return smoothed.select(*keys, "month", F.col("smooth").alias("value"))


def heatmap(stats: DataFrame, first: str, last: str, metric: str, shown: DataFrame, concept_class: str | None = None, without: tuple[str, ...] = (), min_count: int = 2, top: int = 40) -> DataFrame:
    """term, month, value: cells above 0 of the ``top`` terms by the sum of ``metric`` over the months from ``first`` to ``last``.

    Terms come from ``shown`` (term, concept_class; a missing class is the empty one), of ``concept_class`` only if it is given, none of the classes ``without``, and need ``min_count``
    papers. Sums are compared to nine digits, equal ones by name.
    """
    kind = F.coalesce("concept_class", F.lit(""))
    allowed = shown.filter(~kind.isin(list(without))) if without else shown
    allowed = allowed.filter(kind == concept_class) if concept_class else allowed
    cells = stats.filter(F.col("month").between(first, last))
    sums = cells.join(allowed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.round(F.sum(metric), 9).alias("score"), F.sum("raw_freq").alias("n"))
    best = sums.filter(F.col("n") >= max(1, min_count)).orderBy(F.desc("score"), "term").limit(top).select("term")
    return cells.filter(F.col(metric) > 0).join(F.broadcast(best), "term", "left_semi").select("term", "month", F.col(metric).alias("value"))


def growth(stats: DataFrame, last: str) -> DataFrame:
    """term, recent, previous, change: weight of the last three calendar months against the three before."""
    end = int(last[:4]) * 12 + int(last[5:7])
    m = month_number("month")
    both = stats.filter(m.between(end - 5, end)).groupBy("term").agg(
        F.sum(F.when(m > end - 3, F.col("weighted_freq")).otherwise(0.0)).alias("recent"), F.sum(F.when(m <= end - 3, F.col("weighted_freq")).otherwise(0.0)).alias("previous")
    )
    return both.withColumn("change", (F.col("recent") + 1) / (F.col("previous") + 1))


def growth_table(stats: DataFrame, last: str, shown: DataFrame, rising: bool, least: float = 1.0) -> DataFrame:
    """Rows of ``growth`` for the terms of ``shown`` (term, concept_class) that are physics concepts, or have no class, and weigh ``least`` or more in the recent months
    (rising) or in those before (cooling). Terms that are not shown never rank."""
    concepts = shown.filter(F.coalesce("concept_class", F.lit("physics_concept")) == "physics_concept").select("term").distinct()
    return growth(stats.join(concepts, "term", "left_semi"), last).filter(F.col("recent" if rising else "previous") >= least)


def lifecycle(dense: DataFrame, trend_from: str, trend_to: str) -> DataFrame:
    """One row for each ``term`` of a dense calendar (month, raw_freq, weighted_freq): first months, peak,
    half-life, active span, longest burst, counts before and in the trend months, novelty, recent sums."""
    n = month_number("month")
    lo, hi = (int(m[:4]) * 12 + int(m[5:7]) for m in (trend_from, trend_to))
    w, raw = F.col("weighted_freq"), F.col("raw_freq")
    rows = dense.withColumn("n", n)
    whole = rows.groupBy("term").agg(
        F.min(F.when(raw > 0, F.col("month"))).alias("first_seen"),
        F.min(F.when((raw > 0) & n.between(lo, hi), F.col("month"))).alias("trend_first_seen"),
        F.max(w).alias("peak_value"),
        F.min_by("n", F.struct(-w, F.col("n"))).alias("peak_n"),
        F.avg(w).alias("mean"), F.stddev_pop(w).alias("sigma"),
        F.sum(raw).alias("baseline_total"), F.sum(F.when(n < lo, raw).otherwise(0)).alias("before_trend"), F.sum(F.when(n.between(lo, hi), raw).otherwise(0)).alias("trend_total"),
        F.count_if(raw > 0).alias("active_months"),
        F.sum(F.when(n > hi - 3, w).otherwise(0.0)).alias("recent_3m"), F.sum(F.when(n.between(hi - 5, hi - 3), w).otherwise(0.0)).alias("previous_3m"),
        F.sum(F.when(n > hi - 6, raw).otherwise(0)).alias("recent_6m_count"), F.sum(F.when(n == hi, w).otherwise(0.0)).alias("current"),
    ).filter("baseline_total > 0")
    # rows of a term stay together: the second look at the calendar is one join and one aggregation
    marked = rows.join(whole.select("term", "peak_value", "peak_n", F.expr("mean + sigma").alias("burst")), "term")
    active = w >= F.greatest(F.lit(1.0), F.col("peak_value") * 0.2)
    marked = marked.withColumns({"active": active, "high": w > F.col("burst")})
    run = F.expr("n - row_number() over (partition by term, high order by n)")
    bursts = marked.withColumn("run", run).groupBy("term", "high", "run").agg(F.count("*").alias("length")).groupBy("term").agg(
        F.coalesce(F.max(F.when(F.col("high"), F.col("length"))), F.lit(0)).alias("burst_months")
    )
    shape = marked.groupBy("term").agg(
        F.min(F.when((F.col("n") > F.col("peak_n")) & (w <= F.col("peak_value") * 0.5), F.col("n") - F.col("peak_n"))).alias("half_life"),
        F.coalesce(F.max(F.when(F.col("active"), F.col("n"))) - F.min(F.when(F.col("active"), F.col("n"))) + 1, F.lit(0)).alias("active_span"),
    )
    out = whole.join(shape, "term").join(bursts, "term").withColumn("peak_month", number_month(F.col("peak_n")))
    return out.withColumn("novelty", 1 / (1 + F.col("before_trend"))).drop("peak_n", "mean", "sigma")


def lifecycle_status(life: DataFrame, concept_class: Column) -> DataFrame:
    """Adds ``status``: the first rule that holds of persistent, emerging, stale, active and cooling."""
    c = F.col
    rising = (c("recent_3m") + 1) / (c("previous_3m") + 1) >= 2
    return life.withColumn("concept_class", concept_class).withColumn(
        "status",
        F.when(c("concept_class").isin("platform_material", "method", "general_field") | (c("active_months") >= 18) | (c("before_trend") >= 50), "persistent")
        .when(c("concept_class").isin("physics_concept", "material_system") & (c("before_trend") <= 5) & (c("recent_3m") >= 3) & rising & (c("trend_total") >= 3), "emerging")
        .when((c("before_trend") > 0) & (c("recent_6m_count") == 0), "stale")
        .when((c("recent_6m_count") > 0) & (c("peak_value") > 0) & (c("current") >= 0.5 * c("peak_value")) & (c("before_trend") > 5), "active")
        .when((c("peak_value") > 0) & (c("recent_3m") < 0.5 * c("peak_value")) & (c("recent_6m_count") > 0), "cooling")
        .when(c("trend_total") > 0, "active").otherwise("stale"),
    )


def published_and_preprint(published: DataFrame, preprint: DataFrame) -> DataFrame:
    """term, month with shares and momentum of both sides, and gap: how far the preprint share is ahead,
    times 1 + its momentum. A side without the term and month counts as 0."""
    sides = [s.select("term", "month", F.col("raw_share").alias(f"{k}_share"), F.col("momentum").alias(f"{k}_momentum")) for k, s in (("published", published), ("preprint", preprint))]
    values = ("published_share", "published_momentum", "preprint_share", "preprint_momentum")
    joined = sides[0].join(sides[1], ["term", "month"], "full").select("term", "month", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))
    return joined.withColumn("gap", F.greatest(F.col("preprint_share") - F.col("published_share"), F.lit(0.0)) * (1 + F.col("preprint_momentum")))


def side_rankings(published: DataFrame, preprint: DataFrame, top: int, concepts: DataFrame) -> DataFrame:
    """ranking, rank, term, score: the ``top`` terms of ``concepts`` (term: shown physics concepts that are no platform) by published heat, preprint rise, gap, and least published
    heat (two published papers, or one preprint, at least); of equal scores the first by name, of cooling ones the more frequent."""
    kept = lambda df: df.join(concepts.select("term").distinct(), "term", "left_semi")
    side = lambda df, k: kept(df).select("term", "month", F.col("raw_share").alias(f"{k}_share"), F.col("momentum").alias(f"{k}_m"), F.col("raw_freq").alias(f"{k}_n"))
    both = side(published, "pub").join(side(preprint, "pre"), ["term", "month"], "full").na.fill(0)
    gap = F.greatest(F.col("pre_share") - F.col("pub_share"), F.lit(0.0)) * (1 + F.col("pre_m"))
    sums = both.groupBy("term").agg(F.round(F.sum("pub_m"), 6).alias("heat"), F.round(F.sum("pre_m"), 6).alias("rise"), F.round(F.sum(gap), 6).alias("gap"), F.sum("pub_n").alias("pub_n"), F.sum("pre_n").alias("pre_n"))
    kinds = (
        ("published_heat", "heat", "pub_n >= 2", [F.desc("heat"), F.col("term")]), ("preprint_rising", "rise", "pre_n >= 1", [F.desc("rise"), F.col("term")]),
        ("validation_gap", "gap", "pre_n >= 1", [F.desc("gap"), F.col("term")]), ("cooling_published", "heat", "pub_n >= 2", [F.col("heat"), F.desc("pub_n"), F.col("term")]),
    )
    parts = []
    for name, score, rule, order in kinds:
        best = sums.filter(rule).orderBy(*order).limit(top)  # the few rows that remain are numbered
        parts.append(best.select(F.lit(name).alias("ranking"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", F.col(score).alias("score")))
    return reduce(DataFrame.unionByName, parts)


def cooccurrence(terms: DataFrame, min_count: int = 1) -> DataFrame:
    """a, b (a < b), papers: in how many papers both stand. ``terms`` holds distinct (paper_id, term); the
    pairs of one paper grow with the square of its terms, so papers are joined on their id and
    the pairs are counted before they are shuffled."""
    left, right = terms.select("paper_id", F.col("term").alias("a")), terms.select("paper_id", F.col("term").alias("b"))
    return left.join(right, "paper_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("papers")).filter(F.col("papers") >= min_count)


def network(terms: DataFrame, min_count: int, nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the most frequent terms and the links between them of ``min_count`` papers at least."""
    kept = terms.groupBy("term").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "term").limit(nodes)
    return kept, cooccurrence(terms.join(F.broadcast(kept.select("term")), "term"), min_count)


def ego(terms: DataFrame, root: str, n: int, min_weight: int = 1) -> DataFrame:
    """term, papers: the ``n`` terms that most often stand in papers of ``root``."""
    papers = terms.filter(F.col("term") == root).select("paper_id")
    near = terms.filter(F.col("term") != root).join(papers, "paper_id", "left_semi").groupBy("term").agg(F.count("*").alias("papers"))
    return near.filter(F.col("papers") >= min_weight).orderBy(F.desc("papers"), "term").limit(n)


def associated(roots: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """term, other, papers: for every root term its ``k`` most frequent partners."""
    pairs = roots.join(others.select("paper_id", F.col("term").alias("other")), "paper_id").filter("term <> other").groupBy("term", "other").agg(F.count("*").alias("papers"))
    return pairs.withColumn("r", F.expr("row_number() over (partition by term order by papers desc, other)")).filter(F.col("r") <= k).drop("r")


def period_chunks(spark, first: str, last: str, unit: str, names: DataFrame) -> DataFrame:
    """name, date_from, date_to: calendar periods clipped to the range, for every name."""
    step = {"year": "1 year", "quarter": "3 months", "month": "1 month"}[unit]
    days = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{first}', '{unit}'), date'{last}', interval {step})")).alias("d"))
    chunks = days.select(F.greatest("d", F.lit(first).cast("date")).alias("date_from"), F.least(F.expr(f"date_sub(d + interval {step}, 1)"), F.lit(last).cast("date")).alias("date_to"))
    return names.crossJoin(F.broadcast(chunks))
