"""Registered queries: aggregates, ranking and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.functions import parse
from casewise.operators import aggregate as agg
from casewise.operators import rank
from casewise.plans import lenses as lens
from casewise.plans.registry import query
from casewise.plans.shape import tidy
from casewise.session import work_path
from casewise.sources import tables as io

IN_SUBSET = "country_code IN (3, 7, 11)"
TOTAL_SQL = "sum(sms_in) + sum(sms_out) + sum(call_in) + sum(call_out) + sum(internet)"


def _subset(spark, folder):
    return lens.cdr(spark, folder).where(IN_SUBSET)


# ---------------------------------------------------------------- aggregates


@query("count_distinct_exact", "cdr", """
    SELECT count(*) AS rows, count(DISTINCT square_id) AS distinct_values,
           round(count(DISTINCT square_id) * 100 / count(*), 6) AS distinct_percent FROM cdr WHERE country_code IN (3, 7, 11)""")
def _(spark, folder):
    return tidy(agg.count_distinct_exact(_subset(spark, folder), "square_id"))


@query("group_count", "review", """
    SELECT reviewer, category, count(*) AS reviews FROM review GROUP BY reviewer, category""")
def _(spark, folder):
    return agg.group_count(lens.review(spark, folder), ["reviewer", "category"], name="reviews")


@query("group_count_non_null", "cdr", """
    SELECT country_code, count(call_out) AS calls FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY country_code""")
def _(spark, folder):
    return agg.group_count(_subset(spark, folder), ["country_code"], "call_out", "calls")


@query("group_sum_total", "cdr", f"""
    SELECT country_code, round({TOTAL_SQL}, 4) AS total_activity FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY country_code""")
def _(spark, folder):
    return tidy(agg.sum_total(_subset(spark, folder), lens.ACTIVITY, ["country_code"], "total_activity"), 4)


@query("global_sum_total", "cdr", f"""
    SELECT CAST(floor((sum(call_in) + sum(call_out)) * 1000) AS DOUBLE) / 1000 AS call_activity,
           CAST(floor((sum(sms_in) + sum(sms_out)) * 1000) AS DOUBLE) / 1000 AS sms_activity,
           CAST(floor(({TOTAL_SQL}) * 1000) AS DOUBLE) / 1000 AS total_activity
    FROM (SELECT country_code, square_id, {", ".join(f"CAST({m} AS DECIMAL(18, 4)) AS {m}" for m in lens.ACTIVITY)} FROM cdr)
    WHERE country_code = 7 AND square_id BETWEEN 101 AND 103""")
def _(spark, folder):
    path = io.write_partitioned(_subset(spark, folder), work_path(spark, "by-country"), ["country_code"])
    rows = spark.read.parquet(path).where((F.col("country_code") == 7) & F.col("square_id").isin(101, 102, 103))

    def total(measures):
        exact = [F.sum(F.col(m).cast("decimal(18,4)")) for m in measures]
        return parse.truncate_decimals(sum(exact[1:], exact[0]), 3)

    return rows.agg(
        total(["call_in", "call_out"]).alias("call_activity"),
        total(["sms_in", "sms_out"]).alias("sms_activity"),
        total(lens.ACTIVITY).alias("total_activity"),
    )


@query("group_mean", "loan", """
    SELECT purpose, round(avg(loan_amnt), 4) AS mean_loan_amnt, round(avg(annual_inc), 4) AS mean_annual_inc,
           round(avg(delinq), 4) AS mean_delinq FROM loan GROUP BY purpose""")
def _(spark, folder):
    return tidy(agg.group_mean(lens.loan(spark, folder), ["purpose"], ["loan_amnt", "annual_inc", "delinq"]), 4)


@query("mean_of_counts", "review", """
    SELECT category, count(*) AS keys, round(avg(c), 6) AS mean_rows
    FROM (SELECT category, reviewer, count(*) AS c FROM review GROUP BY ALL) GROUP BY category""")
def _(spark, folder):
    return tidy(agg.mean_of_counts(lens.review(spark, folder), "reviewer", ["category"]))


@query("frequency_of_counts", "rating", """
    SELECT rows, count(*) AS keys, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent
    FROM (SELECT item, count(*) AS rows FROM rating GROUP BY item) GROUP BY rows""")
def _(spark, folder):
    return tidy(agg.frequency_of_counts(lens.rating(spark, folder), "item"))


@query("class_share", "vec", """
    SELECT digit, count(*) AS rows, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM vec GROUP BY digit""")
def _(spark, folder):
    return tidy(agg.class_share(lens.vec(spark, folder), "digit"))


@query("group_sum_cv", "retail", """
    SELECT concat(market, '_', segment) AS market_segment, strftime(strptime(order_date, '%d-%m-%Y'), '%Y-%m') AS year_month,
           round(sum(sales), 4) AS sales, round(sum(profit), 4) AS profit, sum(quantity)::BIGINT AS quantity,
           round(stddev_samp(profit) * 100 / nullif(avg(profit), 0), 3) AS cv FROM retail GROUP BY 1, 2""")
def _(spark, folder):
    orders = lens.retail(spark, folder).select(
        parse.compose_key("market", "segment").alias("market_segment"),
        parse.format_year_month(parse.parse_date("order_date")).alias("year_month"),
        "sales", "profit", "quantity",
    )
    out = agg.group_sum_cv(orders, ["market_segment", "year_month"], ["sales", "profit", "quantity"], "profit")
    return tidy(out.withColumn("cv", F.round("cv", 3)), 4)


@query("mean_median", "loan", "SELECT round(avg(annual_inc), 4) AS mean, round(median(annual_inc), 4) AS median FROM loan")
def _(spark, folder):
    return tidy(agg.mean_median(lens.loan(spark, folder), "annual_inc"), 4)


LOAN_PAIRS = ["loan_amnt", "annual_inc", "installment", "delinq"]


def _pair_sql(kind, columns, places):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round({kind}({a}, {b}), {places}) AS value FROM loan"
        for a in columns for b in columns
    )


@query("corr_matrix", "loan", _pair_sql("corr", LOAN_PAIRS, 6))
def _(spark, folder):
    return tidy(agg.pair_matrix(lens.loan(spark, folder), LOAN_PAIRS, "corr"))


# Each vector as columns: its values, the values with gaps, and products of neighbours. SQL works out the pairs of four of them.
WIDE_WIDTH, WIDE_SHOWN = 64, ["p0", "p7", "g3", "q5"]
_WIDE_COLUMNS = [f"{kind}{i}" for kind in "pgq" for i in range(WIDE_WIDTH)]


def _wide_sql(name):
    i = int(name[1:])
    value = f"pixels[{i + 1}]"
    return {"p": value, "g": f"CASE WHEN (vec_id + {i}) % 7 <> 0 THEN {value} END", "q": f"{value} * pixels[{(i + 1) % WIDE_WIDTH + 1}]"}[name[0]]


@query("corr_matrix_wide", "vec", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({_wide_sql(a)}, {_wide_sql(b)}), 6) + 0.0 AS value FROM vec" for a in WIDE_SHOWN for b in _WIDE_COLUMNS))
def _(spark, folder):
    wide = lens.vec(spark, folder).selectExpr(*[
        f"{_wide_sql(c)} AS {c}".replace("pixels[", "element_at(pixels, ").replace("]", ")") for c in _WIDE_COLUMNS])
    return tidy(agg.pair_matrix(wide, _WIDE_COLUMNS).where(F.col("var1").isin(WIDE_SHOWN)))


@query("cov_matrix", "loan", _pair_sql("covar_samp", ["annual_inc", "installment", "delinq"], 3))
def _(spark, folder):
    return tidy(agg.pair_matrix(lens.loan(spark, folder), ["annual_inc", "installment", "delinq"], "cov"), 3)


BOX_SQL = """
    WITH tailed AS (SELECT purpose, installment * (loan_id % 97 + 1) AS amount FROM loan),
    side AS (SELECT purpose, list(amount ORDER BY amount) AS x, count(*) AS n FROM tailed GROUP BY purpose),
    depth AS (SELECT *, floor((n + 3) / 2) / 2 AS m FROM side),
    box AS (SELECT purpose, n, (x[CAST(floor(m) AS BIGINT)] + x[CAST(ceil(m) AS BIGINT)]) / 2 AS lower, list_median(x) AS median,
                   (x[CAST(n + 1 - ceil(m) AS BIGINT)] + x[CAST(n + 1 - floor(m) AS BIGINT)]) / 2 AS upper FROM depth),
    type7 AS (SELECT purpose, count(*) AS n, quantile_cont(amount, 0.25) AS lower, median(amount) AS median,
                     quantile_cont(amount, 0.75) AS upper FROM tailed GROUP BY purpose)
    SELECT purpose, any_value(n) AS n,
           round(min(amount) FILTER (amount BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower)), 3) AS low_whisker,
           round(any_value(lower), 3) AS lower, round(any_value(median), 3) AS median, round(any_value(upper), 3) AS upper,
           round(max(amount) FILTER (amount BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower)), 3) AS high_whisker,
           count(*) FILTER (amount NOT BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower)) AS outliers
    FROM tailed JOIN {box} USING (purpose) GROUP BY purpose"""


def _tailed(spark, folder):
    return lens.loan(spark, folder).select("purpose", (F.col("installment") * (F.col("loan_id") % 97 + 1)).alias("amount"))


@query("box_stats", "loan", BOX_SQL.replace("list_median(x)", "list_aggregate(x, 'median')").replace("{box}", "box"))
def _(spark, folder):
    return tidy(agg.box_stats(_tailed(spark, folder), "amount", ["purpose"]), 3)


@query("box_stats_quartile", "loan", BOX_SQL.replace("list_median(x)", "list_aggregate(x, 'median')").replace("{box}", "type7"))
def _(spark, folder):
    return tidy(agg.box_stats(_tailed(spark, folder), "amount", ["purpose"], "type7"), 3)


@query("histogram", "loan", """
    SELECT CAST(floor(loan_amnt / 1000) AS BIGINT) AS bin, count(*) AS rows, floor(loan_amnt / 1000) * 1000 AS bin_start
    FROM loan GROUP BY ALL""")
def _(spark, folder):
    return agg.histogram(lens.loan(spark, folder), "loan_amnt", 1000)


@query("crosstab", "loan", "SELECT loan_status, sub_grade, count(*) AS rows FROM loan GROUP BY ALL")
def _(spark, folder):
    return agg.crosstab(lens.loan(spark, folder), "loan_status", "sub_grade")


@query("fulfilment_rate", "trip ride", """
    SELECT coalesce(pickup, 'all') AS pickup, count(*) AS requests, sum(met)::BIGINT AS met, round(avg(met), 6) AS fulfilment_rate,
           round(avg(date_diff('microsecond', requested, dropped) / 6e7), 6) AS mean_minutes
    FROM ride GROUP BY GROUPING SETS ((pickup), ())""")
def _(spark, folder):
    rides = lens.ride(spark, folder)
    minutes = parse.duration("requested", "dropped")
    by_pickup = agg.fulfilment_rate(rides, "met", minutes, ["pickup"])
    overall = agg.fulfilment_rate(rides, "met", minutes).select(F.lit("all").alias("pickup"), "*")
    return tidy(by_pickup.unionByName(overall))


@query("category_ratio", "review", """
    WITH one AS (SELECT category, count(DISTINCT reviewer) AS metric FROM review GROUP BY category)
    SELECT a.category, b.category AS other, round(a.metric / b.metric, 6) AS ratio FROM one a JOIN one b ON a.category <> b.category""")
def _(spark, folder):
    pairs = lens.review(spark, folder).select("category", "reviewer").distinct()
    return tidy(agg.category_ratio(pairs, "category", F.count("reviewer")))


@query("trend_by_period", "review", """
    SELECT category, year(make_timestamp(review_time * 1000000)) AS year, count(*) AS rows FROM review GROUP BY ALL""")
def _(spark, folder):
    return tidy(agg.trend_by_period(lens.review(spark, folder), "review_time", ["category"]))


@query("trend_by_month", "review", """
    SELECT category, month(make_timestamp(review_time * 1000000)) AS month, count(*) AS rows FROM review
    WHERE year(make_timestamp(review_time * 1000000)) = 1998 GROUP BY ALL""")
def _(spark, folder):
    return tidy(agg.trend_by_period(lens.review(spark, folder), "review_time", ["category"], 1998))


@query("length_by_rating", "review_words", "SELECT overall, round(avg(words), 6) AS mean_words FROM review_words GROUP BY overall")
def _(spark, folder):
    return tidy(agg.group_mean(lens.review_words(spark, folder), ["overall"], ["words"]))


@query("helpfulness_summary", "review_words", """
    SELECT category, round(avg(helpful_percent), 6) AS mean_helpful, round(corr(words, helpful_percent), 6) AS corr_all,
           round(corr(words, helpful_percent) FILTER (words > 5 AND words < 1000), 6) AS corr_mid
    FROM review_words WHERE helpful_percent IS NOT NULL GROUP BY category""")
def _(spark, folder):
    rated = lens.review_words(spark, folder).where(F.col("helpful_percent").isNotNull())
    words = F.col("words").cast("double")
    middle = F.when((words > 5) & (words < 1000), words)
    return tidy(rated.groupBy("category").agg(
        F.avg("helpful_percent").alias("mean_helpful"),
        agg.correlation(words, "helpful_percent").alias("corr_all"),
        agg.correlation(middle, "helpful_percent").alias("corr_mid"),
    ))


@query("binned_mean", "review_words", """
    SELECT category, CAST(floor(words / 50) AS BIGINT) AS bin, round(avg(helpful_percent), 6) AS mean_helpful_percent
    FROM review_words WHERE helpful_percent IS NOT NULL GROUP BY ALL""")
def _(spark, folder):
    rated = lens.review_words(spark, folder).where(F.col("helpful_percent").isNotNull())
    binned = rated.withColumn("bin", parse.fixed_width_bin("words", 50))
    return tidy(agg.group_mean(binned, ["category", "bin"], ["helpful_percent"]))


TOP_SQL = """
    SELECT category, product, rows, place FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY rows DESC, product) AS place
        FROM (SELECT category, product, count(*) AS rows FROM review WHERE overall BETWEEN {a} AND {b} GROUP BY ALL)) WHERE place <= 3"""


@query("top_products", "review", TOP_SQL.format(a=0, b=5))
def _(spark, folder):
    return tidy(agg.top_products(lens.review(spark, folder), "product", "overall", 0, 5, 3, ["category"]))


@query("top_products_liked", "review", TOP_SQL.format(a=4, b=5))
def _(spark, folder):
    return tidy(agg.top_products(lens.review(spark, folder), "product", "overall", 4, 5, 3, ["category"]))


@query("top_products_disliked", "review", TOP_SQL.format(a=1, b=2))
def _(spark, folder):
    return tidy(agg.top_products(lens.review(spark, folder), "product", "overall", 1, 2, 3, ["category"]))


@query("satisfaction_ratio", "review", """
    SELECT category, count(*) FILTER (overall >= 4) AS good, count(*) FILTER (overall <= 2) AS bad,
           round(count(*) FILTER (overall >= 4) / count(*) FILTER (overall <= 2), 6) AS ratio FROM review GROUP BY category""")
def _(spark, folder):
    return tidy(agg.satisfaction_ratio(lens.review(spark, folder), "overall", ["category"]))


@query("satisfaction_ratio_products", "review", """
    SELECT category, count(DISTINCT product) FILTER (overall >= 4) AS good, count(DISTINCT product) FILTER (overall <= 2) AS bad,
           round(count(DISTINCT product) FILTER (overall >= 4) / count(DISTINCT product) FILTER (overall <= 2), 6) AS ratio
    FROM review GROUP BY category""")
def _(spark, folder):
    return tidy(agg.satisfaction_ratio(lens.review(spark, folder), "overall", ["category"], "products"))


@query("leave_days", "clock", """
    SELECT entity, (SELECT count(DISTINCT day) FROM clock) - count(*) AS leave_days FROM clock GROUP BY entity""")
def _(spark, folder):
    return agg.leave_days(lens.clock(spark, folder), "entity", "day")


@query("leave_days_monthly", "clock staff", """
    WITH cal AS (SELECT date_trunc('month', day)::DATE AS month, count(DISTINCT day) AS open FROM clock GROUP BY 1),
    came AS (SELECT entity, date_trunc('month', day)::DATE AS month, count(*) AS c FROM clock GROUP BY ALL)
    SELECT leaver, month, round(avg(open - coalesce(c, 0)), 6) AS mean_leave_days
    FROM staff CROSS JOIN cal LEFT JOIN came USING (entity, month) GROUP BY leaver, month""")
def _(spark, folder):
    monthly = agg.leave_days(lens.clock(spark, folder), "entity", "day", by_month=True)
    classed = monthly.join(lens.staff(spark, folder), "entity")
    return tidy(agg.group_mean(classed, ["leaver", "month"], ["leave_days"]))


@query("work_hours", "clock", """
    SELECT entity, round(avg(date_diff('microsecond', in_at, out_at) / 36e8), 6) AS mean_hours FROM clock GROUP BY entity""")
def _(spark, folder):
    return tidy(agg.work_hours(lens.clock(spark, folder), "entity", "in_at", "out_at"))


@query("rank_segments", "retail", """
    SELECT concat(market, '_', segment) AS market_segment, round(sum(profit), 4) AS profit,
           round(stddev_samp(profit) * 100 / avg(profit), 3) AS cv FROM retail GROUP BY 1 ORDER BY sum(profit) DESC LIMIT 2""")
def _(spark, folder):
    orders = lens.retail(spark, folder).withColumn("market_segment", parse.compose_key("market", "segment"))
    summary = agg.group_sum_cv(orders, ["market_segment"], ["profit"], "profit")
    best = agg.rank_segments(summary, "market_segment")
    return tidy(best.withColumn("cv", F.round("cv", 3)), 4)


# ---------------------------------------------------------------- sort, top-k, windows


@query("sort_rows", "review_words", """
    SELECT overall, category, round(avg(words), 6) AS mean_words FROM review_words GROUP BY ALL ORDER BY 3 DESC""")
def _(spark, folder):
    means = agg.group_mean(lens.review_words(spark, folder), ["overall", "category"], ["words"])
    return tidy(rank.sort_rows(means, [F.col("mean_words").desc(), "overall", "category"]))


def _activity(spark, folder):
    return agg.sum_total(_subset(spark, folder), lens.ACTIVITY, ["country_code"], "total_activity")


@query("arg_min_max", "cdr", """
    WITH grids AS (SELECT square_id, sum(sms_in) + sum(sms_out) AS total FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY square_id)
    (SELECT 'max_sms_grid' AS what, square_id AS key, round(total, 4) AS total FROM grids WHERE total IS NOT NULL ORDER BY total DESC, square_id LIMIT 1)
    UNION ALL (SELECT 'min_internet_country', country_code, round(sum(internet), 4) FROM cdr WHERE country_code IN (3, 7, 11)
     GROUP BY country_code ORDER BY sum(internet), country_code LIMIT 1)""")
def _(spark, folder):
    subset = _subset(spark, folder)
    grids = agg.sum_total(subset, ["sms_in", "sms_out"], ["square_id"], "total")
    # Rounding first keeps equal sums equal whatever the summation order was.
    grids = grids.withColumn("total", F.round("total", 4))
    countries = agg.sum_total(subset, ["internet"], ["country_code"], "total")
    top = rank.arg_extreme(grids, "square_id", "total").select(F.lit("max_sms_grid").alias("what"), F.col("square_id").alias("key"), "total")
    low = rank.arg_extreme(countries, "country_code", "total", largest=False).select(
        F.lit("min_internet_country").alias("what"), F.col("country_code").alias("key"), "total")
    return tidy(top.unionByName(low), 4)


@query("top_n", "review", "SELECT product, count(*) AS rows FROM review GROUP BY product ORDER BY rows DESC, product LIMIT 6")
def _(spark, folder):
    return rank.top_n(agg.group_count(lens.review(spark, folder), ["product"]), "product", "rows", 6)


@query("top_n_with_ties", "rating", """
    SELECT item, rows FROM (SELECT item, count(*) AS rows FROM rating GROUP BY item) QUALIFY rank() OVER (ORDER BY rows DESC) = 1""")
def _(spark, folder):
    return rank.top_n_with_ties(agg.group_count(lens.rating(spark, folder), ["item"]), "rows")


@query("nth_ranked", "cdr", f"""
    SELECT country_code, round(total_activity, 4) AS total_activity FROM (
        SELECT country_code, {TOTAL_SQL} AS total_activity FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY country_code)
    QUALIFY dense_rank() OVER (ORDER BY total_activity DESC) = 2""")
def _(spark, folder):
    return rank.nth_ranked(tidy(_activity(spark, folder), 4), "total_activity", 2)


@query("cumulative_share", "vec", """
    SELECT digit, rows, sum(rows) OVER (ORDER BY rows DESC, digit ROWS UNBOUNDED PRECEDING)::BIGINT AS running,
           round(sum(rows) OVER (ORDER BY rows DESC, digit ROWS UNBOUNDED PRECEDING) / sum(rows) OVER (), 6) AS share
    FROM (SELECT digit, count(*) AS rows FROM vec GROUP BY digit)""")
def _(spark, folder):
    counts = agg.group_count(lens.vec(spark, folder), ["digit"])
    return tidy(rank.cumulative_share(counts, [F.col("rows").desc(), F.col("digit")], "rows"))


@query("bucket_ntile", "score", "SELECT key, ntile(10) OVER (ORDER BY score DESC, key) AS bucket FROM score")
def _(spark, folder):
    scored = lens.score(spark, folder).select("key", "score")
    return rank.bucket_ntile(scored, [F.col("score").desc(), F.col("key")], 10).drop("score")


SERIES = "retail monthly series"


def _smooth_sql(width):
    after = width // 2
    before = width - 1 - after
    frame = f"(PARTITION BY series ORDER BY t ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count(*) OVER {frame} = {width} THEN avg(value) OVER {frame} END"


@query("moving_average", SERIES, f"""
    SELECT series, t, round({_smooth_sql(4)}, 5) AS w4, round({_smooth_sql(5)}, 5) AS w5, round({_smooth_sql(3)}, 5) AS w3 FROM series""")
def _(spark, folder):
    points = lens.series(spark, folder)
    for width in (4, 5, 3):
        points = rank.moving_average(points, "series", "t", "value", width, f"w{width}")
    return tidy(points.select("series", "t", "w4", "w5", "w3"), 5)


@query("edge_extrapolation", SERIES, f"""
    WITH smooth AS (SELECT series, t, {_smooth_sql(4)} AS s, count(*) OVER (PARTITION BY series) AS n FROM series),
    anchor AS (SELECT *, max(s) FILTER (t = 5) OVER w AS l0, max(s) FILTER (t = 6) OVER w AS l1,
                      max(s) FILTER (t = n - 4) OVER w AS r0, max(s) FILTER (t = n - 5) OVER w AS r1 FROM smooth WINDOW w AS (PARTITION BY series))
    SELECT series, t, round(CASE WHEN t <= 4 THEN l0 - (5 - t) * (l1 - l0) WHEN t > n - 4 THEN r0 + (t - n + 4) * (r0 - r1) ELSE s END, 5) AS smoothed
    FROM anchor""")
def _(spark, folder):
    points = rank.moving_average(lens.series(spark, folder), "series", "t", "value", 4)
    return tidy(rank.edge_extrapolation(points.select("series", "t", "smoothed"), "series", "t", "smoothed", 4), 5)
