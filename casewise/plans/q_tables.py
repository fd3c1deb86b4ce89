"""Registered queries: profiling, cleaning, scalar expressions, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.functions import parse
from casewise.operators import aggregate as agg
from casewise.operators import clean, profile, relate
from casewise.plans import lenses as lens
from casewise.plans.registry import query
from casewise.plans.shape import tidy
from casewise.sources import tables as io
from casewise.session import work_path

# Misspelt makers in the car lens and their right form.
MAKERS = {
    "xblue": "blue", "xcold": "cold", "xhot": "hot", "xlarge": "large",
    "xnew": "new", "xold": "old", "xred": "red", "xsmall": "small",
}
BODY_LEVELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

# ---------------------------------------------------------------- profiling

LOAN_NUMBERS = ["loan_amnt", "annual_inc", "installment", "delinq"]


def _profile_sql(column):
    return (
        f"SELECT '{column}' AS column, count({column}) AS n, count(*) - count({column}) AS nulls, "
        f"round(min({column}), 4) AS min, round(quantile_cont({column}, 0.25), 4) AS q1, "
        f"round(median({column}), 4) AS median, round(avg({column}), 4) AS mean, "
        f"round(quantile_cont({column}, 0.75), 4) AS q3, round(max({column}), 4) AS max FROM loan"
    )


@query("profile_numeric", "loan", " UNION ALL ".join(_profile_sql(c).replace("AS column", 'AS "column"') for c in LOAN_NUMBERS))
def _(spark, folder):
    return tidy(profile.profile_numeric(lens.loan(spark, folder), LOAN_NUMBERS), 4)


LOAN_TYPES = [
    ("loan_id", "bigint"), ("loan_amnt", "double"), ("annual_inc", "double"), ("installment", "double"),
    ("purpose", "string"), ("loan_status", "string"), ("int_rate", "string"), ("emp_length", "string"),
    ("issue_d", "string"), ("sub_grade", "string"), ("term", "string"), ("delinq", "int"),
    ("next_d", "string"), ("policy_code", "int"),
]


@query("profile_schema", "loan", " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{t}' AS type, count(*) AS rows FROM loan"""
    for i, (c, t) in enumerate(LOAN_TYPES, 1)))
def _(spark, folder):
    return tidy(profile.profile_schema(lens.loan(spark, folder)))


@query("head_rows", "loan", "SELECT loan_id, loan_amnt, purpose FROM loan ORDER BY loan_id LIMIT 6")
def _(spark, folder):
    return profile.head_rows(lens.loan(spark, folder).select("loan_id", "loan_amnt", "purpose"), ["loan_id"])


CDR_COLUMNS = ["square_id", "time_interval", "country_code", *lens.ACTIVITY]


@query("missing_by_column", "cdr", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls,
        round((count(*) - count({c})) * 100 / count(*), 6) AS null_percent FROM cdr""" for c in CDR_COLUMNS))
def _(spark, folder):
    return tidy(profile.missing_by_column(lens.cdr(spark, folder)))


@query("duplicate_rows", "rating", """
    SELECT user, item, count(*) AS copies FROM rating GROUP BY user, item HAVING count(*) > 1""")
def _(spark, folder):
    return profile.duplicate_rows(lens.rating(spark, folder), ["user", "item"])


@query("key_is_unique", "clock", """
    SELECT 'entity' AS "key", count(*) AS rows, count(DISTINCT entity) AS distinct_keys,
           count(*) = count(DISTINCT entity) AS is_unique FROM clock
    UNION ALL SELECT 'entity_day', count(*), count(DISTINCT concat(entity, '/', day)),
           count(*) = count(DISTINCT concat(entity, '/', day)) FROM clock""")
def _(spark, folder):
    times = lens.clock(spark, folder).withColumn("entity_day", F.concat_ws("/", "entity", "day"))
    parts = [profile.key_is_unique(times, k).select(F.lit(k).alias("key"), "*") for k in ("entity", "entity_day")]
    return parts[0].unionAll(parts[1])


@query("key_set_difference", "clock", """
    SELECT DISTINCT entity, day FROM clock WHERE day < DATE '2024-02-01'
    EXCEPT SELECT entity, CAST(day - INTERVAL 31 DAY AS DATE) FROM clock WHERE day >= DATE '2024-02-01'""")
def _(spark, folder):
    times = lens.clock(spark, folder)
    first = times.where("day < DATE '2024-02-01'").select(F.struct("entity", "day").alias("k"))
    second = times.where("day >= DATE '2024-02-01'").select(F.struct("entity", F.date_sub("day", 31).alias("day")).alias("k"))
    return profile.key_set_difference(first, second, "k").select("k.*")


@query("distinct_values", "car", """
    SELECT 'brand' AS "column", brand AS level, count(*) AS rows FROM car GROUP BY brand
    UNION ALL SELECT 'body', body, count(*) FROM car GROUP BY body
    UNION ALL SELECT 'fuel', fuel, count(*) FROM car GROUP BY fuel""")
def _(spark, folder):
    return profile.distinct_values(lens.car(spark, folder), ["brand", "body", "fuel"])


# ---------------------------------------------------------------- cleaning


@query("project_drop", "loan", "SELECT loan_id, loan_amnt, purpose, loan_status, term FROM loan")
def _(spark, folder):
    return lens.loan(spark, folder).drop(
        "annual_inc", "installment", "int_rate", "emp_length", "issue_d", "sub_grade", "delinq", "next_d", "policy_code"
    )


@query("rename_columns", "loan", "SELECT loan_id AS id, loan_amnt AS amount, purpose AS reason FROM loan")
def _(spark, folder):
    return lens.loan(spark, folder).select("loan_id", "loan_amnt", "purpose").withColumnsRenamed(
        {"loan_id": "id", "loan_amnt": "amount", "purpose": "reason"}
    )


@query("filter_compare", "loan", """
    SELECT loan_id, annual_inc, purpose FROM loan
    WHERE annual_inc < 5000 AND loan_amnt >= 1000 AND purpose <> '5-LOW' AND loan_status = 'F' AND delinq > 3""")
def _(spark, folder):
    return (
        lens.loan(spark, folder)
        .where((F.col("annual_inc") < 5000) & (F.col("loan_amnt") >= 1000) & (F.col("purpose") != "5-LOW"))
        .where((F.col("loan_status") == "F") & (F.col("delinq") > 3))
        .select("loan_id", "annual_inc", "purpose")
    )


@query("filter_in_list", "cdr", """
    SELECT country_code, count(*) AS rows FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY country_code""")
def _(spark, folder):
    return agg.group_count(lens.cdr(spark, folder).where(F.col("country_code").isin(lens.COUNTRIES)), ["country_code"])


@query("filter_boolean", "review", """
    SELECT review_id, overall FROM review
    WHERE (helpful[2] >= 10 AND helpful[2] <> 0 AND overall BETWEEN 2 AND 4) OR (category = 'F' AND product < 20)""")
def _(spark, folder):
    total = F.get("helpful", 1)
    voted = (total >= 10) & (total != 0) & F.col("overall").between(2, 4)
    early = (F.col("category") == "F") & (F.col("product") < 20)
    return lens.review(spark, folder).where(voted | early).select("review_id", "overall")


@query("drop_blank_rows", "rating", """
    SELECT user_name, count(*) AS rows FROM rating WHERE user_name IS NOT NULL AND trim(user_name) <> '' GROUP BY user_name""")
def _(spark, folder):
    return agg.group_count(clean.drop_blank_rows(lens.rating(spark, folder), ["user_name"]), ["user_name"])


@query("drop_all_null_columns", "loan", "SELECT * EXCLUDE (next_d) REPLACE (round(installment, 4) AS installment, delinq::BIGINT AS delinq, policy_code::BIGINT AS policy_code) FROM loan")
def _(spark, folder):
    return tidy(clean.drop_all_null_columns(lens.loan(spark, folder)), 4)


@query("drop_constant_columns", "loan", "SELECT * EXCLUDE (policy_code) REPLACE (round(installment, 4) AS installment, delinq::BIGINT AS delinq) FROM loan")
def _(spark, folder):
    return tidy(clean.drop_constant_columns(lens.loan(spark, folder)), 4)


@query("fill_missing", "cdr", """
    SELECT square_id, sum(coalesce(sms_in, 0)) AS sms_in, round(sum(coalesce(call_out, 0)), 4) AS call_out
    FROM cdr GROUP BY square_id""")
def _(spark, folder):
    filled = clean.fill_missing(lens.cdr(spark, folder), {"sms_in": 0.0, "call_out": 0.0})
    return tidy(filled.groupBy("square_id").agg(F.sum("sms_in").alias("sms_in"), F.sum("call_out").alias("call_out")), 4)


@query("dedup_keep_first", "rating_once", "SELECT * FROM rating_once")
def _(spark, folder):
    return lens.rating_once(spark, folder)


@query("derive_flag", "trip", """
    SELECT request_id, CASE WHEN status = 'completed' THEN 1 ELSE 0 END::BIGINT AS met,
           CASE WHEN drop_text IS NULL THEN NULL WHEN length(drop_text) = 16 THEN 1 ELSE 0 END::BIGINT AS short_form
    FROM trip""")
def _(spark, folder):
    return tidy(lens.trip(spark, folder).select(
        "request_id",
        parse.derive_flag(F.col("status") == "completed").alias("met"),
        parse.derive_flag(F.length("drop_text") == 16).alias("short_form"),
    ))


@query("recode_values", "car", """
    SELECT car_id, CASE WHEN regexp_extract(car_name, '([A-Za-z]+)', 1) LIKE 'x%'
        THEN substr(regexp_extract(car_name, '([A-Za-z]+)', 1), 2) ELSE regexp_extract(car_name, '([A-Za-z]+)', 1) END AS maker
    FROM car""")
def _(spark, folder):
    cars = lens.car(spark, folder).select("car_id", parse.leading_token("car_name").alias("maker"))
    return cars.withColumn("maker", clean.recode_values("maker", MAKERS))


HINGE_SQL = """
    WITH side AS (SELECT list(installment * (loan_id % 97 + 1) ORDER BY installment * (loan_id % 97 + 1)) AS x, count(*) AS n FROM loan),
    depth AS (SELECT x, n, floor((n + 3) / 2) / 2 AS m FROM side),
    box AS (SELECT (x[CAST(floor(m) AS BIGINT)] + x[CAST(ceil(m) AS BIGINT)]) / 2 AS lo,
                   (x[CAST(n + 1 - ceil(m) AS BIGINT)] + x[CAST(n + 1 - floor(m) AS BIGINT)]) / 2 AS hi FROM depth),
    flagged AS (SELECT loan_id, installment * (loan_id % 97 + 1) AS amount, lo - 1.5 * (hi - lo) AS a, hi + 1.5 * (hi - lo) AS b FROM loan, box)
"""


def _skewed_loans(spark, folder):
    """Loans with a long-tailed amount, so the box rule finds outliers."""
    return lens.loan(spark, folder).select("loan_id", (F.col("installment") * (F.col("loan_id") % 97 + 1)).alias("amount"))


@query("outlier_to_null", "loan", HINGE_SQL + "SELECT loan_id, CASE WHEN amount BETWEEN a AND b THEN amount END AS amount FROM flagged")
def _(spark, folder):
    return clean.outlier_to_null(_skewed_loans(spark, folder), "amount")


@query("outlier_report", "loan", HINGE_SQL + """
    SELECT count(*) FILTER (amount NOT BETWEEN a AND b) AS outliers,
           round(count(*) FILTER (amount NOT BETWEEN a AND b) * 100 / count(*), 6) AS outlier_percent,
           round(avg(amount) FILTER (amount NOT BETWEEN a AND b), 3) AS mean_outliers,
           round(avg(amount), 3) AS mean_before, round(avg(amount) FILTER (amount BETWEEN a AND b), 3) AS mean_after
    FROM flagged""")
def _(spark, folder):
    report = clean.outlier_report(_skewed_loans(spark, folder), "amount")
    return tidy(report.withColumn("outlier_percent", F.round("outlier_percent", 6)), 6).withColumns(
        {c: F.round(c, 3) for c in ("mean_outliers", "mean_before", "mean_after")}
    )


@query("select_numeric", "loan", """
    SELECT loan_id, loan_amnt, annual_inc, round(installment, 4) AS installment, delinq::BIGINT AS delinq,
           policy_code::BIGINT AS policy_code FROM loan""")
def _(spark, folder):
    loans = lens.loan(spark, folder)
    return tidy(loans.select(*clean.select_numeric(loans)), 4)


@query("row_slice", "rating", """
    SELECT item, rows FROM (SELECT item, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, item) AS k
    FROM rating GROUP BY item) WHERE k > 10 AND (k - 11) % 5 = 0""")
def _(spark, folder):
    counts = agg.group_count(lens.rating(spark, folder), ["item"])
    return clean.row_slice(counts, [F.col("rows").desc(), F.col("item")], skip=10, every=5)


@query("cast_columns", "loan", """
    SELECT loan_id, CAST(loan_amnt AS VARCHAR) AS loan_amnt, TRY_CAST(emp_length AS BIGINT) AS emp_length,
           CAST(delinq AS DOUBLE) AS delinq, TRY_CAST(substr(term, 1, 2) AS BIGINT) AS term FROM loan""")
def _(spark, folder):
    loans = lens.loan(spark, folder).select("loan_id", "loan_amnt", "emp_length", "delinq", F.substring("term", 1, 2).alias("term"))
    types = {"loan_amnt": "string", "emp_length": "bigint", "delinq": "double", "term": "bigint"}
    return clean.cast_columns(loans, types)


@query("cast_losses", "loan", """
    SELECT 'emp_length' AS "column", count(*) FILTER (emp_length IS NOT NULL AND TRY_CAST(emp_length AS BIGINT) IS NULL) AS lost FROM loan
    UNION ALL SELECT 'delinq', 0 UNION ALL SELECT 'int_rate', count(*) FROM loan""")
def _(spark, folder):
    loans = lens.loan(spark, folder)
    return clean.cast_losses(loans, {"emp_length": "bigint", "delinq": "double", "int_rate": "double"})


# ---------------------------------------------------------------- scalar expressions


@query("parse_percent", "loan", "SELECT loan_id, round(CAST(replace(int_rate, '%', '') AS DOUBLE), 4) AS int_rate FROM loan")
def _(spark, folder):
    return tidy(lens.loan(spark, folder).select("loan_id", parse.parse_percent("int_rate").alias("int_rate")), 4)


@query("parse_tenure", "loan", """
    SELECT loan_id, CASE WHEN emp_length LIKE '%< 1%' THEN 0
        ELSE TRY_CAST(nullif(regexp_extract(emp_length, '(\\d{1,2})', 1), '') AS BIGINT) END AS years FROM loan""")
def _(spark, folder):
    return tidy(lens.loan(spark, folder).select("loan_id", parse.parse_tenure("emp_length").alias("years")))


@query("parse_month_year", "loan", """
    SELECT loan_id, make_date(CASE WHEN yy <= 68 THEN 2000 ELSE 1900 END + yy, month(strptime(issue_d, '%b-%y')), 1) AS issued
    FROM (SELECT loan_id, issue_d, CAST(split_part(issue_d, '-', 2) AS BIGINT) AS yy FROM loan)""")
def _(spark, folder):
    return lens.loan(spark, folder).select("loan_id", parse.parse_month_year("issue_d").alias("issued"))


@query("parse_mixed_timestamp", "trip ride", "SELECT request_id, requested, dropped FROM ride")
def _(spark, folder):
    return lens.trip(spark, folder).select(
        "request_id",
        parse.parse_mixed_timestamp("request_text").cast("timestamp_ntz").alias("requested"),
        parse.parse_mixed_timestamp("drop_text").cast("timestamp_ntz").alias("dropped"),
    )


@query("parse_date", "retail", """
    SELECT CAST(strptime(order_date, '%d-%m-%Y') AS DATE) AS day, count(*) AS rows FROM retail GROUP BY 1""")
def _(spark, folder):
    return agg.group_count(lens.retail(spark, folder).select(parse.parse_date("order_date").alias("day")), ["day"])


@query("epoch_parts", "review", """
    SELECT review_id, year(make_timestamp(review_time * 1000000)) AS year, month(make_timestamp(review_time * 1000000)) AS month FROM review""")
def _(spark, folder):
    return tidy(lens.review(spark, folder).select(
        "review_id", parse.epoch_year("review_time").alias("year"), parse.epoch_month("review_time").alias("month")
    ))


@query("duration", "trip ride", """
    SELECT request_id, round(date_diff('microsecond', requested, dropped) / 6e7, 6) AS minutes,
           round(date_diff('microsecond', requested, dropped) / 36e8, 6) AS hours,
           date_diff('day', CAST(requested AS DATE), CAST(dropped AS DATE)) AS days FROM ride""")
def _(spark, folder):
    return tidy(lens.ride(spark, folder).select(
        "request_id",
        parse.duration("requested", "dropped").alias("minutes"),
        parse.duration("requested", "dropped", "hours").alias("hours"),
        F.date_diff("dropped", "requested").alias("days"),
    ))


@query("compose_key", "retail", "SELECT concat(market, '_', segment) AS market_segment, count(*) AS rows FROM retail GROUP BY 1")
def _(spark, folder):
    keyed = lens.retail(spark, folder).select(parse.compose_key("market", "segment").alias("market_segment"))
    return agg.group_count(keyed, ["market_segment"])


@query("format_year_month", "retail", """
    SELECT strftime(strptime(order_date, '%d-%m-%Y'), '%Y-%m') AS year_month, count(*) AS rows FROM retail GROUP BY 1""")
def _(spark, folder):
    months = lens.retail(spark, folder).select(parse.format_year_month(parse.parse_date("order_date")).alias("year_month"))
    return agg.group_count(months, ["year_month"])


@query("leading_token", "car", "SELECT car_id, regexp_extract(car_name, '([A-Za-z]+)', 1) AS maker FROM car")
def _(spark, folder):
    return lens.car(spark, folder).select("car_id", parse.leading_token("car_name").alias("maker"))


@query("word_count", "review", "SELECT review_id, len(string_split(review_text, ' ')) AS words FROM review")
def _(spark, folder):
    return lens.review_words(spark, folder).select("review_id", "words")


@query("helpful_percent", "review", """
    SELECT review_id, round(CASE WHEN helpful[2] >= 10 THEN helpful[1] / helpful[2] * 100 END, 6) AS helpful_percent FROM review""")
def _(spark, folder):
    return tidy(lens.review(spark, folder).select("review_id", parse.helpful_percent("helpful").alias("helpful_percent")))


@query("fixed_width_bin", "review_words", "SELECT review_id, CAST(floor(words / 50) AS BIGINT) AS bin FROM review_words")
def _(spark, folder):
    return lens.review_words(spark, folder).select("review_id", parse.fixed_width_bin("words", 50).alias("bin"))


@query("truncate_decimals", "cdr", """
    SELECT square_id, CAST(floor(sum(CAST(internet AS DECIMAL(18, 4))) * 10) AS DOUBLE) / 10 AS internet FROM cdr GROUP BY square_id""")
def _(spark, folder):
    sums = lens.cdr(spark, folder).groupBy("square_id").agg(F.sum(F.col("internet").cast("decimal(18,4)")).alias("internet"))
    return sums.select("square_id", parse.truncate_decimals("internet", 1).alias("internet"))


@query("round_decimals", "loan", """
    SELECT loan_id, round(CAST(CAST(installment AS VARCHAR) AS DECIMAL(38, 18)), 2)::DOUBLE AS installment,
           round(CAST(annual_inc AS DECIMAL(18, 2)), 0)::DOUBLE AS annual_inc FROM loan""")
def _(spark, folder):
    return lens.loan(spark, folder).select(
        "loan_id", parse.round_decimals("installment", 2).alias("installment"),
        (parse.round_decimals("annual_inc", 0) + 0.0).alias("annual_inc"),
    )


@query("ordinal_rank", "loan", """
    SELECT loan_id, sub_grade, round(1 + 0.2::DOUBLE * (place - 1), 6) AS rank FROM loan
    JOIN (SELECT sub_grade, row_number() OVER (ORDER BY sub_grade) AS place FROM (SELECT DISTINCT sub_grade FROM loan)) USING (sub_grade)""")
def _(spark, folder):
    return tidy(clean.ordinal_rank(lens.loan(spark, folder).select("loan_id", "sub_grade"), "sub_grade", "rank"))


@query("row_mean", "vec", "SELECT vec_id, round(list_avg(pixels), 6) AS intensity FROM vec")
def _(spark, folder):
    return tidy(lens.vec(spark, folder).select("vec_id", parse.row_mean("pixels").alias("intensity")))


@query("row_null_count", "cdr", """
    SELECT square_id, sum((sms_in IS NULL)::BIGINT + (call_out IS NULL)::BIGINT + (internet IS NULL)::BIGINT)::BIGINT AS nulls
    FROM cdr GROUP BY square_id""")
def _(spark, folder):
    flagged = lens.cdr(spark, folder).withColumn("nulls", parse.row_null_count(["sms_in", "call_out", "internet"]))
    return flagged.groupBy("square_id").agg(F.sum("nulls").alias("nulls"))


@query("scale_constant", "vec", """
    SELECT vec_id, round(list_sum(list_transform(pixels, lambda x: x / 255)) * 1000, 5) AS scaled_sum,
           round(pixels[64] / 255 * 1000, 6) AS last_pixel FROM vec""")
def _(spark, folder):
    scaled = lens.vec(spark, folder).select("vec_id", parse.scale_constant("pixels", 255).alias("p"))
    return scaled.select(
        "vec_id",
        (F.round(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x) * 1000, 5) + 0.0).alias("scaled_sum"),
        (F.round(F.get("p", 63) * 1000, 6) + 0.0).alias("last_pixel"),
    )


@query("z_score", "loan", """
    SELECT loan_id, round((loan_amnt - avg(loan_amnt) OVER ()) / stddev_samp(loan_amnt) OVER (), 6) AS loan_amnt,
           round((delinq - avg(delinq) OVER ()) / stddev_samp(delinq) OVER (), 6) AS delinq FROM loan""")
def _(spark, folder):
    loans = lens.loan(spark, folder).select("loan_id", "loan_amnt", "delinq")
    return tidy(clean.z_score(loans, ["loan_amnt", "delinq"]))


@query("column_ratio", "loan", """
    SELECT loan_id, round(installment / nullif(annual_inc, 0), 6) AS ratio, round(loan_amnt / nullif(delinq, 0), 6) AS per_delinq FROM loan""")
def _(spark, folder):
    return tidy(lens.loan(spark, folder).select(
        "loan_id", parse.column_ratio("installment", "annual_inc").alias("ratio"),
        parse.column_ratio("loan_amnt", "delinq").alias("per_delinq"),
    ))


@query("binary_encode", "car", "SELECT car_id, CASE WHEN fuel = 'diesel' THEN 1 ELSE 0 END::BIGINT AS fuel FROM car")
def _(spark, folder):
    return tidy(clean.binary_encode(lens.car(spark, folder).select("car_id", "fuel"), "fuel"))


@query("one_hot_drop_first", "car", "SELECT car_id, " + ", ".join(
    f"""(body = '{b}')::BIGINT AS "body_{b}" """ for b in BODY_LEVELS[1:]) + " FROM car")
def _(spark, folder):
    return tidy(clean.one_hot_drop_first(lens.car(spark, folder).select("car_id", "body"), "body"))


@query("level_index", "review", """
    SELECT product, product_index, count(*) AS rows FROM (SELECT product, dense_rank() OVER (ORDER BY product) - 1 AS product_index FROM review) GROUP BY ALL""")
def _(spark, folder):
    """Levels by the thousand: an index column instead of a column for each."""
    indexed = clean.level_index(lens.review(spark, folder).select("product"), "product")
    return tidy(indexed.groupBy("product", "product_index").agg(F.count(F.lit(1)).alias("rows")))


@query("pivot_long", "review", """
    SELECT overall, product, value, dense_rank() OVER (ORDER BY product) - 1 AS index
    FROM (SELECT overall, product, count(*) AS value FROM review WHERE product IS NOT NULL GROUP BY ALL)""")
def _(spark, folder):
    return tidy(relate.pivot_long(lens.review(spark, folder), ["overall"], "product", F.count(F.lit(1))))


# ---------------------------------------------------------------- joins and reshaping


def _day_columns(spark, folder):
    """One column per calendar day, named by its date."""
    times = lens.clock(spark, folder).withColumn("day", F.col("day").cast("string"))
    days = clean.levels(times, "day")
    return relate.pivot_groups(times, ["entity"], "day", days, F.first("in_at"))


@query("join_collate", "clock staff", """
    SELECT s.entity, leaver, n_days, round(mean_hours, 6) AS mean_hours FROM staff s
    JOIN (SELECT entity, count(*) AS n_days FROM clock GROUP BY entity) USING (entity)
    JOIN (SELECT entity, avg(date_diff('microsecond', in_at, out_at) / 36e8) AS mean_hours FROM clock GROUP BY entity) USING (entity)""")
def _(spark, folder):
    times = lens.clock(spark, folder)
    tables = [lens.staff(spark, folder), agg.group_count(times, ["entity"], name="n_days"), agg.work_hours(times, "entity", "in_at", "out_at")]
    return tidy(relate.join_collate(tables, "entity"))


@query("join_activity_threshold", "rating_once", """
    SELECT user, item, rating, item_rows, user_rows FROM rating_once
    JOIN (SELECT item, count(*) AS item_rows FROM rating_once GROUP BY item) USING (item)
    JOIN (SELECT user, count(*) AS user_rows FROM rating_once GROUP BY user) USING (user)
    WHERE item_rows >= 30 AND user_rows >= 40""")
def _(spark, folder):
    return relate.join_activity_threshold(lens.rating_once(spark, folder), "user", "item", lens.MIN_PER_USER, lens.MIN_PER_ITEM)


@query("attach_by_key", "clock staff", "SELECT c.entity, c.day, s.leaver FROM clock c LEFT JOIN staff s USING (entity)")
def _(spark, folder):
    return relate.attach_by_key(lens.clock(spark, folder).select("entity", "day"), lens.staff(spark, folder), "entity", ["leaver"])


@query("unpivot_wide", "clock", """
    SELECT e.entity, strftime(d.day, '%Y-%m-%d') AS day, c.in_at FROM (SELECT DISTINCT entity FROM clock) e
    CROSS JOIN (SELECT DISTINCT day FROM clock) d LEFT JOIN clock c ON c.entity = e.entity AND c.day = d.day""")
def _(spark, folder):
    long = relate.unpivot_wide(_day_columns(spark, folder), ["entity"], "day", "in_at")
    return long.withColumn("in_at", F.col("in_at").cast("timestamp_ntz"))


LOAN_PAIRS = ["loan_amnt", "annual_inc", "installment", "delinq"]


def _pair_sql(kind, view, columns, places):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round({kind}({a}, {b}), {places}) AS value FROM {view}" for a in columns for b in columns
    )


@query("melt_matrix", "car", _pair_sql("corr", "car", ["size", "wheel", "width", "price"], 6))
def _(spark, folder):
    return tidy(agg.pair_matrix(lens.car(spark, folder), ["size", "wheel", "width", "price"]))


@query("pivot_groups", "clock staff", """
    SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) FILTER (leaver = 'No') AS "No", count(*) FILTER (leaver = 'Yes') AS "Yes"
    FROM clock JOIN staff USING (entity) GROUP BY 1""")
def _(spark, folder):
    days = lens.clock(spark, folder).join(lens.staff(spark, folder), "entity").withColumn("month", F.trunc("day", "month"))
    return relate.pivot_groups(days, ["month"], "leaver", ["No", "Yes"], F.count(F.lit(1)))


@query("split_by_key", "retail", """
    SELECT concat(market, '_', segment) AS market_segment, count(*) AS rows, round(sum(sales), 4) AS sales FROM retail GROUP BY 1""")
def _(spark, folder):
    orders = lens.retail(spark, folder).withColumn("market_segment", parse.compose_key("market", "segment"))
    path = io.write_partitioned(orders, work_path(spark, "split"), ["market_segment"])
    back = spark.read.parquet(path)
    return tidy(back.groupBy("market_segment").agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("sales")), 4)
