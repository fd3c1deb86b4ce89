"""Registered queries: sources and sinks. Files go to the shared work folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.operators import aggregate as agg
from casewise.plans import lenses as lens
from casewise.plans.registry import query
from casewise.plans.shape import tidy
from casewise.session import work_path
from casewise.sources import tables as io

CDR_SCHEMA = (
    "square_id bigint, time_interval double, country_code bigint, sms_in double, sms_out double, "
    "call_in double, call_out double, internet double"
)
IN_SUBSET = "country_code IN (3, 7, 11)"
TOTAL_SQL = "sum(sms_in) + sum(sms_out) + sum(call_in) + sum(call_out) + sum(internet)"


@query("src_delimited", "cdr", """
    SELECT country_code, count(*) AS n, count(sms_in) AS n_sms_in, count(call_out) AS n_call_out,
           round(sum(sms_in), 4) AS sms_in, round(sum(internet), 4) AS internet
    FROM cdr GROUP BY country_code""")
def _(spark, folder):
    path = io.write_delimited(lens.cdr(spark, folder), work_path(spark, "cdr"))
    back = io.read_delimited(spark, path, CDR_SCHEMA)
    return tidy(
        back.groupBy("country_code").agg(
            F.count(F.lit(1)).alias("n"), F.count("sms_in").alias("n_sms_in"), F.count("call_out").alias("n_call_out"),
            F.sum("sms_in").alias("sms_in"), F.sum("internet").alias("internet"),
        ), 4)


@query("src_csv_header", "loan", """
    SELECT loan_id, round(loan_amnt, 4) AS loan_amnt, purpose, int_rate, emp_length, issue_d, delinq::BIGINT AS delinq
    FROM loan""")
def _(spark, folder):
    loans = lens.loan(spark, folder)
    path = io.write_delimited(loans, work_path(spark, "loan"), sep=",", header=True)
    back = io.read_csv(spark, path, loans.schema)
    return tidy(back.select("loan_id", "loan_amnt", "purpose", "int_rate", "emp_length", "issue_d", "delinq"), 4)


@query("src_csv_unnamed", "vec", """
    SELECT digit, count(*) AS n, round(sum(list_sum(pixels)), 5) AS total, round(sum(pixels[1]), 5) AS first_pixel
    FROM vec GROUP BY digit""")
def _(spark, folder):
    vectors = lens.vec(spark, folder)
    width = vectors.agg(F.max(F.size("pixels"))).first()[0]
    flat = vectors.select("digit", *[F.get("pixels", i).alias(f"pixel{i + 1}") for i in range(width)])
    path = io.write_delimited(flat, work_path(spark, "vec"), sep=",")
    back = io.read_unnamed_csv(spark, path, "digit", "pixel", width)
    total = F.aggregate("pixels", F.lit(0.0), lambda acc, x: acc + x)
    return tidy(
        back.groupBy("digit").agg(
            F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.sum(F.get("pixels", 0)).alias("first_pixel")
        ), 5)


@query("src_json_nested", "review", """
    SELECT category, count(*) AS n, sum(helpful[1])::BIGINT AS found, sum(helpful[2])::BIGINT AS total,
           sum(len(review_text))::BIGINT AS chars
    FROM review GROUP BY category""")
def _(spark, folder):
    reviews = lens.review(spark, folder)
    path = io.write_json_lines(reviews, work_path(spark, "review"))
    back = io.read_json_lines(spark, path, reviews.schema)
    return back.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get("helpful", 0)).alias("found"), F.sum(F.get("helpful", 1)).alias("total"),
        F.sum(F.length("review_text")).alias("chars"),
    )


@query("sink_ctas_subset", "cdr", """
    SELECT square_id, country_code, round(internet, 4) AS internet FROM cdr WHERE country_code IN (3, 7, 11)""")
def _(spark, folder):
    copy = io.write_subset(lens.cdr(spark, folder), IN_SUBSET, work_path(spark, "subset"))
    return tidy(copy.select("square_id", "country_code", "internet"), 4)


@query("sink_orc", "cdr", f"SELECT round({TOTAL_SQL}, 4) AS total_activity FROM cdr WHERE country_code IN (3, 7, 11)")
def _(spark, folder):
    copy = io.write_orc(lens.cdr(spark, folder).where(IN_SUBSET), work_path(spark, "orc"))
    return tidy(agg.sum_total(copy, lens.ACTIVITY, name="total_activity"), 4)


@query("sink_dynamic_partition", "cdr", """
    SELECT country_code, count(*) AS n, round(sum(CASE WHEN country_code = 7 THEN internet * 2 ELSE internet END), 4) AS internet
    FROM cdr WHERE country_code IN (3, 7, 11) GROUP BY country_code""")
def _(spark, folder):
    subset = lens.cdr(spark, folder).where(IN_SUBSET)
    path = io.write_partitioned(subset, work_path(spark, "partitioned"), ["country_code"])
    # Writing one country again must leave the others in place.
    io.write_partitioned(
        subset.where("country_code = 7").withColumn("internet", F.col("internet") * 2), path, ["country_code"]
    )
    back = spark.read.parquet(path)
    return tidy(
        back.groupBy(F.col("country_code").cast("long").alias("country_code")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("internet").alias("internet")
        ), 4)


@query("sink_csv", "trip ride", """
    SELECT request_id, pickup, status, CAST(met AS BIGINT) AS met,
           round(date_diff('microsecond', requested, dropped) / 6e7, 4) AS trip_minutes FROM ride""")
def _(spark, folder):
    rides = lens.ride(spark, folder)
    ready = rides.select(
        "request_id", "pickup", "status", F.col("met").cast("long").alias("met"),
        ((F.unix_micros("dropped") - F.unix_micros("requested")) / 6e7).alias("trip_minutes"),
    )
    path = io.write_delimited(ready, work_path(spark, "ride"), sep=",", header=True)
    return tidy(io.read_csv(spark, path, ready.schema), 4)


@query("sql_temp_view", "review", """
    SELECT year(make_timestamp(review_time * 1000000)) AS year, count(*) AS reviews FROM review GROUP BY 1""")
def _(spark, folder):
    io.as_view(lens.review(spark, folder), "casewise_review")
    return spark.sql("""
        SELECT CAST(year(timestamp_seconds(review_time)) AS BIGINT) AS year, count(*) AS reviews
        FROM casewise_review GROUP BY 1 ORDER BY 1""")
