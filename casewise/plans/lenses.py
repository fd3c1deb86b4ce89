"""Views that give the driver's tables the shape each operator family expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions import parse
from casewise.operators import clean, relate, series as ts

ACTIVITY = ["sms_in", "sms_out", "call_in", "call_out", "internet"]
COUNTRIES = [3, 7, 11]
MIN_PER_ITEM = 30
MIN_PER_USER = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cdr(spark, folder):
    lines = table(spark, folder, "lineitem")
    suppliers = table(spark, folder, "supplier")
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_partkey").alias("square_id"),
        F.unix_timestamp("l_shipdate").cast("double").alias("time_interval"),
        F.col("s_nationkey").cast("long").alias("country_code"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("sms_in"),
        ((F.col("l_discount") + 0.0) * 100).alias("sms_out"),
        (F.col("l_tax") * 100).alias("call_in"),
        F.when(F.col("l_quantity") >= 10, F.col("l_quantity") / 10).alias("call_out"),
        F.col("l_extendedprice").alias("internet"),
    )


def review(spark, folder):
    orders = table(spark, folder, "orders")
    docs = table(spark, folder, "documents")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    keyed = orders.withColumn("doc_id", F.col("o_orderkey") % n_docs)
    return keyed.join(docs, "doc_id").select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_orderstatus").alias("category"),
        F.col("o_custkey").alias("reviewer"),
        (F.col("o_orderkey") % 500).alias("product"),
        (F.col("o_orderkey") % 5 + 1).cast("double").alias("overall"),
        F.unix_timestamp("o_orderdate").alias("review_time"),
        F.array(F.col("o_orderkey") % 17, F.col("o_orderkey") % 17 + F.col("o_custkey") % 13).alias("helpful"),
        F.col("text").alias("review_text"),
    )


def review_words(spark, folder):
    """Reviews reduced to word count and helpfulness; texts are counted before the join moves them."""
    orders = table(spark, folder, "orders")
    docs = table(spark, folder, "documents")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    # A merge join counts each text before the exchange; a broadcast of the orders would evaluate
    # the count once per matching order.
    counted = docs.select("doc_id", parse.word_count("text").alias("words")).hint("merge")
    helpful = F.array(F.col("o_orderkey") % 17, F.col("o_orderkey") % 17 + F.col("o_custkey") % 13)
    return (
        orders.withColumn("doc_id", F.col("o_orderkey") % n_docs)
        .join(counted, "doc_id")
        .select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_orderstatus").alias("category"),
            (F.col("o_orderkey") % 5 + 1).cast("double").alias("overall"),
            "words",
            parse.helpful_percent(helpful).alias("helpful_percent"),
        )
    )


def rating(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    user = F.col("o_custkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        user.alias("user"),
        F.col("l_partkey").alias("item"),
        (1 + (F.col("l_quantity").cast("long") % 9) / 2).alias("rating"),
        F.when(user % 97 == 0, "")
        .when(user % 89 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("u"), user.cast("string")))
        .alias("user_name"),
        F.col("o_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


def rating_once(spark, folder):
    named = clean.drop_blank_rows(rating(spark, folder), ["user_name"])
    needed = named.drop("user_name")
    return clean.dedup_keep_first(needed, ["user", "item"], ["order_no", "line_no", "qty"]).select("user", "item", "rating")


def matrix(spark, folder, once=None):
    """``once``: the deduplicated ratings, if they are staged."""
    once = rating_once(spark, folder) if once is None else once
    kept = relate.join_activity_threshold(once, "user", "item", MIN_PER_USER, MIN_PER_ITEM)
    return kept.select("user", "item", "rating")


def car(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("car_id"),
        F.when(key % 50 == 0, F.concat(F.lit("x"), F.col("p_name"))).otherwise(F.col("p_name")).alias("car_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("body"),
        F.when(key % 2 == 0, "diesel").otherwise("gas").alias("fuel"),
        F.col("p_size").cast("double").alias("size"),
        (key % 37).cast("double").alias("wheel"),
        (key % 11).cast("double").alias("width"),
        (F.col("p_size") * 3.0 + key % 7).alias("power"),
        (F.col("p_size") + key % 37).cast("double").alias("span"),
        (F.col("p_retailprice") + F.col("p_size") * 30.0 + (key % 37) * 4.0 + (key * 7919) % 101).alias("price"),
    )


def clock(spark, folder):
    shifted = table(spark, folder, "events").select(
        F.col("user_id").alias("entity"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 2 * 31).cast("int"))).alias("at"),
    )
    return shifted.groupBy("entity", F.to_date("at").alias("day")).agg(
        F.min("at").alias("in_at"), F.max("at").alias("out_at")
    )


def staff(spark, folder):
    user = F.col("user_id")
    return (
        table(spark, folder, "events")
        .select(user.alias("entity"), F.when(user % 5 == 0, "Yes").otherwise("No").alias("leaver"))
        .distinct()
    )


def loan(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    key, tenure = F.col("o_orderkey"), F.col("o_custkey") % 12
    issued = F.when(key % 5 == 0, F.add_months("o_orderdate", -360)).otherwise(F.to_date("o_orderdate"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.alias("loan_id"),
        F.col("o_totalprice").alias("loan_amnt"),
        F.col("c_acctbal").alias("annual_inc"),
        (F.col("o_totalprice") / 36).alias("installment"),
        F.col("o_orderpriority").alias("purpose"),
        F.col("o_orderstatus").alias("loan_status"),
        F.format_string("%d.%02d%%", 5 + key % 20, F.col("o_custkey") % 100).alias("int_rate"),
        F.when(tenure == 0, "< 1 year")
        .when(tenure == 1, "1 year")
        .when(tenure == 10, "10+ years")
        .when(tenure == 11, "n/a")
        .otherwise(F.concat(tenure.cast("string"), F.lit(" years")))
        .alias("emp_length"),
        F.date_format(issued, "MMM-yy").alias("issue_d"),
        F.concat(
            F.char(65 + F.floor((key % 35) / 5)), (1 + key % 5).cast("string")
        ).alias("sub_grade"),
        F.when(key % 3 == 0, "60 months").otherwise("36 months").alias("term"),
        F.when(key % 11 != 0, F.col("c_nationkey").cast("int")).alias("delinq"),
        F.lit(None).cast("string").alias("next_d"),
        F.lit(1).alias("policy_code"),
    )


def retail(spark, folder):
    lines, orders, customers, nations, regions = (
        table(spark, folder, name) for name in ("lineitem", "orders", "customer", "nation", "region")
    )
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .join(regions, nations.n_regionkey == regions.r_regionkey)
        .select(
            F.col("r_name").alias("market"),
            F.col("c_mktsegment").alias("segment"),
            F.date_format("o_orderdate", "dd-MM-yyyy").alias("order_date"),
            F.col("l_extendedprice").alias("sales"),
            F.col("l_quantity").cast("long").alias("quantity"),
            (F.col("l_extendedprice") * (F.col("l_discount") - 0.03)).alias("profit"),
        )
    )


def monthly(spark, folder, measure="sales"):
    """Monthly total per market segment; summed per date text first, so few texts are parsed."""
    daily = retail(spark, folder).groupBy("market", "segment", "order_date").agg(F.sum(measure).alias("value"))
    return (
        daily.select(
            parse.compose_key("market", "segment").alias("series"),
            F.trunc(parse.parse_date("order_date"), "month").alias("month"),
            "value",
        )
        .groupBy("series", "month")
        .agg(F.sum("value").alias("value"))
    )


def series(spark, folder, measure="sales", ahead=0):
    return ts.regular_series(monthly(spark, folder, measure), "series", "month", "value", ahead=ahead)


def trip(spark, folder):
    early, late = "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss"
    even = F.col("event_id") % 2 == 0
    at = F.col("ts").cast("timestamp")
    dropped = at + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("decimal(18,6)"))

    def text(moment):
        return F.when(even, F.date_format(moment, early)).otherwise(F.date_format(moment, late))

    return table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, "Airport").otherwise("City").alias("pickup"),
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "cancelled")
        .otherwise("no_cars")
        .alias("status"),
        text(at).alias("request_text"),
        F.when(F.col("event_type") == "purchase", text(dropped)).alias("drop_text"),
    )


def ride(spark, folder):
    """Trips with parsed timestamps and the request-met flag."""
    return trip(spark, folder).select(
        "request_id",
        "pickup",
        "status",
        parse.derive_flag(F.col("status") == "completed").alias("met"),
        parse.parse_mixed_timestamp("request_text").alias("requested"),
        parse.parse_mixed_timestamp("drop_text").alias("dropped"),
    )


def vec(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("digit"), F.col("embedding").cast("array<double>").alias("pixels")
    )


def score(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (F.col("o_totalprice") / 500000).alias("score"),
    )


def coarse(spark, folder):
    """A second score with many ties."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.col("quality").alias("label"),
        (F.floor(F.col("n_chars") / 500) / 8).alias("score"),
    )


def risk(spark, folder):
    """A binary outcome with a real signal, two weak predictors and one that overlaps another."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.alias("key"),
        F.when(total / 5000 + (key * 7919) % 101 > 100, 1).otherwise(0).alias("label"),
        (total / 100000).alias("price"),
        (F.col("c_acctbal") / 1000).alias("income"),
        (F.col("o_custkey") % 13).cast("double").alias("tenure"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.when(key % 10 != 0, total / 50000 + (key % 17) / 10).alias("span"),
    )
