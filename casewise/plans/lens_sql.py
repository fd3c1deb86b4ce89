"""DuckDB definitions of the lenses built in ``lenses.py``."""

LENS_SQL = {
    "cdr": """
        SELECT l_partkey AS square_id, epoch(l_shipdate) AS time_interval,
               CAST(s_nationkey AS BIGINT) AS country_code,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS sms_in,
               (l_discount + 0.0) * 100 AS sms_out, l_tax * 100 AS call_in,
               CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity / 10 END AS call_out,
               l_extendedprice AS internet
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "review": """
        SELECT o_orderkey AS review_id, o_orderstatus AS category, o_custkey AS reviewer,
               o_orderkey % 500 AS product, CAST(1 + o_orderkey % 5 AS DOUBLE) AS overall,
               CAST(epoch(o_orderdate) AS BIGINT) AS review_time,
               [o_orderkey % 17, o_orderkey % 17 + o_custkey % 13] AS helpful, text AS review_text
        FROM orders JOIN documents ON o_orderkey % (SELECT count(*) FROM documents) = doc_id""",
    "review_words": """
        SELECT o_orderkey AS review_id, o_orderstatus AS category, CAST(1 + o_orderkey % 5 AS DOUBLE) AS overall,
               len(string_split(text, ' ')) AS words,
               CASE WHEN o_orderkey % 17 + o_custkey % 13 >= 10
                    THEN (o_orderkey % 17) / (o_orderkey % 17 + o_custkey % 13) * 100 END AS helpful_percent
        FROM orders JOIN documents ON o_orderkey % (SELECT count(*) FROM documents) = doc_id""",
    "rating": """
        SELECT o_custkey AS user, l_partkey AS item, 1 + (CAST(l_quantity AS BIGINT) % 9) / 2 AS rating,
               CASE WHEN o_custkey % 97 = 0 THEN '' WHEN o_custkey % 89 = 0 THEN NULL
                    ELSE concat('u', o_custkey) END AS user_name,
               o_orderkey AS order_no, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS qty
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "rating_once": """
        SELECT user, item, first(rating ORDER BY order_no, line_no, qty) AS rating
        FROM (SELECT o_custkey AS user, l_partkey AS item, 1 + (CAST(l_quantity AS BIGINT) % 9) / 2 AS rating,
                     o_orderkey AS order_no, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS qty
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey
              WHERE o_custkey % 97 <> 0 AND o_custkey % 89 <> 0)
        GROUP BY user, item""",
    "matrix": """
        SELECT r.user, r.item, r.rating FROM rating_once r
        JOIN (SELECT item FROM rating_once GROUP BY item HAVING count(*) >= 30) USING (item)
        JOIN (SELECT user FROM rating_once GROUP BY user HAVING count(*) >= 40) USING (user)""",
    "car": """
        SELECT p_partkey AS car_id,
               CASE WHEN p_partkey % 50 = 0 THEN concat('x', p_name) ELSE p_name END AS car_name,
               p_brand AS brand, p_type AS body,
               CASE WHEN p_partkey % 2 = 0 THEN 'diesel' ELSE 'gas' END AS fuel,
               CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 37 AS DOUBLE) AS wheel,
               CAST(p_partkey % 11 AS DOUBLE) AS width,
               3.0 * p_size + p_partkey % 7 AS power,
               CAST(p_size + p_partkey % 37 AS DOUBLE) AS span,
               p_retailprice + 30.0 * p_size + 4.0 * (p_partkey % 37) + (p_partkey * 7919) % 101 AS price
        FROM part""",
    "clock": """
        SELECT user_id AS entity, CAST(moment AS DATE) AS day, min(moment) AS in_at, max(moment) AS out_at
        FROM (SELECT user_id, ts + to_days(CAST(31 * (event_id % 2) AS INTEGER)) AS moment FROM events)
        GROUP BY ALL""",
    "staff": "SELECT DISTINCT user_id AS entity, CASE WHEN user_id % 5 = 0 THEN 'Yes' ELSE 'No' END AS leaver FROM events",
    "loan": """
        SELECT o_orderkey AS loan_id, o_totalprice AS loan_amnt, c_acctbal AS annual_inc,
               o_totalprice / 36 AS installment, o_orderpriority AS purpose, o_orderstatus AS loan_status,
               concat(5 + o_orderkey % 20, '.', lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0'), '%') AS int_rate,
               CASE o_custkey % 12 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years'
                    WHEN 11 THEN 'n/a' ELSE concat(o_custkey % 12, ' years') END AS emp_length,
               strftime(CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate - INTERVAL 30 YEAR ELSE o_orderdate END,
                        '%b-%y') AS issue_d,
               concat(chr(CAST(65 + (o_orderkey % 35) // 5 AS INTEGER)), 1 + o_orderkey % 5) AS sub_grade,
               CASE WHEN o_orderkey % 3 = 0 THEN '60 months' ELSE '36 months' END AS term,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_nationkey END AS delinq,
               CAST(NULL AS VARCHAR) AS next_d, 1 AS policy_code
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "retail": """
        SELECT r_name AS market, c_mktsegment AS segment, strftime(o_orderdate, '%d-%m-%Y') AS order_date,
               l_extendedprice AS sales, CAST(l_quantity AS BIGINT) AS quantity,
               l_extendedprice * (l_discount - 0.03) AS profit
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "monthly": """
        SELECT concat(market, '_', segment) AS series,
               CAST(date_trunc('month', strptime(order_date, '%d-%m-%Y')) AS DATE) AS month,
               sum(sales) AS value
        FROM retail GROUP BY ALL""",
    "series": """
        SELECT series, month, row_number() OVER (PARTITION BY series ORDER BY month) AS t,
               coalesce(value, 0) AS value
        FROM (SELECT series, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month
              FROM monthly GROUP BY series) LEFT JOIN monthly USING (series, month)""",
    "trip": """
        SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'Airport' ELSE 'City' END AS pickup,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled'
                    ELSE 'no_cars' END AS status,
               CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M')
                    ELSE strftime(ts, '%d-%m-%Y %H:%M:%S') END AS request_text,
               CASE WHEN event_type <> 'purchase' THEN NULL
                    WHEN event_id % 2 = 0 THEN strftime(ts + to_seconds(CAST(floor(value * 60) AS BIGINT)), '%d/%m/%Y %H:%M')
                    ELSE strftime(ts + to_seconds(CAST(floor(value * 60) AS BIGINT)), '%d-%m-%Y %H:%M:%S') END AS drop_text
        FROM events""",
    "ride": """
        SELECT request_id, pickup, status, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS met,
               CASE WHEN request_text LIKE '%/%' THEN strptime(request_text, '%d/%m/%Y %H:%M')
                    ELSE strptime(request_text, '%d-%m-%Y %H:%M:%S') END AS requested,
               CASE WHEN drop_text LIKE '%/%' THEN strptime(drop_text, '%d/%m/%Y %H:%M')
                    ELSE strptime(drop_text, '%d-%m-%Y %H:%M:%S') END AS dropped
        FROM trip""",
    "vec": "SELECT vec_id, CAST(label AS BIGINT) AS digit, embedding::DOUBLE[] AS pixels FROM embeddings",
    "score": """
        SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
               o_totalprice / 500000 AS score FROM orders""",
    "coarse": """
        SELECT doc_id AS key, quality AS label, n_chars // 500 / 8 AS score
        FROM labels JOIN documents USING (doc_id)""",
    "risk": """
        SELECT o_orderkey AS key, CASE WHEN o_totalprice / 5000 + (o_orderkey * 7919) % 101 > 100 THEN 1 ELSE 0 END AS label,
               o_totalprice / 100000 AS price, c_acctbal / 1000 AS income, CAST(o_custkey % 13 AS DOUBLE) AS tenure,
               CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 50000 + (o_orderkey % 17) / 10 END AS span
        FROM orders JOIN customer ON o_custkey = c_custkey""",
}
