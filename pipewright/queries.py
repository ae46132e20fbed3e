"""The registered queries of the verb engine, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

#: Views that some queries need: (name, pipeline).
VIEWS = {
    "big_orders": "orders %>% filter(o_totalprice > 400000) %>% select(c_custkey = o_custkey, o_orderkey, o_totalprice)",
    "cust_nations": "customer %>% filter(c_acctbal > 5000) %>% select(k = c_nationkey)",
    "rich_segments": "customer %>% filter(c_acctbal > 9000) %>% group_by(c_nationkey, c_mktsegment) %>% summarise(rich = n())",
    "supp_nations": "supplier %>% select(k = s_nationkey)",
    "with_nulls": "customer %>% select(c_custkey, c_name, c_acctbal) %>% left_join(big_orders, by = \"c_custkey\")",
}
_BIG = "SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000"
_NULLS = f"SELECT c.c_custkey, c.c_name, c.c_acctbal, b.o_orderkey, b.o_totalprice FROM customer c LEFT JOIN ({_BIG}) b USING (c_custkey)"

#: name: (pipeline or statement, DuckDB SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "flagship": (
        "lineitem %>% filter(l_quantity > 24) %>% group_by(l_returnflag, l_linestatus) %>% summarise(sum_qty = sum(l_quantity), avg_price = mean(l_extendedprice), n = n()) %>% mutate(sum_qty = round(sum_qty, 2), avg_price = round(avg_price, 4)) %>% arrange(l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity > 24 GROUP BY 1, 2",
    ),
    "scan_bare": ("region", "SELECT * FROM region"),
    "select_cols": ("customer %>% select(c_custkey, c_name)", "SELECT c_custkey, c_name FROM customer"),
    "select_alias": ("customer %>% select(c_custkey, nm = c_name)", "SELECT c_custkey, c_name AS nm FROM customer"),
    "select_fn": ("part %>% select(p_partkey, u = toupper(p_name))", "SELECT p_partkey, upper(p_name) AS u FROM part"),
    "select_all": ("nation %>% select()", "SELECT * FROM nation"),
    "select_then_filter": ("customer %>% select(c_name) %>% filter(c_acctbal > 5000)", "SELECT c_name FROM customer WHERE c_acctbal > 5000"),
    "select_then_mutate": ("customer %>% select(c_name) %>% mutate(b = round(c_acctbal * 2, 2))", "SELECT c_name, round(c_acctbal * 2, 2) AS b FROM customer"),
    "select_twice": ("customer %>% select(c_custkey, c_name) %>% select(c_name, c_nationkey)", "SELECT c_name, c_nationkey FROM customer"),
    "filter_cmp": ("orders %>% filter(o_totalprice >= 100000) %>% filter(o_totalprice < 200000) %>% select(o_orderkey, o_totalprice)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000"),
    "filter_bool": ('orders %>% filter(o_totalprice > 100000 & o_orderstatus == "F" | o_orderpriority == "1-URGENT") %>% select(o_orderkey)', "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"),
    "filter_str": ("customer %>% filter(c_mktsegment != 'BUILDING') %>% select(c_custkey, c_mktsegment)", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "filter_chain": ("lineitem %>% filter(l_quantity > 10) %>% filter(l_discount < 0.05) %>% filter(l_returnflag == 'R') %>% select(l_orderkey, l_quantity)", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05::DOUBLE AND l_returnflag = 'R'"),
    "filter_arith": ("lineitem %>% filter(l_extendedprice * (1 - l_discount) > 50000) %>% select(l_orderkey, l_extendedprice)", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000"),
    "filter_window": ("customer %>% group_by(c_nationkey) %>% filter(rank(c_acctbal) <= 2) %>% select(c_custkey, c_nationkey)", "SELECT c_custkey, c_nationkey FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) <= 2"),
    "mutate_arith": ("lineitem %>% mutate(rev = l_extendedprice * (1 - l_discount)) %>% select(l_orderkey, l_linenumber, rev)", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS rev FROM lineitem"),
    "mutate_overwrite": ("nation %>% mutate(n_nationkey = n_nationkey * 2 + 1)", "SELECT n_nationkey * 2 + 1 AS n_nationkey, n_name, n_regionkey FROM nation"),
    "mutate_chain": ("lineitem %>% mutate(rev = l_extendedprice * (1 - l_discount), tax = rev * l_tax) %>% select(l_orderkey, l_linenumber, tax)", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * l_tax AS tax FROM lineitem"),
    "mutate_divide": ("part %>% select(p_partkey, q = p_retailprice / (p_size - 10), z = (p_size - p_size) / (p_size - p_size))", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'inf'::DOUBLE ELSE p_retailprice / (p_size - 10) END AS q, 'nan'::DOUBLE AS z FROM part"),
    "mutate_math": (
        "part %>% select(p_partkey, a = abs(p_size - 25), r = round(p_retailprice), r2 = round(p_retailprice / 7, 2), f = floor(p_retailprice), c1 = ceiling(p_retailprice), c2 = ceil(p_retailprice), s = round(sqrt(p_size), 6), g = sign(p_size - 25), e = round(exp(p_size / 10), 6), l = round(log(p_size), 6), lb = round(log(p_size, base = 2), 6), l10 = round(log10(p_size), 6), m = mod(p_size, 7))",
        "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice) AS r, round(p_retailprice / 7, 2) AS r2, floor(p_retailprice) AS f, ceil(p_retailprice) AS c1, ceil(p_retailprice) AS c2, round(sqrt(p_size), 6) AS s, CAST(sign(p_size - 25) AS INTEGER) AS g, round(exp(p_size / 10), 6) AS e, round(ln(p_size), 6) AS l, round(ln(p_size) / ln(2), 6) AS lb, round(log10(p_size), 6) AS l10, p_size % 7 AS m FROM part",
    ),
    "mutate_log_edges": ("part %>% select(p_partkey, a = log(p_size - p_size), b = log10(0 * p_retailprice), c = round(sqrt(p_size - 1), 6))", "SELECT p_partkey, '-inf'::DOUBLE AS a, '-inf'::DOUBLE AS b, round(sqrt(p_size - 1), 6) AS c FROM part"),
    "mutate_trig": (
        "part %>% mutate(x = p_size / 100) %>% select(p_partkey, a = round(sin(x), 9), b = round(cos(x), 9), c = round(tan(x), 9), d = round(asin(x), 9), e = round(acos(x), 9), f = round(atan(x), 9), g = round(atan2(x, 2), 9), h = round(sinh(x), 9), i = round(cosh(x), 9), j = round(tanh(x), 9))",
        "SELECT p_partkey, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(asin(x), 9) AS d, round(acos(x), 9) AS e, round(atan(x), 9) AS f, round(atan2(x, 2), 9) AS g, round(sinh(x), 9) AS h, round(cosh(x), 9) AS i, round(tanh(x), 9) AS j FROM (SELECT p_partkey, p_size / 100 AS x FROM part)",
    ),
    "mutate_string": (
        'part %>% select(p_partkey, lo = tolower(p_name), lo2 = lower(p_brand), lo3 = str_to_lower(p_type), up = toupper(p_name), up2 = upper(p_type), up3 = str_to_upper(p_name), up4 = touppercase(p_brand), ss = substr(p_name, 2, 4), ss0 = substr(p_name, 0, 2), tail = substr(p_name, 3), n = nchar(p_name), n2 = str_length(p_type), z = nzchar(p_name), t = trimws(paste0(" ", p_name, " ")), t2 = str_trim(p_brand), p = paste(p_name, p_brand), p2 = paste(p_name, p_size, sep = "-"), p0 = paste0(p_name, p_size), cc = concat(p_brand, "/", p_type))',
        "SELECT p_partkey, lower(p_name) AS lo, lower(p_brand) AS lo2, lower(p_type) AS lo3, upper(p_name) AS up, upper(p_type) AS up2, upper(p_name) AS up3, upper(p_brand) AS up4, substr(p_name, 2, 3) AS ss, substr(p_name, 1, 2) AS ss0, substr(p_name, 3) AS tail, length(p_name) AS n, length(p_type) AS n2, length(p_name) > 0 AS z, trim(' ' || p_name || ' ') AS t, trim(p_brand) AS t2, p_name || ' ' || p_brand AS p, p_name || '-' || p_size AS p2, p_name || p_size AS p0, p_brand || '/' || p_type AS cc FROM part",
    ),
    "string_documents": ("documents %>% filter(str_detect(text, pattern = 'License')) %>% select(doc_id, n = nchar(text), head = substr(text, 1, 20))", "SELECT doc_id, length(text) AS n, substr(text, 1, 20) AS head FROM documents WHERE regexp_matches(text, 'License')"),
    "mutate_regex": ('pages %>% filter(str_detect(url, "^https://(www|m)[.]")) %>% select(page_id, url)', "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://(www|m)[.]')"),
    "mutate_cast": ("orders %>% select(o_orderkey, i = as.integer(o_totalprice), d = as.numeric(o_custkey), d2 = as.double(o_orderkey), s = as.character(o_custkey), b = as.logical(mod(o_custkey, 2)))", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS i, CAST(o_custkey AS DOUBLE) AS d, CAST(o_orderkey AS DOUBLE) AS d2, CAST(o_custkey AS VARCHAR) AS s, CAST(o_custkey % 2 AS BOOLEAN) AS b FROM orders"),
    "mutate_cond": ("customer %>% select(c_custkey, a = ifelse(c_acctbal > 0, 'in', 'out'), b = if_else(c_acctbal < 0, true = -1, false = 1), c = if_else(false = 0, condition = c_custkey > 100, true = 2))", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS a, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS b, CASE WHEN c_custkey > 100 THEN 2 ELSE 0 END AS c FROM customer"),
    "mutate_null": ("with_nulls %>% select(c_custkey, o_orderkey, none = is.na(o_orderkey), v = coalesce(o_totalprice, c_acctbal), w = replace_na(o_totalprice, 0), w2 = na.replace(o_orderkey, 0), j = paste0(c_name, o_orderkey), eq = o_orderkey == NA)", f"SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS none, coalesce(o_totalprice, c_acctbal) AS v, coalesce(o_totalprice, 0) AS w, coalesce(o_orderkey, 0) AS w2, concat(c_name, o_orderkey) AS j, CAST(NULL AS BOOLEAN) AS eq FROM ({_NULLS})"),
    "unary_ops": ("customer %>% filter(!(c_acctbal > 0)) %>% select(c_custkey, neg = -c_acctbal)", "SELECT c_custkey, -c_acctbal AS neg FROM customer WHERE NOT (c_acctbal > 0)"),
    "rename_cols": ('nation %>% rename(key = n_nationkey, "nm" = n_name)', "SELECT n_nationkey AS key, n_name AS nm, n_regionkey FROM nation"),
    "rename_after_select": ("nation %>% select(n_name, n_nationkey) %>% rename(key = n_nationkey)", "SELECT n_name, n_nationkey AS key FROM nation"),
    "arrange_asc_desc": ("with_nulls %>% select(c_custkey, o_orderkey) %>% arrange(desc(o_orderkey), c_custkey)", f"SELECT c_custkey, o_orderkey FROM ({_NULLS})"),
    "agg_global": ("lineitem %>% summarise(n = n(), c = count(l_orderkey), mn = min(l_quantity), mx = max(l_shipdate), s = sum(l_linenumber), a = mean(l_linenumber), a2 = avg(l_quantity))", "SELECT count(*) AS n, count(l_orderkey) AS c, min(l_quantity) AS mn, max(l_shipdate) AS mx, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_linenumber) AS a, avg(l_quantity) AS a2 FROM lineitem"),
    "agg_grouped": ("orders %>% group_by(o_orderstatus) %>% summarize(n = n(), mn = min(o_totalprice), mx = max(o_totalprice))", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders GROUP BY 1"),
    "agg_multi_key": ("lineitem %>% group_by(l_returnflag, l_linestatus) %>% summarise(s = sum(l_linenumber), n = n())", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "agg_keys_only": ("orders %>% group_by(o_orderstatus, o_orderpriority) %>% summarise()", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "agg_median": ("orders %>% group_by(o_orderstatus) %>% summarise(m = median(o_totalprice))", "SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY 1"),
    "agg_mode": ("orders %>% summarise(m = mode(o_orderstatus))", "SELECT mode(o_orderstatus) AS m FROM orders"),
    "agg_unaliased": ("orders %>% group_by(o_orderstatus) %>% summarise(avg(o_custkey), max(o_custkey))", 'SELECT o_orderstatus, avg(o_custkey) AS "avg(o_custkey)", max(o_custkey) AS "max(o_custkey)" FROM orders GROUP BY 1'),
    "agg_nulls": ("with_nulls %>% summarise(n = n(), c = count(o_orderkey), m = max(o_totalprice))", f"SELECT count(*) AS n, count(o_orderkey) AS c, max(o_totalprice) AS m FROM ({_NULLS})"),
    "agg_empty": ("orders %>% filter(o_totalprice < 0) %>% summarise(n = n(), s = sum(o_custkey), m = median(o_totalprice))", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, median(o_totalprice) AS m FROM orders WHERE o_totalprice < 0"),
    "agg_then_filter": ("orders %>% group_by(o_custkey) %>% summarise(n = n()) %>% filter(n > 12)", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "agg_then_mutate": ("orders %>% group_by(o_custkey) %>% summarise(n = n(), k = max(o_orderkey)) %>% mutate(x = n * 2 + k)", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS k, count(*) * 2 + max(o_orderkey) AS x FROM orders GROUP BY 1"),
    "agg_then_window": ("orders %>% group_by(o_custkey) %>% summarise(n = n()) %>% mutate(r = dense_rank(n)) %>% arrange(r)", "SELECT o_custkey, n, dense_rank() OVER (ORDER BY n) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"),
    "mutate_then_group": ("lineitem %>% mutate(big = l_quantity > 25) %>% group_by(big) %>% summarise(n = n())", "SELECT l_quantity > 25 AS big, count(*) AS n FROM lineitem GROUP BY 1"),
    "late_group_by": ("orders %>% group_by(o_orderstatus, o_orderpriority) %>% summarise(n = n()) %>% group_by(o_orderstatus) %>% mutate(r = rank(n))", "SELECT o_orderstatus, o_orderpriority, n, rank() OVER (PARTITION BY o_orderstatus ORDER BY n) AS r FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)"),
    "group_without_summarise": ("nation %>% group_by(n_regionkey) %>% select(n_name)", "SELECT n_name FROM nation"),
    "join_inner": ("nation %>% rename(r_regionkey = n_regionkey) %>% inner_join(region, by = 'r_regionkey')", "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left": ("customer %>% select(c_custkey, c_name) %>% left_join(big_orders, by = 'c_custkey')", f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN ({_BIG}) USING (c_custkey)"),
    "join_right": ("big_orders %>% right_join(customer, by = 'c_custkey') %>% select(c_custkey, o_orderkey, c_name)", f"SELECT c_custkey, o_orderkey, c_name FROM ({_BIG}) RIGHT JOIN customer USING (c_custkey)"),
    "join_full": ("customer %>% filter(c_custkey <= 700) %>% select(c_custkey, c_name) %>% full_join(big_orders, by = 'c_custkey')", f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 700) FULL JOIN ({_BIG}) USING (c_custkey)"),
    "join_semi": ("customer %>% semi_join(big_orders, by = 'c_custkey') %>% select(c_custkey)", f"SELECT c_custkey FROM customer SEMI JOIN ({_BIG}) USING (c_custkey)"),
    "join_anti": ("customer %>% anti_join(big_orders, by = 'c_custkey') %>% select(c_custkey)", f"SELECT c_custkey FROM customer ANTI JOIN ({_BIG}) USING (c_custkey)"),
    "join_theta": ("nation %>% select(n_name, n_nationkey) %>% inner_join(region, by = n_nationkey < r_regionkey)", "SELECT n_name, n_nationkey, r_regionkey, r_name FROM nation JOIN region ON n_nationkey < r_regionkey"),
    "join_names_differ": ("supplier %>% inner_join(nation, by = s_nationkey == n_nationkey) %>% select(s_suppkey, n_name)", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_multi": ("customer %>% inner_join(rich_segments, by = c('c_nationkey', 'c_mktsegment')) %>% select(c_custkey, c_nationkey, c_mktsegment, rich)", 'SELECT c_custkey, c_nationkey, c_mktsegment, rich FROM customer JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2) USING (c_nationkey, c_mktsegment)'),
    "join_self": ("nation %>% inner_join(nation, by = 'n_regionkey') %>% filter(n_nationkey.x < n_nationkey.y) %>% select(n_regionkey, a = n_name.x, b = n_name.y)", "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_chain": ("customer %>% inner_join(nation, by = c_nationkey == n_nationkey) %>% inner_join(region, by = n_regionkey == r_regionkey) %>% group_by(r_name) %>% summarise(n = n())", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_star_agg": (
        "lineitem %>% inner_join(orders, by = l_orderkey == o_orderkey) %>% inner_join(customer, by = o_custkey == c_custkey) %>% mutate(rev = l_extendedprice * (1 - l_discount)) %>% group_by(c_mktsegment, o_orderstatus) %>% summarise(n = n(), revenue = sum(rev)) %>% mutate(revenue = round(revenue, 1))",
        "SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
    "set_union": ("cust_nations %>% union(supp_nations)", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier"),
    "set_intersect": ("cust_nations %>% intersect(supp_nations)", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier"),
    "set_setdiff": ("nation %>% select(k = n_nationkey) %>% setdiff(supp_nations)", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier"),
    "setop_then_filter": ("cust_nations %>% union(supp_nations) %>% filter(k > 10)", "SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier) WHERE k > 10"),
    "setop_twice": ("cust_nations %>% arrange(k) %>% union(supp_nations) %>% setdiff(supp_nations)", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier"),
    "win_row_number": ("customer %>% group_by(c_nationkey) %>% mutate(r = row_number(c_custkey)) %>% select(c_custkey, r)", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer"),
    "win_rank": ("customer %>% group_by(c_nationkey) %>% mutate(r = rank(c_acctbal)) %>% select(c_custkey, r)", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer"),
    "win_dense_rank": ("part %>% group_by(p_brand) %>% mutate(r = dense_rank(p_size)) %>% select(p_partkey, r)", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    "win_rank_unordered": ('nation %>% group_by(n_regionkey) %>% mutate(r = rank(), d = dense_rank(), o = rank(n_nationkey)) %>% filter(rank() == 1 & o > 2) %>% select(n_name, r, d, o)', 'SELECT * FROM (SELECT n_name, rank() OVER (PARTITION BY n_regionkey) AS r, dense_rank() OVER (PARTITION BY n_regionkey) AS d, rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS o FROM nation) WHERE o > 2'),
    "win_lead_lag": ("events %>% group_by(user_id) %>% mutate(p = lag(value, 1, 0, event_id), q = lead(value, 2, value, event_id)) %>% select(event_id, p, q)", "SELECT event_id, lag(value, 1, 0) OVER w AS p, lead(value, 2, value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "win_lead_named": ("events %>% group_by(user_id) %>% mutate(p = lag(order_by = event_id, x = value), q = lead(value, order_by = event_id, n = 3)) %>% select(event_id, p, q)", "SELECT event_id, lag(value) OVER w AS p, lead(value, 3) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "win_first_last": ("events %>% group_by(event_type) %>% mutate(a = first(value, event_id), b = last(value, event_id), c = first_value(user_id, order_by = event_id), d = last_value(user_id, order_by = event_id)) %>% select(event_id, a, b, c, d)", "SELECT event_id, first_value(value) OVER w AS a, last_value(value) OVER f AS b, first_value(user_id) OVER w AS c, last_value(user_id) OVER f AS d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id), f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "win_ungrouped": ("nation %>% mutate(r = row_number(n_nationkey), p = lag(n_name, order_by = n_nationkey)) %>% select(n_name, r, p)", "SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r, lag(n_name) OVER (ORDER BY n_nationkey) AS p FROM nation"),
    "win_ntile": ('customer %>% group_by(c_nationkey) %>% mutate(t = ntile(4, c_custkey)) %>% select(c_custkey, t)', 'SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer'),
    "win_nth": ('customer %>% group_by(c_nationkey) %>% mutate(v = nth_value(c_acctbal, 3, c_custkey)) %>% select(c_custkey, v)', 'SELECT c_custkey, nth_value(c_acctbal, 3) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer'),
    "lambda_magrittr": ("nation %>% { . %>% filter(n_regionkey > 1) %>% select(n_name) } %>% arrange(n_name)", "SELECT n_name FROM nation WHERE n_regionkey > 1"),
    "dot_placeholder": ("nation %>% filter(., n_regionkey > 1) %>% { select(., n_name, n_nationkey) %>% filter(n_nationkey > 3) }", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey > 1 AND n_nationkey > 3"),
    "assign_target": ("few <- nation %>% filter(n_regionkey == 0)", "SELECT * FROM nation WHERE n_regionkey = 0"),
    "embed_sql": ("SELECT r_name, q.n FROM region JOIN (| nation %>% group_by(n_regionkey) %>% summarise(n = n()) %>% filter(n > 0) |) q ON q.n_regionkey = r_regionkey", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "embed_cte": ("WITH base AS (SELECT n_nationkey AS id, n_name FROM nation WHERE n_regionkey = 2) SELECT count(*) AS n FROM (| base %>% filter(id > 5) %>% select(id) |) AS x", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5"),
    "embed_hidden": ("SELECT nm, b FROM (| customer %>% select(c_name) %>% mutate(b = round(c_acctbal * 2, 2)) %>% rename(nm = c_name) |) q WHERE b > 0", "SELECT c_name AS nm, round(c_acctbal * 2, 2) AS b FROM customer WHERE round(c_acctbal * 2, 2) > 0"),
    "embed_hidden_group": ("SELECT * FROM (| customer %>% select(c_name) %>% group_by(c_nationkey) %>% summarise(n = n()) |) q WHERE n > 50", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50"),
    "embed_self_join": ("SELECT a, count(*) AS n FROM (| nation %>% inner_join(nation, by = 'n_regionkey') %>% select(n_regionkey, a = n_name.x, b = n_name.y) |) q WHERE a < b GROUP BY a", "SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name GROUP BY 1"),
    "embed_nested_cte": ("WITH base AS (SELECT n_nationkey AS id, n_regionkey AS r FROM nation), few AS (SELECT * FROM (| base %>% filter(r < 3) |)) SELECT r, count(*) AS n FROM (WITH inner_ AS (SELECT * FROM few WHERE id > 2) SELECT * FROM (| inner_ %>% select(id) %>% mutate(r = r + 1) |)) GROUP BY r", "SELECT n_regionkey + 1 AS r, count(*) AS n FROM nation WHERE n_regionkey < 3 AND n_nationkey > 2 GROUP BY 1"),
    "table_fn": ("SELECT c_nationkey, n FROM dplyr('customer %>% group_by(c_nationkey) %>% summarise(n = n())') WHERE n > 50", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50"),
    "table_fn_native": ("SELECT count(*) AS n FROM dplyr('customer |> filter(c_acctbal > 0) |> select(c_name)', 'native') AS t", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0"),
    "plain_sql": ("SELECT n_name FROM nation WHERE n_nationkey < 5", "SELECT n_name FROM nation WHERE n_nationkey < 5"),
}
NATIVE = {
    "pipe_native": ("nation |> filter(n_regionkey > 1) |> select(n_name)", "SELECT n_name FROM nation WHERE n_regionkey > 1"),
    "lambda_native": ("nation |> (\\(x) x |> filter(n_regionkey > 1) |> select(n_name))()", "SELECT n_name FROM nation WHERE n_regionkey > 1"),
    "implicit_source": ("filter(n_regionkey > 2) |> select(n_name, n_regionkey)", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2"),
}


def engine(spark: SparkSession, sf_dir: str, pipe_syntax: str | None = "magrittr") -> Engine:
    e = Engine(spark, pipe_syntax).load_dir(sf_dir, TABLES)
    e.catalog.promise("data", lambda: e.catalog.table("nation"))
    for name, text in VIEWS.items():
        e.catalog.promise(name, lambda text=text: e.pipe(text, pipe_syntax="magrittr"))
    return e


def _query(text: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, mode)
        return e.sql(text) if " " in text else e.pipe(text)

    return run


QUERIES = {k: _query(text, mode) for mode, pairs in (("magrittr", PAIRS), ("native", NATIVE)) for k, (text, _) in pairs.items()}
ORACLE_SQL = {k: sql for pairs in (PAIRS, NATIVE) for k, (_, sql) in pairs.items()}
