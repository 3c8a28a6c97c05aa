"""DuckDB SQL twins of ``giftlens.sources.fixtures`` (independent second
implementation used by the correctness oracle). ``with_fixtures(sql)`` prepends
the CTEs a query names (``fx_*``), dependencies first."""

from __future__ import annotations

import re

FIXTURES: dict[str, str] = {}

FIXTURES["fx_employees"] = """
SELECT CAST(10000000 + n_nationkey AS VARCHAR) AS company_cvr,
       CAST(n_regionkey AS VARCHAR) AS branch_code,
       CAST(CASE WHEN n_nationkey = 7 THEN 0
                 ELSE SUM(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) END AS DOUBLE) AS male_count,
       CAST(SUM(CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS female_count
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_regionkey"""

FIXTURES["fx_catalog"] = """
SELECT DISTINCT 'shop' || CAST(n_regionkey AS VARCHAR) AS shop_id, CAST(l_partkey AS VARCHAR) AS gift_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

FIXTURES["fx_selections"] = """
SELECT 'shop' || CAST(n_regionkey AS VARCHAR) AS shop_id,
       CAST(10000000 + n_nationkey AS VARCHAR) AS company_cvr,
       CASE WHEN l_linenumber % 2 = 0 THEN 'male' ELSE 'female' END AS employee_gender,
       CAST(l_partkey AS VARCHAR) AS gift_id,
       p_type AS product_main_category, p_name AS product_sub_category, p_brand AS product_brand,
       l_returnflag AS product_color,
       CASE WHEN p_size % 2 = 0 THEN 'durable' ELSE 'consumable' END AS product_durability,
       CASE WHEN p_partkey % 3 = 0 THEN 'male' WHEN p_partkey % 3 = 1 THEN 'female' ELSE 'unisex' END AS product_target_gender,
       CASE WHEN p_size % 3 = 0 THEN 'practical' WHEN p_size % 3 = 1 THEN 'work' ELSE 'status' END AS product_utility_type,
       CASE WHEN p_size % 5 = 0 THEN 'shareable' ELSE 'individual' END AS product_type,
       {'orderkey': l_orderkey, 'linenumber': l_linenumber, 'partkey': l_partkey,
        'suppkey': l_suppkey, 'extendedprice': l_extendedprice, 'shipdate': l_shipdate} AS event_seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN part ON l_partkey = p_partkey"""

_WS = "||".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())
_CLEAN = "coalesce(trim(trim({c}, '\"'), " + _WS + "), 'NONE')"
_LOWER = "coalesce(lower(trim(trim({c}, '\"'), " + _WS + ")), 'NONE')"
_SEL_COLS = ["shop_id", "company_cvr", "employee_gender", "gift_id", "product_main_category",
             "product_sub_category", "product_brand", "product_color", "product_durability",
             "product_target_gender", "product_utility_type", "product_type"]
_LOWER_COLS = {"employee_gender", "product_target_gender", "product_utility_type",
               "product_durability", "product_type"}

FIXTURES["fx_sel_clean"] = "SELECT " + ", ".join(
    (_LOWER if c in _LOWER_COLS else _CLEAN).format(c=c) + f" AS {c}" for c in _SEL_COLS
) + ", event_seq FROM fx_selections"

FIXTURES["fx_cat_clean"] = ("SELECT " + _CLEAN.format(c="shop_id") + " AS shop_id, "
                            + _CLEAN.format(c="gift_id") + " AS gift_id FROM fx_catalog")

FIXTURES["fx_emp_clean"] = """
SELECT company_cvr, branch_code,
       coalesce(CASE WHEN isnan(TRY_CAST(male_count AS DOUBLE)) THEN NULL ELSE TRY_CAST(male_count AS DOUBLE) END, 0.0) AS male_count,
       coalesce(CASE WHEN isnan(TRY_CAST(female_count AS DOUBLE)) THEN NULL ELSE TRY_CAST(female_count AS DOUBLE) END, 0.0) AS female_count
FROM fx_employees"""

FIXTURES["fx_groups"] = """
SELECT shop_id, company_cvr, gift_id, employee_gender, COUNT(*) AS selection_count,
       arg_min(product_main_category, event_seq) FILTER (WHERE product_main_category IS NOT NULL) AS product_main_category,
       arg_min(product_sub_category, event_seq) FILTER (WHERE product_sub_category IS NOT NULL) AS product_sub_category,
       arg_min(product_brand, event_seq) FILTER (WHERE product_brand IS NOT NULL) AS product_brand,
       arg_min(product_color, event_seq) FILTER (WHERE product_color IS NOT NULL) AS product_color,
       arg_min(product_durability, event_seq) FILTER (WHERE product_durability IS NOT NULL) AS product_durability,
       arg_min(product_target_gender, event_seq) FILTER (WHERE product_target_gender IS NOT NULL) AS product_target_gender,
       arg_min(product_utility_type, event_seq) FILTER (WHERE product_utility_type IS NOT NULL) AS product_utility_type,
       arg_min(product_type, event_seq) FILTER (WHERE product_type IS NOT NULL) AS product_type
FROM fx_sel_clean GROUP BY shop_id, company_cvr, gift_id, employee_gender"""

FIXTURES["fx_selected"] = """
SELECT g.shop_id, g.company_cvr, g.gift_id, g.employee_gender,
       CAST(g.selection_count AS BIGINT) AS selection_count,
       CASE g.employee_gender WHEN 'male' THEN e.male_count ELSE e.female_count END AS exposure,
       CASE WHEN (CASE g.employee_gender WHEN 'male' THEN e.male_count ELSE e.female_count END) > 0
            THEN g.selection_count / (CASE g.employee_gender WHEN 'male' THEN e.male_count ELSE e.female_count END)
            ELSE 0.0 END AS selection_rate,
       g.product_main_category, g.product_sub_category, g.product_brand, g.product_color,
       g.product_durability, g.product_target_gender, g.product_utility_type, g.product_type
FROM fx_groups g JOIN fx_emp_clean e ON g.company_cvr = e.company_cvr
WHERE g.employee_gender IN ('male', 'female')"""

FIXTURES["fx_gift_first"] = """
SELECT gift_id,
       arg_min(product_main_category, event_seq) AS product_main_category,
       arg_min(product_sub_category, event_seq) AS product_sub_category,
       arg_min(product_brand, event_seq) AS product_brand,
       arg_min(product_color, event_seq) AS product_color,
       arg_min(product_durability, event_seq) AS product_durability,
       arg_min(product_target_gender, event_seq) AS product_target_gender,
       arg_min(product_utility_type, event_seq) AS product_utility_type,
       arg_min(product_type, event_seq) AS product_type
FROM fx_sel_clean GROUP BY gift_id"""

FIXTURES["fx_universe"] = """
SELECT c.shop_id, e.company_cvr, c.gift_id, g.employee_gender,
       CASE g.employee_gender WHEN 'male' THEN e.male_count ELSE e.female_count END AS exposure
FROM fx_emp_clean e
JOIN (SELECT DISTINCT company_cvr, shop_id FROM fx_sel_clean) l ON e.company_cvr = l.company_cvr
JOIN fx_cat_clean c ON c.shop_id = l.shop_id
JOIN (VALUES ('male'), ('female')) g(employee_gender) ON TRUE"""

FIXTURES["fx_zero"] = """
SELECT u.shop_id, u.company_cvr, u.gift_id, u.employee_gender, CAST(0 AS BIGINT) AS selection_count,
       u.exposure, 0.0 AS selection_rate,
       coalesce(f.product_main_category, 'NONE') AS product_main_category,
       coalesce(f.product_sub_category, 'NONE') AS product_sub_category,
       coalesce(f.product_brand, 'NONE') AS product_brand,
       coalesce(f.product_color, 'NONE') AS product_color,
       coalesce(f.product_durability, 'NONE') AS product_durability,
       coalesce(f.product_target_gender, 'NONE') AS product_target_gender,
       coalesce(f.product_utility_type, 'NONE') AS product_utility_type,
       coalesce(f.product_type, 'NONE') AS product_type
FROM fx_universe u
LEFT JOIN fx_gift_first f ON u.gift_id = f.gift_id
WHERE NOT EXISTS (SELECT 1 FROM fx_groups s WHERE s.shop_id = u.shop_id AND s.company_cvr = u.company_cvr
                  AND s.gift_id = u.gift_id AND s.employee_gender = u.employee_gender)"""

FIXTURES["fx_training"] = "SELECT * FROM fx_selected UNION ALL SELECT * FROM fx_zero"

FIXTURES["fx_users"] = """
SELECT c_custkey AS id, c_name AS username, 'key-' || CAST(c_custkey AS VARCHAR) || '-' || c_name AS api_key,
       f.first_order AS created_at, f.first_order AS updated_at,
       c_acctbal >= 0 AS is_active, c_custkey % 50 = 0 AS is_admin
FROM customer LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
     ON c_custkey = f.o_custkey"""

FIXTURES["fx_log"] = """
SELECT event_id AS id, user_id, ts AS date_time, event_type AS api_route,
       props AS request_payload, props AS response_payload,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 500 WHEN event_type = 'error' THEN 404 ELSE 200 END
           AS response_status_code,
       value AS response_time_ms,
       CASE WHEN event_type = 'error' THEN 'failed' END AS error_message
FROM events"""

FIXTURES["fx_presents"] = """
SELECT p_partkey AS id,
       upper(md5(p_name || ' - ' || p_type || ' - ' || CAST(p_partkey AS VARCHAR) || '. Vendor ' || p_brand)) AS present_hash,
       p_name AS present_name, p_brand AS present_vendor, p_type AS model_name,
       CAST(p_partkey AS VARCHAR) AS model_no,
       CAST(NULL AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS run_id,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS item_main_category,
       p_name AS item_sub_category, CAST(NULL AS VARCHAR) AS color, p_brand AS brand, p_brand AS vendor,
       p_retailprice AS value_price,
       CASE WHEN p_partkey % 3 = 0 THEN 'male' WHEN p_partkey % 3 = 1 THEN 'female' ELSE 'unisex' END AS target_demographic,
       'practical' AS utility_type,
       CASE WHEN p_size % 2 = 0 THEN 'durable' ELSE 'consumable' END AS durability,
       'individual' AS usage_type,
       x.l_last AS classified_at,
       CASE WHEN p_partkey % 7 = 0 THEN 'pending_classification' WHEN p_partkey % 7 = 1 THEN 'error_openai_api'
            WHEN p_partkey % 7 = 2 THEN 'failed' ELSE 'success' END AS classification_status
FROM part LEFT JOIN (SELECT l_partkey, MAX(l_shipdate) AS l_last FROM lineitem GROUP BY l_partkey) x
     ON p_partkey = x.l_partkey"""

FIXTURES["fx_requests"] = """
SELECT e.company_cvr || '-' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS VARCHAR) AS request_id,
       e.company_cvr AS cvr, CAST(e.male_count AS INTEGER) AS male_count,
       CAST(e.female_count AS INTEGER) AS female_count, c.gift_id AS product_id,
       CASE WHEN p_partkey % 3 = 0 THEN p_name || ' Pizza' WHEN p_partkey % 3 = 1 THEN p_name || ' toiletry BAG'
            ELSE p_name END AS description
FROM fx_employees e JOIN fx_catalog c ON c.shop_id = 'shop' || e.branch_code
     JOIN part ON c.gift_id = CAST(p_partkey AS VARCHAR)"""

FIXTURES["fx_names"] = """
SELECT c_custkey AS employee_id, CAST(10000000 + c_nationkey AS VARCHAR) AS company_cvr,
       CASE c_custkey % 8 WHEN 0 THEN 'FREJA HANSEN' WHEN 1 THEN 'bo jensen' WHEN 2 THEN 'Anne-Marie Hansen'
            WHEN 3 THEN 'Magnus Ebenstrand' WHEN 4 THEN ' clara  Lund ' WHEN 5 THEN 'John Doe'
            WHEN 6 THEN 'Andy Kim' ELSE '' END AS name
FROM customer"""

FIXTURES["fx_general_names"] = """
SELECT * FROM (VALUES ('Anne-Marie', 'any', 'female'), ('John', 'any', 'male'),
                      ('Andy', 'any', 'andy'), ('Magnus', 'any', 'mostly_male')) t(name, country, label)"""

FIXTURES["fx_registry"] = """
SELECT CAST(10000000 + n_nationkey AS VARCHAR) AS cvr,
       CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END
           AS industry_code
FROM nation"""

FIXTURES["fx_actuals"] = """
SELECT CAST(10000000 + c_nationkey AS VARCHAR) AS cvr, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(COUNT(*) AS BIGINT) AS order_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2"""

_NAME_RE = re.compile(r"\bfx_[a-z_0-9]+\b")


def _deps(name: str) -> list[str]:
    return [d for d in dict.fromkeys(_NAME_RE.findall(FIXTURES[name])) if d != name]


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs (fixtures and ``extra`` named CTEs) it uses."""
    defs = dict(FIXTURES)
    defs.update(extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in dict.fromkeys(_NAME_RE.findall(defs[n])):
            if d != n and d in defs:
                visit(d)
        order.append(n)

    for n in dict.fromkeys(_NAME_RE.findall(sql)):
        if n in defs:
            visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"

_FAULT = "CAST(floor(CAST(s.gift_id AS BIGINT) / 3) AS BIGINT) % 4"


def _damaged(c: str) -> str:
    shown = f"upper(s.{c})" if c == "employee_gender" else f"s.{c}"
    quoted = f"'\" ' || chr(9) || {shown} || ' \"'"
    if c == "company_cvr":
        return f"CASE {_FAULT} WHEN 0 THEN '99' || substring(s.{c}, 3, 6) ELSE s.{c} END AS {c}"
    if c == "gift_id":
        return f"CASE {_FAULT} WHEN 3 THEN NULL ELSE s.{c} END AS {c}"
    if c == "employee_gender":
        return f"CASE {_FAULT} WHEN 1 THEN ' unisex ' WHEN 2 THEN {quoted} ELSE s.{c} END AS {c}"
    if c in ("shop_id", "product_brand", "product_main_category"):
        return f"CASE {_FAULT} WHEN 2 THEN {quoted} ELSE s.{c} END AS {c}"
    return f"s.{c}"


FIXTURES["fx_damaged"] = ("SELECT * FROM fx_selections UNION ALL SELECT " + ", ".join(map(_damaged, _SEL_COLS))
                         + ", s.event_seq FROM fx_selections s WHERE CAST(s.gift_id AS BIGINT) % 3 = 0")
FIXTURES["fx_damaged_clean"] = FIXTURES["fx_sel_clean"].replace("fx_selections", "fx_damaged")
FIXTURES["fx_damaged_groups"] = FIXTURES["fx_groups"].replace("fx_sel_clean", "fx_damaged_clean")
FIXTURES["fx_emp_twice"] = """
SELECT * FROM fx_emp_clean UNION ALL
SELECT company_cvr, branch_code, male_count + 3, female_count + 1 FROM fx_emp_clean WHERE CAST(company_cvr AS BIGINT) % 5 = 0"""
FIXTURES["fx_universe_twice"] = FIXTURES["fx_universe"].replace("fx_emp_clean", "fx_emp_twice")
FIXTURES["fx_zero_twice"] = FIXTURES["fx_zero"].replace("fx_universe", "fx_universe_twice")
FIXTURES["fx_training_twice"] = "SELECT * FROM fx_selected UNION ALL SELECT * FROM fx_zero_twice"
FIXTURES["fx_name_requests"] = """
SELECT 'company-' || company_cvr AS request_id, name FROM fx_names
UNION ALL SELECT 'digit-' || substring(CAST(employee_id AS VARCHAR), 1, 1), name FROM fx_names
UNION ALL SELECT 'empty-' || CAST(r_regionkey AS VARCHAR), NULL FROM region"""
