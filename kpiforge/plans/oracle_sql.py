"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Each department frame is one CTE that mirrors ``kpiforge.sources.testbed``;
each query reads the driver's tables (pre-registered views) through it.
"""

from __future__ import annotations

SC = """sc AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number,
         p.p_name AS item, p.p_type AS category, s.s_name AS supplier,
         l.l_quantity AS quantity,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS unit_cost,
         l.l_extendedprice AS total_cost,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS delivery_date,
         o.o_orderstatus AS status,
         date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS dd
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

IT = """it AS (
  SELECT event_id AS ticket_id, event_type AS system,
         event_type || '-' || CAST(((user_id % 8) + 8) % 8 AS VARCHAR) AS issue,
         ts AS reported_at, value AS hours,
         (['Closed', 'Escalated', 'In Progress', 'Pending', 'Resolved'])[
           ((CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) % 5 + 5) % 5) + 1
         ] AS status
  FROM events)"""

RATE = "AVG(CAST(COALESCE({cond}, false) AS DOUBLE)) * 100.0"

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- supply chain
SQL["sc1_metrics"] = f"""WITH {SC}
SELECT ROUND(SUM(total_cost), 2) AS total_cost,
       ROUND(AVG(dd), 2) AS avg_delay,
       ROUND({RATE.format(cond='dd <= 0')}, 2) AS on_time_delivery,
       COUNT(*) AS total_orders,
       ROUND(SUM(total_cost) / COUNT(*), 2) AS avg_order_value
FROM sc"""

SQL["sc2_cost_distributions"] = f"""WITH {SC}
SELECT 'category_costs' AS section, category AS key, ROUND(SUM(total_cost), 2) AS total_cost
FROM sc WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'supplier_costs', supplier, ROUND(SUM(total_cost), 2)
FROM sc WHERE supplier IS NOT NULL GROUP BY supplier"""

SQL["sc3_monthly_trends"] = f"""WITH {SC}
SELECT strftime(order_date, '%Y-%m') AS month,
       ROUND(SUM(total_cost), 2) AS monthly_cost,
       ROUND(AVG(dd), 6) AS monthly_delay
FROM sc WHERE order_date IS NOT NULL GROUP BY 1"""

SQL["sc4_supplier_performance"] = f"""WITH {SC}
SELECT supplier, ROUND(AVG(dd), 6) AS avg_delay, ROUND(SUM(total_cost), 2) AS total_cost,
       ROUND(AVG(CAST(COALESCE(status = 'F', false) AS DOUBLE)), 6) AS completion_rate
FROM sc WHERE supplier IS NOT NULL GROUP BY supplier"""

SQL["sc5_analysis"] = f"""WITH {SC},
w AS (SELECT category, AVG(dd) AS d FROM sc WHERE category IS NOT NULL
      GROUP BY category ORDER BY d DESC, category ASC LIMIT 1),
c AS (SELECT AVG(total_cost) AS m, MEDIAN(total_cost) AS med FROM sc),
r AS (SELECT {RATE.format(cond='dd <= 0')} AS r FROM sc)
SELECT printf('%s (%.1f days)', w.category, w.d) AS worst_performing_category,
       format('{{}} (${{:,.2f}})', CASE WHEN c.m > c.med THEN 'High' ELSE 'Low' END, c.m)
         AS cost_efficiency,
       printf('%s (%.1f%%)', CASE WHEN r.r >= 90 THEN 'Good' ELSE 'Needs Improvement' END, r.r)
         AS delivery_performance
FROM w, c, r"""

SQL["sc6_recent_orders"] = f"""WITH {SC}
SELECT strftime(order_date, '%Y-%m-%d') AS date, category,
       concat_ws(' - ', item, supplier) AS description,
       ROUND(total_cost, 2) AS amount, status
FROM sc
WHERE order_date IS NOT NULL
ORDER BY order_date DESC, order_key, line_number
LIMIT 10"""

# ---------------------------------------------------------------- IT support
SQL["it1_metrics"] = f"""WITH {IT}
SELECT COUNT(*) AS total_tickets, ROUND(AVG(hours), 6) AS avg_resolution_time,
       ROUND({RATE.format(cond='hours <= 1')}, 6) AS first_call_resolution,
       CAST(99.9 AS DOUBLE) AS system_uptime
FROM it"""

SQL["it2_distributions"] = f"""WITH {IT}
SELECT 'ticket_types' AS section, issue AS key, COUNT(*) AS n FROM it
WHERE issue IS NOT NULL GROUP BY issue
UNION ALL SELECT 'systems', system, COUNT(*) FROM it WHERE system IS NOT NULL GROUP BY system
UNION ALL SELECT 'status', status, COUNT(*) FROM it WHERE status IS NOT NULL GROUP BY status"""

SQL["it3_monthly_trends"] = f"""WITH {IT}
SELECT CAST(month(reported_at) AS INTEGER) AS month, ROUND(AVG(hours), 6) AS avg_resolution_time
FROM it WHERE reported_at IS NOT NULL GROUP BY 1"""

SQL["it4_performance"] = f"""WITH {IT}
SELECT 'by_system' AS section, system AS key, ROUND(AVG(hours), 6) AS avg_resolution_time
FROM it WHERE system IS NOT NULL GROUP BY system
UNION ALL
SELECT 'by_issue', issue, ROUND(AVG(hours), 6) FROM it WHERE issue IS NOT NULL GROUP BY issue"""

SQL["it5_recent_tickets"] = f"""WITH {IT}
SELECT ticket_id, system, issue, strftime(reported_at, '%Y-%m-%d %H:%M:%S') AS reported_date,
       hours, status
FROM it ORDER BY reported_at DESC, ticket_id ASC LIMIT 10"""

SQL["it6_insights"] = f"""WITH {IT},
b AS (SELECT AVG(hours) AS a, {RATE.format(cond='hours <= 1')} AS f FROM it),
t AS (SELECT issue FROM it WHERE issue IS NOT NULL GROUP BY issue
      ORDER BY COUNT(*) DESC, issue ASC LIMIT 1)
SELECT 1 AS idx, printf('Average resolution time is %.1f hours', a) AS insight FROM b
UNION ALL SELECT 2, printf('First call resolution rate is %.1f%%', f) FROM b
UNION ALL SELECT 3, 'Most common issue is ' || issue FROM t"""

# ---------------------------------------------------------------- production
PR = """pr AS (
  SELECT concat_ws('-', l.l_orderkey, l.l_linenumber) AS production_id, p.p_type AS product,
         l.l_quantity AS units, l.l_quantity * l.l_discount AS defects,
         l.l_linestatus AS line, l.l_returnflag AS shift,
         100.0 * (1.0 - l.l_tax) AS utilization, CAST(l.l_shipdate AS DATE) AS date,
         (l.l_quantity - l.l_quantity * l.l_discount) / NULLIF(l.l_quantity, 0) * 100.0 AS eff
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

SQL["pr1_metrics"] = f"""WITH {PR}
SELECT COUNT(*) AS total_operations, ROUND(AVG(eff), 6) AS avg_efficiency,
       ROUND(AVG(eff), 6) AS avg_quality_score, ROUND(AVG(utilization), 6) AS avg_machine_utilization
FROM pr"""

SQL["pr2_distributions"] = f"""WITH {PR}
SELECT 'product_lines' AS section, product AS key, COUNT(*) AS n FROM pr
WHERE product IS NOT NULL GROUP BY product
UNION ALL SELECT 'production_lines', line, COUNT(*) FROM pr WHERE line IS NOT NULL GROUP BY line
UNION ALL SELECT 'shifts', shift, COUNT(*) FROM pr WHERE shift IS NOT NULL GROUP BY shift"""

SQL["pr3_monthly_trends"] = f"""WITH {PR}
SELECT CAST(month(date) AS INTEGER) AS month, ROUND(AVG(eff), 6) AS avg_efficiency
FROM pr WHERE date IS NOT NULL GROUP BY 1"""

SQL["pr4_performance"] = f"""WITH {PR}
SELECT 'by_product' AS section, product AS key, ROUND(AVG(eff), 6) AS avg_efficiency
FROM pr WHERE product IS NOT NULL GROUP BY product
UNION ALL SELECT 'by_line', line, ROUND(AVG(eff), 6) FROM pr WHERE line IS NOT NULL GROUP BY line
UNION ALL SELECT 'by_shift', shift, ROUND(AVG(eff), 6) FROM pr WHERE shift IS NOT NULL GROUP BY shift"""

SQL["pr5_recent_operations"] = f"""WITH {PR}
SELECT strftime(date, '%Y-%m-%d') AS date, production_id, product, line, shift, units,
       ROUND(defects, 6) AS defects, ROUND(eff, 6) AS efficiency_rate,
       ROUND(eff, 6) AS quality_score
FROM pr WHERE date IS NOT NULL
ORDER BY pr.date DESC, production_id, product, line, shift, units, ROUND(defects, 6)
LIMIT 10"""

SQL["pr6_insights"] = f"""WITH {PR},
b AS (SELECT AVG(eff) AS e, AVG(utilization) AS u FROM pr),
t AS (SELECT product FROM pr WHERE product IS NOT NULL GROUP BY product
      ORDER BY AVG(eff) DESC, product ASC LIMIT 1)
SELECT 1 AS idx, printf('Average efficiency rate is %.1f%%', e) AS insight FROM b
UNION ALL SELECT 2, printf('Average quality score is %.1f%%', e) FROM b
UNION ALL SELECT 3, printf('Average machine utilization is %.1f%%', u) FROM b
UNION ALL SELECT 4, 'Most efficient product is ' || product FROM t"""

# ---------------------------------------------------------------- sales
SA = """sa AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number, p.p_name AS product,
         r.r_name AS region, s.s_name AS salesperson, CAST(o.o_orderdate AS DATE) AS date,
         l.l_extendedprice * (1 - l.l_discount) AS revenue, l.l_quantity AS units
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SA_GROUPED = """g AS (
  SELECT 'top_products' AS section, product AS key, SUM(revenue) AS rev FROM sa
  WHERE product IS NOT NULL GROUP BY product
  UNION ALL SELECT 'top_regions', region, SUM(revenue) FROM sa
  WHERE region IS NOT NULL GROUP BY region
  UNION ALL SELECT 'top_salespersons', salesperson, SUM(revenue) FROM sa
  WHERE salesperson IS NOT NULL GROUP BY salesperson),
ranked AS (
  SELECT section, key, rev,
         CAST(row_number() OVER (PARTITION BY section ORDER BY rev DESC, key ASC) AS INTEGER) AS rank
  FROM g)"""

SQL["sa1_metrics"] = f"""WITH {SA}
SELECT ROUND(SUM(revenue), 2) AS total_sales, ROUND(SUM(units), 2) AS total_units,
       ROUND(CASE WHEN SUM(units) > 0 THEN SUM(revenue) / SUM(units) ELSE 0.0 END, 6)
         AS avg_unit_price,
       COUNT(*) AS num_transactions
FROM sa"""

SQL["sa2_distributions"] = f"""WITH {SA}
SELECT 'by_product' AS section, product AS key, COUNT(*) AS n FROM sa
WHERE product IS NOT NULL GROUP BY product
UNION ALL SELECT 'by_region', region, COUNT(*) FROM sa WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT 'by_salesperson', salesperson, COUNT(*) FROM sa
WHERE salesperson IS NOT NULL GROUP BY salesperson"""

SQL["sa3_monthly_trends"] = f"""WITH {SA}
SELECT strftime(date, '%Y-%m') AS month, ROUND(SUM(revenue), 2) AS revenue FROM sa
WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1"""

SQL["sa4_top_performers"] = f"""WITH {SA}, {SA_GROUPED}
SELECT section, key, ROUND(rev, 2) AS revenue, rank FROM ranked WHERE rank <= 5"""

SQL["sa5_recent_sales"] = f"""WITH {SA}
SELECT strftime(date, '%Y-%m-%d') AS date, product, region, salesperson,
       ROUND(revenue, 2) AS revenue, units
FROM sa WHERE date IS NOT NULL
ORDER BY sa.date DESC, order_key, line_number
LIMIT 10"""

SQL["sa6_insights"] = f"""WITH {SA}, {SA_GROUPED},
b AS (SELECT SUM(revenue) AS r, SUM(units) AS u,
             CASE WHEN SUM(units) > 0 THEN SUM(revenue) / SUM(units) ELSE 0.0 END AS p,
             COUNT(*) AS n FROM sa)
SELECT 1 AS idx, printf('Total sales revenue: $%.2f', r) AS insight FROM b
UNION ALL SELECT 2, printf('Total units sold: %d', CAST(ROUND(u, 0) AS BIGINT)) FROM b
UNION ALL SELECT 3, printf('Average unit price: $%.2f', p) FROM b
UNION ALL SELECT 4, printf('Number of transactions: %d', n) FROM b
UNION ALL SELECT 5, 'Top selling product: ' || key FROM ranked
  WHERE section = 'top_products' AND rank = 1
UNION ALL SELECT 6, 'Top performing region: ' || key FROM ranked
  WHERE section = 'top_regions' AND rank = 1
UNION ALL SELECT 7, 'Top salesperson: ' || key FROM ranked
  WHERE section = 'top_salespersons' AND rank = 1"""

# ---------------------------------------------------------------- order grain
OF = """of AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderpriority,
         COUNT(*) AS f_lines,
         AVG(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)))
           AS f_delivery_days,
         AVG(CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) <= 0
                  AS DOUBLE)) * 100.0 AS f_on_time_rate,
         COUNT(*) FILTER (WHERE date_diff('day', CAST(o.o_orderdate AS DATE),
                                          CAST(l.l_shipdate AS DATE)) > 0) AS f_late_lines,
         COUNT(*) FILTER (WHERE l.l_returnflag = 'R') AS f_returned_lines,
         SUM(l.l_quantity) AS f_quantity, SUM(l.l_extendedprice * l.l_tax) AS f_tax
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderpriority)"""

TR_ONLY = """tr AS (
  SELECT of.o_orderkey AS employee_id, c.c_mktsegment AS role,
         CAST(of.o_orderdate AS DATE) AS entry_date, f_lines AS deliveries,
         f_delivery_days AS delivery_time, o_orderpriority AS vehicle,
         CAST(((o_custkey % 10) + 10) % 10 + 1 AS INTEGER) AS condition,
         f_quantity AS fuel, f_tax AS maintenance, f_on_time_rate AS on_time_rate,
         f_returned_lines AS incidents
  FROM of LEFT JOIN customer c ON of.o_custkey = c.c_custkey)"""
TR = OF + ",\n" + TR_ONLY

SQL["tr1_metrics"] = f"""WITH {TR}
SELECT CAST(SUM(deliveries) AS BIGINT) AS total_deliveries,
       ROUND(AVG(delivery_time), 1) AS avg_delivery_time,
       ROUND(AVG(on_time_rate), 1) AS avg_on_time_rate,
       CAST(SUM(incidents) AS BIGINT) AS total_incidents
FROM tr"""

SQL["tr2_distributions"] = f"""WITH {TR}
SELECT 'vehicle_types' AS section, vehicle AS key, COUNT(*) AS n FROM tr
WHERE vehicle IS NOT NULL GROUP BY vehicle
UNION ALL SELECT 'roles', role, COUNT(*) FROM tr WHERE role IS NOT NULL GROUP BY role"""

SQL["tr3_by_vehicle"] = f"""WITH {TR}
SELECT vehicle, ROUND(AVG(delivery_time), 6) AS avg_delivery_time FROM tr
WHERE vehicle IS NOT NULL GROUP BY vehicle"""

SQL["tr4_monthly_deliveries"] = f"""WITH {TR}
SELECT strftime(entry_date, '%Y-%m') AS month, CAST(SUM(deliveries) AS BIGINT) AS deliveries
FROM tr WHERE entry_date IS NOT NULL GROUP BY 1"""

SQL["tr5_insights"] = f"""WITH {TR},
m AS (SELECT ROUND(AVG(delivery_time), 1) AS t, ROUND(AVG(on_time_rate), 1) AS r,
             CAST(SUM(incidents) AS BIGINT) AS i FROM tr)
SELECT 1 AS idx, 'Vehicle Performance' AS title,
       printf('Average delivery time is %.1f hours with %.1f%% on-time rate.', t, r) AS description,
       'High' AS impact, 'Improving' AS trend FROM m
UNION ALL SELECT 2, 'Incident Analysis',
       printf('Total incidents reported: %d. Focus on preventive maintenance.', i),
       'Medium', 'Stable' FROM m
UNION ALL SELECT 3, 'Fleet Utilization',
       'Analyze vehicle type distribution for optimal resource allocation.',
       'High', 'Increasing' FROM m"""

SQL["tr6_monthly_service"] = f"""WITH {TR}
SELECT strftime(entry_date, '%Y-%m') AS month, ROUND(AVG(delivery_time), 6) AS avg_delivery_time,
       ROUND(AVG(on_time_rate), 6) AS avg_on_time_rate
FROM tr WHERE entry_date IS NOT NULL GROUP BY 1"""

# ---------------------------------------------------------------- HR
HR_ONLY = """cf AS (
  SELECT o_custkey, COUNT(*) AS h_orders, MIN(o_orderdate) AS h_first_order,
         SUM(f_lines) AS h_lines,
         SUM(f_late_lines) AS h_late_lines, SUM(f_returned_lines) AS h_returned_lines
  FROM of GROUP BY o_custkey),
hr AS (
  SELECT cf.o_custkey AS employee_id, c.c_mktsegment AS department, n.n_name AS position,
         c.c_acctbal AS salary, CAST(h_first_order AS DATE) AS hired, h_orders AS performance,
         CAST(h_lines AS BIGINT) AS training_hours, CAST(h_late_lines AS BIGINT) AS leave_days,
         CAST(h_returned_lines AS BIGINT) AS overtime_hours,
         CAST(c.c_acctbal < 0 AS INTEGER) AS resigned
  FROM cf LEFT JOIN customer c ON cf.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
HR = OF + ",\n" + HR_ONLY

SQL["hr1_metrics"] = f"""WITH {HR}
SELECT COUNT(*) AS total_employees,
       ROUND(AVG(training_hours + overtime_hours - leave_days), 6) AS avg_tenure,
       ROUND(AVG(training_hours), 6) AS training_completion,
       ROUND(AVG(performance), 6) AS satisfaction_score
FROM hr"""

SQL["hr2_distributions"] = f"""WITH {HR}
SELECT 'departments' AS section, department AS key, COUNT(*) AS n FROM hr
WHERE department IS NOT NULL GROUP BY department
UNION ALL SELECT 'performance', CAST(performance AS VARCHAR), COUNT(*) FROM hr
WHERE performance IS NOT NULL GROUP BY performance"""

SQL["hr3_department_insights"] = f"""WITH {HR}
SELECT department, ROUND(AVG(performance), 6) AS avg_performance,
       ROUND(AVG(resigned), 6) AS attrition_rate
FROM hr WHERE department IS NOT NULL GROUP BY department"""

SQL["hr4_top_performers"] = f"""WITH {HR}
SELECT employee_id, department, position, CAST(performance AS DOUBLE) AS performance_score
FROM hr ORDER BY performance DESC, employee_id ASC LIMIT 5"""

SQL["hr5_training_recommendations"] = f"""WITH {HR}
SELECT employee_id, department, position, CAST(performance AS DOUBLE) AS performance_score,
       CAST(training_hours AS DOUBLE) AS training_hours
FROM hr
WHERE performance < (SELECT AVG(performance) FROM hr)
  AND leave_days > (SELECT AVG(leave_days) FROM hr)"""

SQL["hr5_recommendation_split"] = f"""WITH {HR},
f AS (SELECT performance < (SELECT AVG(performance) FROM hr)
             AND leave_days > (SELECT AVG(leave_days) FROM hr) AS rec FROM hr)
SELECT COUNT(*) FILTER (WHERE rec) AS recommended,
       COUNT(*) - COUNT(*) FILTER (WHERE rec) AS others
FROM f"""

SQL["hr6_training_effectiveness"] = f"""WITH {HR},
g AS (SELECT training_hours, AVG(performance) AS mp FROM hr GROUP BY training_hours)
SELECT ROUND(corr(CAST(training_hours AS DOUBLE), mp), 6) AS effectiveness FROM g"""

SQL["hr7_insight_records"] = f"""WITH {HR},
g AS (SELECT training_hours, AVG(performance) AS mp FROM hr GROUP BY training_hours),
e AS (SELECT corr(CAST(training_hours AS DOUBLE), mp) AS c FROM g),
b AS (SELECT AVG(performance) AS p FROM hr)
SELECT 1 AS idx, 'Performance Analysis' AS title,
       printf('Average performance score is %.2f', p) AS description,
       'High' AS impact, 'Stable' AS trend FROM b
UNION ALL SELECT 2, 'Training Impact', printf('Training effectiveness correlation: %.2f', c),
       'Medium', 'Improving' FROM e"""

SQL["hr8_days_since_hired"] = f"""WITH {HR}
SELECT employee_id, strftime(hired, '%Y-%m-%d') AS hired,
       CAST(date_diff('day', hired, DATE '2025-05-20') AS INTEGER) AS days_since_hired
FROM hr"""

# ---------------------------------------------------------------- marketing
MK = """cp AS (
  SELECT o.o_orderpriority AS campaign_type, c.c_mktsegment AS channel,
         strftime(o.o_orderdate, '%Y-%m') AS month,
         CAST(MIN(o.o_orderdate) AS DATE) AS start_date,
         CAST(MAX(o.o_orderdate) AS DATE) AS end_date,
         SUM(ABS(c.c_acctbal)) AS budget, COUNT(*) AS leads,
         AVG(CAST(o.o_orderstatus = 'F' AS DOUBLE)) * 100.0 AS conversion_rate,
         SUM(o.o_totalprice) AS revenue
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2, 3),
mk AS (SELECT *, concat_ws('|', campaign_type, channel, month) AS campaign_id FROM cp)"""

SQL["mk1_metrics"] = f"""WITH {MK}
SELECT COUNT(*) AS total_campaigns, ROUND(AVG(conversion_rate), 6) AS conversion_rate,
       ROUND(SUM(budget) / SUM(leads * conversion_rate / 100.0), 6) AS acquisition_cost,
       ROUND((SUM(revenue) - SUM(budget)) / SUM(budget) * 100.0, 6) AS roi
FROM mk"""

SQL["mk2_performance"] = f"""WITH {MK}
SELECT 'campaign_performance' AS section, campaign_type AS key,
       ROUND(SUM(budget), 2) AS budget, CAST(SUM(leads) AS BIGINT) AS leads,
       ROUND(SUM(revenue), 2) AS revenue,
       ROUND((SUM(revenue) - SUM(budget)) / SUM(budget) * 100.0, 6) AS roi
FROM mk WHERE campaign_type IS NOT NULL GROUP BY campaign_type
UNION ALL
SELECT 'channel_effectiveness', channel, ROUND(SUM(budget), 2), CAST(SUM(leads) AS BIGINT),
       ROUND(SUM(revenue), 2), ROUND((SUM(revenue) - SUM(budget)) / SUM(budget) * 100.0, 6)
FROM mk WHERE channel IS NOT NULL GROUP BY channel"""

SQL["mk3_recent_campaigns"] = f"""WITH {MK}
SELECT campaign_id, campaign_type, channel, strftime(start_date, '%Y-%m-%d') AS start_date,
       ROUND(budget, 2) AS budget, leads, ROUND(conversion_rate, 2) AS conversion_rate,
       ROUND(revenue, 2) AS revenue
FROM mk ORDER BY mk.start_date DESC, campaign_id ASC LIMIT 10"""

# ---------------------------------------------------------------- what-if
def _whatif_sql() -> str:
    from kpiforge.operators import whatif as W
    from kpiforge.plans.whatif import DEFAULT_PCTS

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    coef = ",\n    ".join(f"({q(d)}, {q(m)}, {a}, {q(e1)}, {b}, {q(e2)})"
                           for d, m, a, e1, b, e2, _ in W.COEFFICIENTS)
    base = ",\n    ".join(f"({q(m)}, {v}, {q(u)})" for m, (v, u) in W.BASE_VALUES.items())
    pcts = ", ".join(f"{float(p)}" for p in DEFAULT_PCTS)
    rate_it = RATE.format(cond="hours <= 1")
    rate_sc = RATE.format(cond="dd <= 0")
    return f"""WITH {SC}, {IT}, {PR}, {SA}, {OF}, {TR_ONLY}, {HR_ONLY}, {MK},
kpi AS (
  SELECT 'it' AS department, 'delivery_time' AS metric, ROUND(AVG(hours), 6) AS current FROM it
  UNION ALL SELECT 'it', 'efficiency', ROUND({rate_it}, 6) FROM it
  UNION ALL SELECT 'production', 'efficiency', ROUND(AVG(eff), 6) FROM pr
  UNION ALL SELECT 'production', 'quality', ROUND(AVG(eff), 6) FROM pr
  UNION ALL SELECT 'supply_chain', 'cost', ROUND(SUM(total_cost) / COUNT(*), 2) FROM sc
  UNION ALL SELECT 'supply_chain', 'efficiency', ROUND({rate_sc}, 6) FROM sc
  UNION ALL SELECT 'transport', 'delivery_time', ROUND(AVG(delivery_time), 6) FROM tr
  UNION ALL SELECT 'transport', 'efficiency', ROUND(AVG(on_time_rate), 6) FROM tr
  UNION ALL SELECT 'sales', 'revenue', ROUND(SUM(revenue), 2) FROM sa
  UNION ALL SELECT 'sales', 'discount', ROUND(AVG(l_discount), 6) FROM lineitem
  UNION ALL SELECT 'warehouse', 'cost', ROUND(AVG(l_tax), 6) FROM lineitem
  UNION ALL SELECT 'hr', 'productivity', ROUND(AVG(performance), 6) FROM hr
  UNION ALL SELECT 'marketing', 'revenue', ROUND(SUM(revenue), 2) FROM mk),
coef(department, metric, m1, effect1, m2, effect2) AS (VALUES
    {coef}),
base(metric, base_value, unit) AS (VALUES
    {base}),
pairs AS (SELECT department, metric FROM coef UNION SELECT department, metric FROM kpi),
grid AS (SELECT department, metric, unnest([{pcts}]) AS pct FROM pairs),
j AS (
  SELECT g.department, g.metric, g.pct,
         CASE WHEN g.department IN (SELECT department FROM coef) THEN g.department ELSE 'it' END
           AS lookup_department
  FROM grid g),
v AS (
  SELECT j.department, j.metric, j.pct, c.effect1, c.m1, c.effect2, c.m2,
         COALESCE(k.current, b.base_value, 100.0) AS cur, COALESCE(b.unit, '') AS unit
  FROM j
  LEFT JOIN coef c ON c.department = j.lookup_department AND c.metric = j.metric
  LEFT JOIN base b ON b.metric = j.metric
  LEFT JOIN kpi k ON k.department = j.department AND k.metric = j.metric)
SELECT department, metric, pct, cur AS current,
       cur * (1.0 + pct / 100.0) AS projected, unit,
       unit || printf('%.1f', cur * (1.0 + pct / 100.0)) AS projected_text,
       effect1, ROUND(ABS(pct * m1), 6) AS effect1_pct,
       CASE WHEN m1 IS NOT NULL THEN CASE WHEN pct >= 0 THEN 'increase' ELSE 'decrease' END END AS effect1_direction,
       effect2, ROUND(ABS(pct * m2), 6) AS effect2_pct,
       CASE WHEN m2 IS NOT NULL THEN CASE WHEN pct >= 0 THEN 'increase' ELSE 'decrease' END END AS effect2_direction,
       CASE WHEN pct >= 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN pct > 0 THEN printf('+%.1f%%', pct) ELSE printf('%.1f%%', pct) END AS change_text
FROM v"""


SQL["wi1_projection"] = _whatif_sql()

# ---------------------------------------------------------------- models (deterministic)
SPLIT = "(CAST(('0x' || substr(md5(CAST({id} AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) % 100 < 80)"

SQL["ml1_label_codes"] = f"""WITH {HR}
SELECT employee_id, position, department,
       CAST(DENSE_RANK() OVER (ORDER BY position) - 1 AS INTEGER) AS position_code,
       CAST(DENSE_RANK() OVER (ORDER BY department) - 1 AS INTEGER) AS department_code
FROM hr"""

_Z = ["salary", "performance", "training_hours", "leave_days", "overtime_hours", "active_time"]
SQL["ml3_hr_zscores"] = f"""WITH {HR},
h AS (SELECT *, training_hours + overtime_hours - leave_days AS active_time FROM hr)
SELECT employee_id, """ + ",\n       ".join(
    f"ROUND((CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 6) AS z_{c}"
    for c in _Z) + "\nFROM h"

SQL["ml4_split_counts"] = f"""SELECT CASE WHEN {SPLIT.format(id='o_orderkey')}
            THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n
FROM orders GROUP BY 1"""

SQL["ml10_it_baseline_metrics"] = f"""WITH {IT},
d AS (SELECT *, {SPLIT.format(id='ticket_id')} AS train FROM it),
m AS (SELECT system, AVG(hours) AS prediction FROM d WHERE train GROUP BY system),
t AS (SELECT d.hours, COALESCE(m.prediction, 0.0) AS prediction
      FROM d LEFT JOIN m ON d.system = m.system WHERE NOT d.train)
SELECT ROUND(AVG((hours - prediction) * (hours - prediction)), 6) AS mse,
       ROUND(1.0 - SUM((hours - prediction) * (hours - prediction))
             / (VAR_POP(hours) * COUNT(*)), 6) AS r2,
       COUNT(*) AS n
FROM t"""

SQL["ml9_supply_baseline_report"] = f"""WITH {SC},
d AS (SELECT category, CAST(dd > 0 AS INTEGER) AS label,
             {SPLIT.format(id="concat_ws('-', order_key, line_number)")} AS train FROM sc),
r AS (SELECT category, AVG(label) AS r FROM d WHERE train GROUP BY category),
t AS (SELECT d.label, COALESCE(CAST(r.r > 0.5 AS INTEGER), 0) AS prediction
      FROM d LEFT JOIN r ON d.category = r.category WHERE NOT d.train),
cm AS (SELECT label AS actual, prediction AS predicted, COUNT(*) AS n FROM t GROUP BY 1, 2),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
per AS (
  SELECT c,
         COALESCE((SELECT SUM(n) FROM cm WHERE actual = c), 0) AS support,
         COALESCE((SELECT SUM(n) FROM cm WHERE predicted = c), 0) AS pred,
         COALESCE((SELECT SUM(n) FROM cm WHERE actual = c AND predicted = c), 0) AS tp
  FROM cls),
p AS (
  SELECT c, support, tp,
         CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0
                     THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p)
SELECT CAST(c AS VARCHAR) AS cls, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL
SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6),
       ROUND(SUM(tp) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL
SELECT 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6),
       CAST(SUM(support) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6),
       ROUND(SUM(recall * support) / SUM(support), 6),
       ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f"""


def _impacts_sql() -> str:
    from kpiforge.operators import whatif as W

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    full = _whatif_sql()
    kpi_ctes = full[:full.index("coef(department")].rstrip().rstrip(",")
    coef = ",\n    ".join(f"({q(d)}, {q(m)}, {list(imp)})"
                           for d, m, _, _, _, _, imp in W.COEFFICIENTS)
    labels = "[" + ", ".join(q(x) for x in W.IMPACT_LABELS) + "]"
    return f"""{kpi_ctes},
coef(department, metric, impacts) AS (VALUES
    {coef}),
grid AS (SELECT department, metric, current FROM kpi),
j AS (
  SELECT g.*, CASE WHEN g.department IN (SELECT department FROM coef) THEN g.department
                   ELSE 'it' END AS lk
  FROM grid g),
v AS (
  SELECT j.department, j.metric, j.current, COALESCE(c.impacts, {list(W.FALLBACK_IMPACTS)}) AS imp
  FROM j LEFT JOIN coef c ON c.department = j.lk AND c.metric = j.metric)
SELECT department, metric, CAST(t.i AS INTEGER) AS idx, ({labels})[t.i] AS impact_label,
       CAST(imp[t.i] AS INTEGER) AS impact, current, current * imp[t.i] / 100.0 AS impact_value
FROM v, range(1, 7) t(i)"""


SQL["wi3_kpi_impacts"] = _impacts_sql()


# ---------------------------------------------------------------- summaries
#: Sections of the summaries and the queries whose rows they hold.
SECTIONS = {
    "supply_chain": {"metrics": ["sc1_metrics"], "distributions": ["sc2_cost_distributions"],
                     "trends": ["sc3_monthly_trends"], "performance": ["sc4_supplier_performance"],
                     "analysis": ["sc5_analysis"], "recent_orders": ["sc6_recent_orders"]},
    "it": {"metrics": ["it1_metrics"], "distributions": ["it2_distributions"], "trends": ["it3_monthly_trends"],
           "performance": ["it4_performance"], "recent_tickets": ["it5_recent_tickets"],
           "insights": ["it6_insights"], "recommendations": 3},
    "production": {"metrics": ["pr1_metrics"], "distributions": ["pr2_distributions"],
                   "trends": ["pr3_monthly_trends"], "performance": ["pr4_performance"],
                   "recent_operations": ["pr5_recent_operations"], "insights": ["pr6_insights"],
                   "recommendations": 4},
    "sales": {"metrics": ["sa1_metrics"], "distributions": ["sa2_distributions"], "trends": ["sa3_monthly_trends"],
              "performance": ["sa4_top_performers"], "recent_sales": ["sa5_recent_sales"],
              "insights": ["sa6_insights"], "recommendations": 4},
    "transport": {"metrics": ["tr1_metrics"], "distributions": ["tr2_distributions"],
                  "performance": ["tr3_by_vehicle", "tr4_monthly_deliveries"], "trends": ["tr6_monthly_service"],
                  "insights": ["tr5_insights"], "recommendations": None},
    "hr": {"metrics": ["hr1_metrics"], "distributions": ["hr2_distributions"],
           "department_insights": ["hr3_department_insights"], "top_performers": ["hr4_top_performers"],
           "trends": ["hr6_training_effectiveness"], "insights": ["hr7_insight_records"],
           "recommendations": None, "training_recommendations": ["hr5_training_recommendations"]},
    "marketing": {"metrics": ["mk1_metrics"], "performance": ["mk2_performance"],
                  "recommendations": None, "recent_campaigns": ["mk3_recent_campaigns"]},
}


def _section_sizes_sql() -> str:
    from kpiforge.operators.insights import RECOMMENDATIONS

    rows = []
    for d, sections in SECTIONS.items():
        for s, names in sections.items():
            n = (" + ".join(f"(SELECT COUNT(*) FROM ({SQL[q]}))" for q in names) if isinstance(names, list)
                 else str(len(RECOMMENDATIONS.get(d, []))))
            rows.append(f"SELECT '{d}' AS department, '{s}' AS section, CAST({n} AS BIGINT) AS n")
    return "SELECT * FROM (\n" + "\nUNION ALL ".join(rows) + "\n) WHERE n > 0"


SQL["all3_summary_sections"] = _section_sizes_sql()
SQL["snk3_metrics_report"] = "\nUNION ALL ".join(
    f"SELECT '{d}' AS department, metric, ROUND(value, 4) AS value FROM "
    f"(UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL[s['metrics'][0]]})) ON COLUMNS(*) INTO NAME metric VALUE value)"
    for d, s in SECTIONS.items())

# ---------------------------------------------------------------- model results that SQL can check
SQL["ml11_supply_cluster_totals"] = "SELECT COUNT(*) AS clustered, CAST(0 AS BIGINT) AS empty, TRUE AS cheap, TRUE AS centred FROM lineitem"
SQL["ml14_supply_scatter_check"] = """SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, CAST(0 AS BIGINT) AS unclustered, TRUE AS separated
FROM lineitem WHERE l_quantity <> 0 AND l_extendedprice IS NOT NULL"""
SQL["ml15_supply_cost_scores"] = """SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS missing, TRUE AS in_range, TRUE AS accurate, TRUE AS unbiased
FROM lineitem"""
SQL["snk8_model_reuse"] = """SELECT step, what, reused, centres, CAST(fits AS BIGINT) AS fits, (SELECT COUNT(*) FROM lineitem) AS lines
FROM (VALUES (0, 'first', FALSE, 3, 1), (1, 'again', TRUE, 3, 1), (2, 'other partitions', TRUE, 3, 1), (3, 'other k', FALSE, 4, 2),
             (4, 'a line changed', FALSE, 3, 3), (5, 'first again', TRUE, 3, 3)) v(step, what, reused, centres, fits)"""


def _hash_sql(seed: int, parts: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST(employee_id AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT) % {parts}"


def _search_rows_sql() -> str:
    from kpiforge.ml.halving import FOLDS, PARTS, RUNGS

    rungs = ", ".join(f"({i}, CAST({s} AS DOUBLE))" for i, s in enumerate(RUNGS))
    return f"""{HR},
d AS (SELECT *, CAST({_hash_sql(43, FOLDS)} AS INTEGER) AS fold, {_hash_sql(44, PARTS)} AS part FROM hr WHERE {SPLIT.format(id='employee_id')}),
e AS (SELECT * FROM d JOIN (VALUES {rungs}) r(rung, share) ON part < ROUND(share * {PARTS}))"""


def _search_choice_sql() -> str:
    """Mean by one column over the other folds; r2 a fold; three, two, one candidates go on."""
    from kpiforge.plans.models import MEAN_BY

    by = ", ".join(f"CAST({c} AS VARCHAR)" for c in MEAN_BY)
    names = ", ".join(f"({i}, 'by={c}')" for i, c in enumerate(MEAN_BY))
    kept = "ROW_NUMBER() OVER (ORDER BY ROUND(score, 9) DESC NULLS LAST, c)"
    return f"""WITH {_search_rows_sql()},
g AS (SELECT rung, share, fold, CAST(performance AS DOUBLE) AS label, unnest(range({len(MEAN_BY)})) AS c, unnest([{by}]) AS v FROM e WHERE performance IS NOT NULL),
t AS (SELECT rung, c, v, fold, SUM(label) AS s, COUNT(*) AS n FROM g GROUP BY ALL),
o AS (SELECT rung, c, v, fold,
             CASE WHEN v IS NOT NULL THEN (SUM(s) OVER w - s) / NULLIF(SUM(n) OVER w - n, 0) END AS own,
             (SUM(s) OVER a - SUM(s) OVER f) / NULLIF(SUM(n) OVER a - SUM(n) OVER f, 0) AS overall
      FROM t WINDOW w AS (PARTITION BY rung, c, v), a AS (PARTITION BY rung, c), f AS (PARTITION BY rung, c, fold)),
p AS (SELECT g.*, COALESCE(own, overall) AS p FROM g JOIN o ON g.rung = o.rung AND g.c = o.c AND g.fold = o.fold AND g.v IS NOT DISTINCT FROM o.v),
x AS (SELECT rung, share, c, AVG(s) AS score FROM (
        SELECT rung, share, c, fold, 1.0 - SUM((label - p) * (label - p)) / (VAR_POP(label) * COUNT(*)) AS s FROM p GROUP BY ALL) GROUP BY ALL),
k0 AS (SELECT *, {kept} <= 3 AS kept FROM x WHERE rung = 0),
k1 AS (SELECT *, {kept} <= 2 AS kept FROM x WHERE rung = 1 AND c IN (SELECT c FROM k0 WHERE kept)),
k2 AS (SELECT *, {kept} <= 1 AS kept FROM x WHERE rung = 2 AND c IN (SELECT c FROM k1 WHERE kept))
SELECT rung, CAST(k.c AS INTEGER) AS candidate, params, share, ROUND(score, 6) AS score, kept
FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) k JOIN (VALUES {names}) y(c, params) ON k.c = y.c"""


def _side_sql(job: str, table: str, rid: str, label: str) -> str:
    side = SPLIT.format(id=rid)
    return f"""SELECT '{job}' AS job, COUNT(*) FILTER ({side}) AS n_train, COUNT(*) FILTER (NOT {side}) AS n_test,
       ROUND(AVG({label}) FILTER (NOT {side}), 4) AS test_mean,
       ROUND(VAR_POP({label}) FILTER (NOT {side}) / AVG(ABS({label})) FILTER (NOT {side}), 4) AS test_spread
FROM {table}"""


_LINE = "concat_ws('-', order_key, line_number)"
SQL["ml20_test_sides"] = f"WITH {SC}, {SA}, {IT}, {HR}\n" + "\nUNION ALL ".join([
    _side_sql("ml5_supply_delay", "sc", _LINE, "CAST(dd > 0 AS DOUBLE)"),
    _side_sql("ml6_supply_cost", "sc", _LINE, "total_cost"),
    _side_sql("ml6_sales_revenue", "sa", _LINE, "revenue"),
    _side_sql("ml6_it_resolution", "it", "ticket_id", "hours"),
    _side_sql("ml6_hr_performance", "hr", "employee_id", "CAST(performance AS DOUBLE)"),
    _side_sql("ml8_hr_attrition", "hr", "employee_id", "CAST(resigned AS DOUBLE)"),
    _side_sql("ml19_hr_salary", "hr", "employee_id", "salary")])
SQL["ml7_oversampled_counts"] = f"""WITH {HR},
t AS (SELECT resigned, COUNT(*) AS n FROM hr WHERE {SPLIT.format(id='employee_id')} AND resigned IS NOT NULL GROUP BY 1)
SELECT resigned, (SELECT MAX(n) FROM t) AS n, (SELECT MAX(n) FROM t) - n AS synthetic FROM t"""

SQL["ml8_search_folds"] = f"WITH {_search_rows_sql()} SELECT fold, share, COUNT(*) AS n FROM e GROUP BY ALL"
SQL["ml8_search_choice"] = _search_choice_sql()

# ---------------------------------------------------------------- operational records
SQL["jn3_audit_log"] = """SELECT event_id, c_name AS user_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at,
       TRY_CAST(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS amount
FROM events LEFT JOIN customer ON user_id = c_custkey"""
SQL["fn11_part_files"] = """WITH f AS (
  SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name || '/' || p_type), '[()]', '', 'g'), '[ /]', '_', 'g')
         || '.' || p_brand AS file FROM part)
SELECT p_partkey, file, lower(regexp_extract(file, '[^.]*$')) AS extension,
       CASE WHEN contains(p_name, '.') THEN lower(regexp_extract(p_name, '[^.]*$')) END AS no_extension FROM f"""
SQL["prj16_order_badges"] = """SELECT CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'warning' ELSE 'secondary' END AS badge,
       COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '5%' THEN 0 END) AS BIGINT) AS urgent
FROM orders GROUP BY 1"""
SQL["prj13_scoped_customers"] = """SELECT 'user' AS view, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'admin', COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer
UNION ALL SELECT 'nation 0', COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer WHERE c_nationkey = 0"""
SQL["ag9_event_types"] = "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL"
SQL["so3_last_events"] = "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 10"
SQL["src4_metrics_with_defaults"] = f"""WITH {IT}
SELECT 'all' AS frame, COUNT(*) AS total_tickets, ROUND(AVG(hours), 6) AS avg_resolution_time,
       CAST(4.2 AS DOUBLE) AS satisfaction FROM it
UNION ALL SELECT 'none', 0, 0.0, 4.2"""


def _hr_report_sql() -> str:
    from kpiforge.operators.insights import RECOMMENDATIONS

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    said = ", ".join(f"({i}, {quoted(r[0] + ': ' + r[1])})" for i, r in enumerate(RECOMMENDATIONS["hr"], 1))
    return f"""SELECT 'metrics' AS sheet, 0 AS position, metric AS name, ROUND(value, 4) AS value, NULL::VARCHAR AS insight, NULL::VARCHAR AS recommendation
FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL['hr1_metrics']})) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'analysis', COALESCE(i.idx, r.idx), NULL, NULL, i.title || ': ' || i.description, r.said
FROM ({SQL['hr7_insight_records']}) i FULL JOIN (VALUES {said}) r(idx, said) ON i.idx = r.idx"""


SQL["snk7_hr_report"] = _hr_report_sql()


# ---------------------------------------------------------------- exact quantiles, dictionary codes
SQL["ag2_medians"] = """WITH c AS (
  SELECT l_extendedprice AS cost, p_type AS category, s_name AS supplier
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT 'all' AS section, 'all' AS key, cost FROM c UNION ALL SELECT 'category', category, cost FROM c
      UNION ALL SELECT 'supplier', supplier, cost FROM c)
SELECT section, key, COUNT(cost) AS n, ROUND(quantile_cont(cost, 0.25), 6) AS lower_quartile, ROUND(median(cost), 6) AS median,
       ROUND(quantile_cont(cost, 0.75), 6) AS upper_quartile
FROM s WHERE key IS NOT NULL GROUP BY 1, 2 HAVING COUNT(cost) > 0"""
SQL["ml1_part_name_codes"] = """SELECT p_partkey, p_name, CAST(DENSE_RANK() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name_code
FROM part"""


# ---------------------------------------------------------------- k-means steps, silhouettes
def _lloyd_sql(steps: int = 3, k: int = 3) -> str:
    """``steps - 1`` moves of the centres, then sizes and centres of the last assignment."""
    out = [f"""x AS (SELECT l_quantity AS a, l_extendedprice / nullif(l_quantity, 0) AS b FROM lineitem),
v AS (SELECT row_number() OVER () AS id, a::DOUBLE AS a, b::DOUBLE AS b FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
c0 AS (SELECT j AS i, avg(a) + (j - {(k - 1) / 2}) * stddev_pop(a) AS a, avg(b) + (j - {(k - 1) / 2}) * stddev_pop(b) AS b FROM v, range({k}) r(j) GROUP BY j)"""]
    for t in range(1, steps + 1):
        out.append(f"""g{t} AS (SELECT v.id, v.a, v.b, min({{'d': (v.a - c.a) ** 2 + (v.b - c.b) ** 2, 'i': c.i}}) AS g FROM v, c{t - 1} c GROUP BY v.id, v.a, v.b),
c{t} AS (SELECT c.i, coalesce(avg(p.a), any_value(c.a)) AS a, coalesce(avg(p.b), any_value(c.b)) AS b, count(p.id) AS n, avg(p.g.d) AS d
       FROM c{t - 1} c LEFT JOIN g{t} p ON p.g.i = c.i GROUP BY c.i)""")
    return "WITH " + ",\n".join(out) + f"""
SELECT i::INTEGER AS cluster, n, ROUND(a, 4) AS centre_quantity, ROUND(b, 4) AS centre_unit_cost, ROUND(d, 4) AS mean_square FROM c{steps} WHERE n > 0"""


SQL["ml11_supply_lloyd_steps"] = _lloyd_sql()
SQL["ml12_group_silhouettes"] = f"""WITH {HR},
h AS (SELECT *, training_hours + overtime_hours - leave_days AS active_time FROM hr),
z AS (SELECT employee_id, department, resigned::VARCHAR AS resigned, """ + ", ".join(
    f"(CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS z{i}" for i, c in enumerate(_Z)) + """ FROM h),
l AS (SELECT 'department' AS labelling, department AS label, * FROM z UNION ALL SELECT 'resigned', resigned, * FROM z),
d AS (
  SELECT x.labelling, x.employee_id, x.label, y.label AS other, COUNT(*) FILTER (x.employee_id <> y.employee_id) AS n,
         SUM(sqrt(""" + " + ".join(f"(x.z{i} - y.z{i}) ** 2" for i in range(len(_Z))) + """)) AS s
  FROM l x JOIN l y ON x.labelling = y.labelling WHERE x.label IS NOT NULL AND y.label IS NOT NULL GROUP BY 1, 2, 3, 4),
p AS (
  SELECT labelling, employee_id, MAX(s / nullif(n, 0)) FILTER (label = other) AS a, MIN(s / n) FILTER (label <> other) AS b
  FROM d GROUP BY 1, 2)
SELECT p.labelling, (SELECT COUNT(DISTINCT label) FROM l WHERE l.labelling = p.labelling)::INTEGER AS groups, COUNT(*) AS n,
       ROUND(AVG(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, 0.0::DOUBLE AS error_bound
FROM p GROUP BY 1"""


# ---------------------------------------------------------------- neighbours that oversampling uses
_N = [c for c in _Z if c != "salary"]
SQL["ml7_minority_neighbours"] = f"""WITH {HR},
h AS (SELECT *, training_hours + overtime_hours - leave_days AS active_time FROM hr),
m AS (SELECT employee_id::VARCHAR AS id, """ + ", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(_N)) + f"""
      FROM h WHERE resigned = 1 AND {SPLIT.format(id='employee_id')}),
d AS (SELECT a.id AS employee_id, b.id AS neighbour_id, sqrt(""" + " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(len(_N))) + """) AS distance
      FROM m a JOIN m b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM d)
SELECT employee_id, rank, neighbour_id, ROUND(distance, 6) AS distance FROM r WHERE rank <= 5"""


# ---------------------------------------------------------------- intake
SQL["src5_intake_manifest"] = """SELECT event_type || '.csv' AS filename, event_type AS department,
       COUNT(*) FILTER (coalesce(user_id % 50, 1) <> 0) AS accepted, COUNT(*) FILTER (user_id % 50 = 0) AS rejected,
       COUNT(*) FILTER (coalesce(user_id % 50, 1) <> 0) AS stored, ROUND(SUM(value) FILTER (coalesce(user_id % 50, 1) <> 0), 2) AS hours
FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""


# ---------------------------------------------------------------- summary rows with values
def _metric_values(name: str) -> str:
    return (f"SELECT 'metrics' AS section, metric AS name, NULL::VARCHAR AS key, value FROM "
            f"(UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL[name]})) ON COLUMNS(*) INTO NAME metric VALUE value)")


def _values(section: str, name: str, query: str, key: str, value: str, where: str = "true") -> str:
    return f"SELECT '{section}' AS section, {name} AS name, {key}::VARCHAR AS key, {value}::DOUBLE AS value FROM ({SQL[query]}) WHERE {where}"


VALUES = {
    "supply_chain": [
        _metric_values("sc1_metrics"), _values("distributions", "section", "sc2_cost_distributions", "key", "total_cost"),
        *[_values("performance", f"'{c}'", "sc4_supplier_performance", "supplier", c) for c in ("avg_delay", "total_cost", "completion_rate")],
        *[_values("trends", f"'{c}'", "sc3_monthly_trends", "month", c) for c in ("monthly_cost", "monthly_delay")]],
    "production": [
        _metric_values("pr1_metrics"), _values("distributions", "section", "pr2_distributions", "key", "n"),
        _values("performance", "section", "pr4_performance", "key", "avg_efficiency"), _values("trends", "'avg_efficiency'", "pr3_monthly_trends", "month", "avg_efficiency")],
    "it": [
        _metric_values("it1_metrics"), _values("distributions", "section", "it2_distributions", "key", "n"),
        _values("performance", "section", "it4_performance", "key", "avg_resolution_time"),
        _values("trends", "'avg_resolution_time'", "it3_monthly_trends", "month", "avg_resolution_time")],
}
ALL_VALUES = VALUES | {
    "transport": [
        _metric_values("tr1_metrics"), _values("distributions", "section", "tr2_distributions", "key", "n"),
        _values("performance", "'by_vehicle_type'", "tr3_by_vehicle", "vehicle", "avg_delivery_time"),
        _values("performance", "'monthly_trends'", "tr4_monthly_deliveries", "month", "deliveries"),
        *[_values("trends", f"'{c}'", "tr6_monthly_service", "month", c) for c in ("avg_delivery_time", "avg_on_time_rate")]],
    "hr": [
        _metric_values("hr1_metrics"), _values("distributions", "section", "hr2_distributions", "key", "n"),
        *[_values("department_insights", f"'{c}'", "hr3_department_insights", "department", c) for c in ("avg_performance", "attrition_rate")],
        _values("trends", "'training'", "hr6_training_effectiveness", "NULL", "effectiveness")],
    "marketing": [
        _metric_values("mk1_metrics"),
        *[f"SELECT section, '{c}' AS name, key::VARCHAR AS key, {c}::DOUBLE AS value FROM ({SQL['mk2_performance']})" for c in ("budget", "leads", "revenue", "roi")]],
    "sales": [
        f"SELECT section, name, key, CASE WHEN name = 'total_sales' THEN (WITH {SA} SELECT ROUND(SUM(revenue), 4) FROM sa) ELSE value END AS value FROM ({_metric_values('sa1_metrics')})",
        _values("distributions", "section", "sa2_distributions", "key", "n"),
        f"WITH {SA} SELECT 'trends' AS section, 'revenue' AS name, strftime(date, '%Y-%m') AS key, ROUND(SUM(revenue), 4) AS value FROM sa WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 3",
        f"WITH {SA}, {SA_GROUPED} SELECT 'performance' AS section, section AS name, key, ROUND(rev, 4) AS value FROM ranked WHERE rank <= 5"],
}


def _department_rows(values: dict[str, list[str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{d}' AS department, * FROM ({q})" for d, queries in values.items() for q in queries)


SQL["all3_summary_values"] = _department_rows(ALL_VALUES)
SQL["snk1_summary_documents"] = _department_rows(VALUES)
SQL["src3_refreshed_summary"] = "\nUNION ALL ".join(f"SELECT *, 1 AS refreshed FROM ({q})" for q in [
    *VALUES["supply_chain"],
    f"WITH {SC} SELECT 'performance' AS section, 'cost_deviation' AS name, supplier AS key, ROUND(STDDEV_POP(total_cost), 2) AS value FROM sc WHERE supplier IS NOT NULL GROUP BY supplier"])
