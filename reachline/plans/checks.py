"""The tables of FIXTURES.md as SQL, shared by the checking statements.

Written apart from the DataFrame code: statuses here follow from applying the receipts one
by one, attributed revenue from the plain range join, and memberships from one condition
list per rule.
"""

import re

RANK = """CASE {0} WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'failed' THEN 2
 WHEN 'opened' THEN 3 WHEN 'read' THEN 4 WHEN 'clicked' THEN 5 WHEN 'converted' THEN 6
 ELSE 0 END"""

TABLES = {
    "crm_orders": """
      SELECT o_orderkey AS id, o_custkey AS customer_id, 'NO-' || o_orderkey AS order_number,
        CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CASE WHEN o_orderkey % 2 = 0 THEN 'online' ELSE 'in-store' END AS channel,
        CASE WHEN o_orderstatus IN ('F','O') THEN 'completed'
             WHEN o_orderpriority < '3' THEN 'returned' ELSE 'cancelled' END AS status,
        o_orderdate AS created_at
      FROM orders""",
    "crm_people": """
      SELECT c_custkey AS id, c_name AS name,
        lower(replace(c_name, '#', '.')) || '@example.com' AS email,
        CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ''
             ELSE '+91' || (9000000000 + c_custkey) END AS phone,
        CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE n_name END AS city,
        CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CAST(18 + c_custkey % 38 AS INTEGER) AS age,
        c_custkey % 20 <> 19 AS is_active,
        TIMESTAMP '2001-08-02 00:00:00' - to_days(CAST(c_custkey * 7 % 365 + 1 AS INTEGER))
          AS created_at
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "crm_rollup": """
      SELECT p.*, coalesce(r.n, 0) AS total_orders,
        CAST(coalesce(r.s, 0) AS DECIMAL(18,2)) AS total_spent, r.last AS last_order_date
      FROM crm_people p LEFT JOIN (
        SELECT customer_id, count(*) AS n, sum(amount) AS s, max(created_at) AS last
        FROM crm_orders WHERE status = 'completed' GROUP BY customer_id) r
      ON p.id = r.customer_id""",
    "crm_customers": """
      SELECT *, list_filter([
        CASE WHEN total_spent > 2000000 THEN 'vip' END,
        CASE WHEN total_orders > 1 AND
          date_sub('day', last_order_date, TIMESTAMP '2001-08-02 00:00:00') > 60
          THEN 'churned' END,
        CASE WHEN total_orders <= 6 AND
          date_sub('day', created_at, TIMESTAMP '2001-08-02 00:00:00') < 30 THEN 'new' END,
        CASE WHEN total_orders >= 5 THEN 'loyal' END], lambda t: t IS NOT NULL) AS tags
      FROM crm_rollup""",
    "receipts": """
      SELECT event_id AS seq, CAST(day(ts) - 1 AS BIGINT) AS campaign_id,
        user_id AS customer_id,
        CASE event_type
          WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'sent' ELSE 'delivered' END
          WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'opened' ELSE 'read' END
          WHEN 'click' THEN 'clicked' WHEN 'purchase' THEN 'converted'
          WHEN 'error' THEN 'failed' END AS event_type,
        ts - INTERVAL 24 YEAR AS ts,
        CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS order_value
      FROM events""",
    "firsts": """
      SELECT * FROM receipts QUALIFY row_number() OVER (
        PARTITION BY campaign_id, customer_id, event_type ORDER BY seq) = 1""",
    "walked": f"""
      SELECT campaign_id, customer_id, list_reduce(
        list({{'s': event_type, 'at': ts}} ORDER BY seq),
        lambda a, x: CASE
          WHEN a.s <> 'failed' AND {RANK.format('x.s')} > {RANK.format('a.s')}
          THEN {{'s': x.s, 'at': CASE WHEN x.s IN ('sent','delivered') AND a.at IS NULL
                                      THEN x.at ELSE a.at END}}
          ELSE a END,
        {{'s': 'queued', 'at': CAST(NULL AS TIMESTAMP)}}) AS w
      FROM firsts GROUP BY campaign_id, customer_id""",
    "folded": """
      SELECT campaign_id, customer_id, w.s AS status, w.at AS sent_at, m.updated_at
      FROM walked JOIN (SELECT campaign_id, customer_id, max(ts) AS updated_at
                        FROM firsts GROUP BY campaign_id, customer_id) m
      USING (campaign_id, customer_id)""",
    "audience": """
      SELECT DISTINCT campaign_id, customer_id FROM receipts
      WHERE campaign_id % 2 = 0 AND (campaign_id % 6 <> 0 OR customer_id % 10 <> 0)
      UNION ALL
      SELECT c AS campaign_id, customer_id
      FROM (SELECT DISTINCT customer_id FROM receipts),
           (SELECT unnest(range(1, 30, 2)) AS c)""",
    "comms": """
      SELECT coalesce(a.campaign_id, f.campaign_id) * 1000000000000
          + coalesce(a.customer_id, f.customer_id) AS id,
        coalesce(a.campaign_id, f.campaign_id) AS campaign_id,
        coalesce(a.customer_id, f.customer_id) AS customer_id,
        CASE WHEN a.campaign_id IS NULL THEN 'unknown'
          ELSE ['whatsapp','sms','email','rcs'][a.campaign_id % 4 + 1] END AS channel,
        coalesce(f.status, 'queued') AS status, f.sent_at,
        coalesce(f.updated_at, TIMESTAMP '2000-01-01 00:00:00'
          + to_days(CAST(a.campaign_id AS INTEGER))) AS updated_at
      FROM audience a FULL OUTER JOIN folded f
      ON a.campaign_id = f.campaign_id AND a.customer_id = f.customer_id""",
    "campaigns": """
      SELECT g.id, 'Campaign ' || g.id AS name,
        CASE g.id WHEN 32 THEN 5 WHEN 33 THEN 6 WHEN 34 THEN 99 ELSE g.id % 4 END AS segment_id,
        ['whatsapp','sms','email','rcs'][g.id % 4 + 1] AS channel,
        CASE WHEN g.id < 30 THEN 'sending' ELSE 'draft' END AS status,
        TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(g.id AS INTEGER)) AS created_at,
        CASE WHEN g.id < 30 THEN TIMESTAMP '2000-01-01 00:00:00'
          + to_days(CAST(g.id AS INTEGER)) END AS sent_at,
        coalesce(z.n, 0) AS total_sent
      FROM (SELECT unnest(range(0, 35)) AS id) g
      LEFT JOIN (SELECT campaign_id, count(*) AS n FROM audience GROUP BY campaign_id) z
      ON z.campaign_id = g.id""",
    "counted": """
      SELECT c.*, coalesce(s.messages, 0) AS messages, coalesce(s.queued, 0) AS queued,
        coalesce(s.sent, 0) AS sent, coalesce(s.delivered, 0) AS delivered,
        coalesce(s.failed, 0) AS failed, coalesce(s.opened, 0) AS opened,
        coalesce(s.read, 0) AS read, coalesce(s.clicked, 0) AS clicked,
        coalesce(s.converted, 0) AS converted
      FROM campaigns c LEFT JOIN (
        SELECT campaign_id, count(*) AS messages,
          count(*) FILTER (status = 'queued') AS queued,
          count(*) FILTER (status <> 'queued') AS sent,
          count(*) FILTER (status IN ('delivered','opened','read','clicked','converted'))
            AS delivered,
          count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (status IN ('opened','read','clicked','converted')) AS opened,
          count(*) FILTER (status IN ('read','clicked','converted')) AS read,
          count(*) FILTER (status IN ('clicked','converted')) AS clicked,
          count(*) FILTER (status = 'converted') AS converted
        FROM comms GROUP BY campaign_id) s ON s.campaign_id = c.id""",
    "revenue": """
      SELECT c.id AS campaign_id, CAST(coalesce(sum(o.amount), 0) AS DOUBLE) AS revenue
      FROM campaigns c
      LEFT JOIN (SELECT DISTINCT campaign_id, customer_id FROM comms
                 WHERE status = 'converted') v ON v.campaign_id = c.id
      LEFT JOIN crm_orders o
        ON o.customer_id = v.customer_id AND o.created_at >= c.created_at
      GROUP BY c.id""",
    "segments": """
      SELECT * FROM (VALUES
        (0, 'High value', '{"min_spent":2000000}', TIMESTAMP '2000-01-01 00:00:00'),
        (1, 'Lapsed', '{"days_since_last_order":45}', TIMESTAMP '2000-01-02 00:00:00'),
        (2, 'Two cities', '{"cities":["NATION_1","NATION_2"],"gender":"F"}',
         TIMESTAMP '2000-01-03 00:00:00'),
        (3, 'Tagged', '{"tags":["vip","new"],"min_age":25,"max_age":40}',
         TIMESTAMP '2000-01-04 00:00:00'),
        (4, 'Everyone', '{}', TIMESTAMP '2000-01-05 00:00:00'),
        (5, 'Nobody', '{"min_spent":1e12}', TIMESTAMP '2000-01-06 00:00:00'),
        (6, 'Unreadable', '{"min_spent":"1e9 rupees"}', TIMESTAMP '2000-01-07 00:00:00'))
      AS t(id, name, filter_logic, created_at)""",
    "members": """
      SELECT CAST(s.id AS BIGINT) AS segment_id, c.id AS customer_id
      FROM (SELECT unnest(range(0, 6)) AS id) s JOIN crm_customers c
      ON c.is_active AND CASE s.id
        WHEN 0 THEN c.total_spent >= 2000000
        WHEN 1 THEN c.last_order_date <= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 45 DAY
        WHEN 2 THEN c.city IN ('NATION_1', 'NATION_2') AND c.gender = 'F'
        WHEN 3 THEN list_has_any(c.tags, ['vip', 'new']) AND c.age BETWEEN 25 AND 40
        WHEN 4 THEN true
        ELSE c.total_spent >= 1e12 END""",
}


def over_tables(select: str) -> str:
    """The statement with the shared tables it uses in front of it."""
    used: dict[str, str] = {}
    for name in reversed(TABLES):
        if re.search(rf"\b{name}\b", select + " ".join(used.values())):
            used[name] = TABLES[name]
    names = ",\n".join(f"{name} AS ({used[name]})" for name in reversed(used))
    return f"WITH {names}\n{select}" if names else select


def stamped(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def rate(part: str, whole: str, digits: int = 1) -> str:
    return (f"CASE WHEN {whole} > 0 THEN round(100::DOUBLE * ({part}) / ({whole}), {digits}) "
            f"ELSE 0::DOUBLE END")
