"""DuckDB statements of the same views, shared by the oracle queries."""

SENSORS = """
sensors AS (
  SELECT 'sensor-' || user_id AS sensor_id, sensor_type,
         list_extract(['building-a', 'building-b', 'building-c', 'warehouse', 'outdoor'],
                      CAST(user_id % 5 + 1 AS INTEGER)) AS location,
         ts AS timestamp,
         CASE WHEN sensor_type = 'temperature' THEN value * 0.5 - 10 ELSE value END AS value,
         CASE sensor_type WHEN 'temperature' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'pressure' THEN 'hPa'
                          WHEN 'light' THEN 'lux' WHEN 'motion' THEN 'boolean' END AS unit,
         value > 150 AS is_anomaly, 'sensor_simulator' AS source, event_id AS id
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'temperature' WHEN 'view' THEN 'humidity'
                       WHEN 'purchase' THEN 'pressure' WHEN 'signup' THEN 'light'
                       WHEN 'error' THEN 'motion' END AS sensor_type FROM events))
"""

POSTS = """
posts AS (
  SELECT 'user-' || e.user_id AS user_id, e.ts AS timestamp, d.text AS content, d.source AS topic,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
         CAST(15 * e.k AS BIGINT) AS engagement_count, e.k >= 97 AS is_anomaly,
         'social_feed_simulator' AS source, e.event_id AS id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               event_id % (SELECT count(*) FROM documents) AS doc FROM events) e
  JOIN documents d ON d.doc_id = e.doc
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def cents(value: str) -> str:
    """Half-up rounding to 2 digits of the number as it is printed."""
    return f"CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(18, 2)) AS DOUBLE)"


TICKS = f"""
ticks AS (
  SELECT l_partkey AS part_id, 'P' || l_partkey AS symbol,
         {cents('l_extendedprice / l_quantity')} AS price,
         CAST(l_quantity * 400 AS BIGINT) AS volume, l_shipdate AS timestamp,
         'market_data_simulator' AS source, l_orderkey AS order_id, l_linenumber AS line,
         l_suppkey AS supplier, l_extendedprice AS total
  FROM lineitem)
"""

MARKET = (
    TICKS
    + f""",
moved AS (
  SELECT *, lag(price) OVER (PARTITION BY symbol
                             ORDER BY timestamp, order_id, line, supplier, volume, total) AS last FROM ticks),
market AS (
  SELECT symbol, symbol || ' Corporation' AS company_name, p_type AS sector, price, price_change,
         price_change_percent, volume, timestamp, abs(price_change_percent) > 500 AS is_anomaly, source,
         order_id, line, supplier, total
  FROM (SELECT *, coalesce({cents('price - last')}, 0.0) AS price_change,
               coalesce({cents('100 * (price - last) / last')}, 0.0) AS price_change_percent FROM moved)
  JOIN part ON p_partkey = part_id)
"""
)

MIXED = (
    ", ".join([SENSORS, POSTS, MARKET])
    + """,
mixed AS (
  SELECT 'sensor-data' AS stream, * EXCLUDE (id) FROM sensors
  UNION ALL BY NAME SELECT 'social-data' AS stream, * EXCLUDE (id) FROM posts
  UNION ALL BY NAME SELECT 'market-data' AS stream, * EXCLUDE (order_id, line, supplier, total) FROM market)
"""
)

CATEGORY = """CASE WHEN sensor_type = 'temperature' THEN
    CASE WHEN value < 0 THEN 'freezing' WHEN value < 15 THEN 'cold' WHEN value < 25 THEN 'moderate'
         WHEN value < 35 THEN 'warm' ELSE 'hot' END
  WHEN sensor_type = 'humidity' THEN
    CASE WHEN value < 30 THEN 'dry' WHEN value < 60 THEN 'comfortable' ELSE 'humid' END
  ELSE 'normal' END"""
ENGAGEMENT = """CASE WHEN engagement_count < 10 THEN 'low' WHEN engagement_count < 100 THEN 'medium'
  WHEN engagement_count < 1000 THEN 'high' ELSE 'viral' END"""
MOVEMENT = """CASE WHEN price_change_percent < -5 THEN 'sharp_drop' WHEN price_change_percent < -1 THEN 'drop'
  WHEN price_change_percent < 1 THEN 'stable' WHEN price_change_percent < 5 THEN 'rise' ELSE 'sharp_rise' END"""
ACTIVITY = "CASE WHEN volume < 1000 THEN 'low' WHEN volume < 10000 THEN 'medium' ELSE 'high' END"


def with_views(views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{views.strip()}\n{body.strip()}"
