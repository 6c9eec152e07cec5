"""Rasters made of the driver's tables, the same in Spark and DuckDB."""

from __future__ import annotations

_SIDE = ", ".join(f"({k})" for k in range(32))

# 32x32 images, 1,024 event ids each. Pixels without an event are 0, 0, 0, 0. Of events with one id the first (by ts, user_id, value)
# stands in the id's image, each further one in a further image at the same place: its number is larger by the span of all image numbers, once or more.
# Events without an id have no place.
EVENTS = f"""(WITH placed AS (
  SELECT image_id, y, x, r, g, b, a, count(*) OVER (PARTITION BY block, again) AS n FROM (
    SELECT block, again, block + again * span AS image_id, CAST(floor((event_id - block * 1024) / 32e0) AS INT) AS y, CAST((event_id - block * 1024) % 32 AS INT) AS x, r, g, b, a FROM (
      SELECT block, event_id, CAST(row_number() OVER (PARTITION BY block, event_id ORDER BY ts, user_id, value) - 1 AS BIGINT) AS again,
             CAST(user_id % 256 AS INT) AS r, CAST(CAST(floor(value * 100e0) AS BIGINT) % 256 AS INT) AS g, CAST((minute(ts) * 60 + second(ts)) % 256 AS INT) AS b,
             CAST(64 + (event_id * 7) % 192 AS INT) AS a
      FROM (SELECT *, CAST(floor(event_id / 1024e0) AS BIGINT) AS block FROM {{events}} WHERE event_id IS NOT NULL) AS e) AS ranked
    CROSS JOIN (SELECT CAST(floor(max(event_id) / 1024e0) - floor(min(event_id) / 1024e0) + 1 AS BIGINT) AS span FROM {{events}}) AS s) AS p)
  SELECT image_id, 0 AS frame_no, y, x, r, g, b, a FROM placed
  UNION ALL
  SELECT i.image_id, 0 AS frame_no, ys.y, xs.x, 0 AS r, 0 AS g, 0 AS b, 0 AS a
  FROM (SELECT DISTINCT image_id FROM placed WHERE n < 1024) AS i CROSS JOIN (VALUES {_SIDE}) AS ys(y) CROSS JOIN (VALUES {_SIDE}) AS xs(x)
  LEFT JOIN (SELECT image_id, y, x FROM placed WHERE n < 1024) AS t ON t.image_id = i.image_id AND t.y = ys.y AND t.x = xs.x WHERE t.image_id IS NULL)"""


def events_sql(table: str = "events") -> str:
    return EVENTS.replace("{events}", table)


def events_px(spark, sf_dir):
    """The events raster as exploded pixels."""
    return spark.sql("SELECT * FROM " + events_sql("{events}") + " AS px", events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", "ts"))
