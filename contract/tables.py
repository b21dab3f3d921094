"""Log lines made from the ``events`` table: the input of all registered queries.

Every event becomes one access-log line and one server-log line. Users with an
even id write Common lines, the others Combined lines; every 97th event is a
malformed line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.rules import Thresholds
from trafficlens.operators.enrich import enrich
from trafficlens.operators.windows import client_windows
from trafficlens.plans.access import access_rows

# events are sparse (about two per user and day): day windows and low limits reach every label
DAY = "1 day"
DAY_LIMITS = Thresholds(spike_requests=5, error_rate=0.3, endpoints=3)

LINE_SQL = """CASE WHEN event_id % 97 = 0 THEN concat('malformed ', CAST(event_id AS STRING)) ELSE concat(
  '10.0.', {high}, '.', user_id % 256, ' - - [', {clock}, ' +0000] "',
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END,
  ' /', event_type, '/', {number}, ' HTTP/1.1" ',
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 20 = 0 THEN 301 ELSE 200 END
    ELSE CASE event_id % 10 WHEN 0 THEN 500 WHEN 1 THEN 502 WHEN 2 THEN 503 WHEN 3 THEN 504
      WHEN 4 THEN 499 WHEN 5 THEN 401 WHEN 6 THEN 403 WHEN 7 THEN 404 WHEN 8 THEN 400
      ELSE 418 END END, ' ',
  CASE WHEN event_id % 17 = 0 THEN '-' ELSE CAST(CAST(floor(value*100) AS INT) AS STRING) END,
  CASE WHEN user_id % 2 = 0 THEN '' ELSE concat(' "-" "',
    CASE WHEN event_id % 13 = 0 THEN 'AhrefsBot/6.1' WHEN event_id % 29 = 0 THEN 'curl/7.58'
      ELSE 'Mozilla/5.0' END, '" "-"') END) END"""

# an error event is followed by nothing but a stack-trace line, the others log normally
SERVER_LINE_SQL = """CASE WHEN event_type = 'error'
  THEN concat('\tat org.app.Task.run(Task.java:', CAST(event_id AS STRING), ') IOException')
  ELSE concat({clock}, ',', {millis}, ' ',
    CASE event_type WHEN 'purchase' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END,
    ' [main] org.app.', event_type, ': container_', CAST(user_id AS STRING), '_01 attempt_',
    CAST(event_id AS STRING), '_m_0: ',
    CASE WHEN event_type = 'purchase' THEN 'java.io.FileNotFoundException: ' ELSE '' END, props)
  END"""

_SPARK = {
    "high": "user_id div 256",
    "clock": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "number": "regexp_extract(props, '[0-9]+', 0)",
}
_DUCK = {
    "high": "(user_id // 256)",
    "clock": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "number": "regexp_extract(props, '[0-9]+')",
}
SPARK_LINE = LINE_SQL.format(**_SPARK)
DUCK_LINE = LINE_SQL.format(**_DUCK).replace("STRING", "VARCHAR")
SPARK_SERVER_LINE = SERVER_LINE_SQL.format(
    clock="date_format(ts, 'yyyy-MM-dd HH:mm:ss')", millis="date_format(ts, 'SSS')"
)
DUCK_SERVER_LINE = SERVER_LINE_SQL.format(
    clock="strftime(ts, '%Y-%m-%d %H:%M:%S')", millis="strftime(ts, '%g')"
).replace("STRING", "VARCHAR").replace("'\t", "chr(9) || '")
SOURCE = "CASE WHEN user_id % 2 = 0 THEN 'access_log' ELSE 'web_server_log' END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hours and weekdays are read in the session zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, source) for every event."""
    return events(spark, sf_dir).selectExpr(f"{SPARK_LINE} AS value", f"{SOURCE} AS source")


def server_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(f"{SPARK_SERVER_LINE} AS value", "event_type")


def by_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the Common and of the Combined log."""
    both = lines(spark, sf_dir)
    return tuple(
        both.filter(F.col("source") == name).select("value")
        for name in ("access_log", "web_server_log")
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_rows(*by_source(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(access(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_windows(enriched(spark, sf_dir), DAY_LIMITS, DAY)
