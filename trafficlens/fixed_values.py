"""Log formats, word lists, labels and thresholds.

Results depend on these exact values, so they are kept together and stated
plainly. Everything here can be overridden by a parameter where it is used.
"""

# -- line formats -----------------------------------------------------------
# groups: ip, timestamp, method, endpoint, status, bytes
COMMON_LOG_PATTERN = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\S+)'
)
# groups: as above, then referrer, user agent
COMBINED_LOG_PATTERN = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\S+)'
    r'\s+"([^"]*)"\s+"([^"]*)"'
)
# groups: timestamp, log level, thread, component, message
SERVER_LOG_PATTERN = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (INFO|WARN|ERROR|FATAL) "
    r"\[([^\]]+)\] ([^:]+): (.+)"
)
ACCESS_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
SERVER_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"

# identifiers named inside a server-log message
EXCEPTION_PATTERN = r"(\w+(?:Exception|Error))\b"
CONTAINER_PATTERN = r"(container_[0-9_]+)"
ATTEMPT_PATTERN = r"(attempt_[0-9A-Za-z_]+)"

# -- word lists ---------------------------------------------------------------
BOT_KEYWORDS = (
    "bot",
    "crawler",
    "spider",
    "scraper",
    "ahrefsbot",
    "bingbot",
    "googlebot",
    "slurp",
    "curl",
    "wget",
    "python-requests",
    "java",
    "go-http",
)
HTTP_METHODS = (
    "GET",
    "POST",
    "PUT",
    "DELETE",
    "HEAD",
    "OPTIONS",
    "PATCH",
    "CONNECT",
    "TRACE",
    "PROPFIND",
)
DAY_NAMES = {1: "Sun", 2: "Mon", 3: "Tue", 4: "Wed", 5: "Thu", 6: "Fri", 7: "Sat"}
BOT_LABELS = {0: "Human", 1: "Bot"}
OFF_HOURS_LABELS = {0: "Business Hours (8–22)", 1: "Off Hours"}

ACCESS_SOURCE = "access_log"
WEB_SERVER_SOURCE = "web_server_log"

# -- status codes ---------------------------------------------------------------
SEVERITY_CODES = {
    "fatal": (500, 502, 503, 504),
    "medium": (499, 401, 403, 429),
    "low": (400, 404, 405, 416),
}
ERROR_SEVERITY_ORDER = ("low", "medium", "fatal")
SEVERITY_ORDER = ("low", "medium", "high")

# -- business hours: first and last hour, both inside -----------------------------
BUSINESS_HOURS = (8, 22)

# -- window rules -----------------------------------------------------------------
SPIKE_REQUESTS = 200
HIGH_ERROR_RATE = 0.3
SCAN_ENDPOINTS = 30
SCORE_WEIGHTS = {"fatal": 0.40, "medium": 0.25, "error_rate": 0.20, "volume": 0.15}
HIGH_SCORE = 0.7
MEDIUM_SCORE = 0.3

# -- modelling --------------------------------------------------------------------
NUMERIC_FEATURES = (
    "request_count",
    "error_count",
    "avg_bytes",
    "unique_endpoints",
    "bot_requests",
    "off_hours_requests",
    "fatal_count",
    "medium_count",
    "low_count",
    "error_rate",
)
SEED = 42
LR_REG_PARAMS = (0.001, 0.01, 0.1)
LR_ELASTIC_NET = (0.0, 0.5)
LR_MAX_ITER = 100
FOREST_TREES = (50, 100)
FOREST_DEPTHS = (5, 10)
KNN_K = 5
KNN_GRID = (3, 5, 11)
KMEANS_K = (3, 4, 5, 6, 7, 8)
KMEANS_MAX_ITER = 30
SPLIT_WEIGHTS = {"train": 0.6, "validation": 0.2, "test": 0.2}
