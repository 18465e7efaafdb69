"""Names, bounds and defaults that decide the results."""

# --- fixed values: message streams ---------------------------------------
SENSOR_STREAM = "sensor-data"
SOCIAL_STREAM = "social-data"
MARKET_STREAM = "market-data"
STREAMS = (SENSOR_STREAM, SOCIAL_STREAM, MARKET_STREAM)
PROCESSED_STREAM = "processed-data"
ANOMALY_STREAM = "detected-anomalies"
ERROR_STREAM = "processing-errors"

# --- fixed values: the `source` field of each record kind ----------------
SENSOR_SOURCE = "sensor_simulator"
SOCIAL_SOURCE = "social_feed_simulator"
MARKET_SOURCE = "market_data_simulator"

# --- fixed values: one stored table per source, in reporting order -------
SOURCE_TABLES = {
    "sensor_data": SENSOR_STREAM,
    "social_data": SOCIAL_STREAM,
    "market_data": MARKET_STREAM,
}

# --- fixed values: category ladders, (upper bound, label) then the top ---
TEMPERATURE_STEPS = ([(0, "freezing"), (15, "cold"), (25, "moderate"), (35, "warm")], "hot")
HUMIDITY_STEPS = ([(30, "dry"), (60, "comfortable")], "humid")
ENGAGEMENT_STEPS = ([(10, "low"), (100, "medium"), (1000, "high")], "viral")
PRICE_STEPS = (
    [(-5.0, "sharp_drop"), (-1.0, "drop"), (1.0, "stable"), (5.0, "rise")],
    "sharp_rise",
)
VOLUME_STEPS = ([(1000, "low"), (10000, "medium")], "high")

# --- fixed values: sensor type, lower, upper, unit -----------------------
SENSOR_RANGES = [
    ("temperature", 15.0, 30.0, "°C"),
    ("humidity", 30.0, 70.0, "%"),
    ("pressure", 980.0, 1020.0, "hPa"),
    ("light", 0.0, 1000.0, "lux"),
    ("motion", 0.0, 1.0, "boolean"),
]
LOCATIONS = ["building-a", "building-b", "building-c", "warehouse", "outdoor"]

# --- fixed values: windows and detectors ---------------------------------
WINDOW = "1 minute"
WATERMARK = "1 minute"
TRIGGER = "5 seconds"
MAX_OFFSETS_PER_TRIGGER = 10000
DETECTOR_WINDOW = 100
MIN_VALUES = 10
Z_THRESHOLD = 3.0
MA_WINDOW = 5
MA_WARMUP_SHARE = 0.2
MA_VOLATILITY_FACTOR = 3

# --- fixed values: alerting ----------------------------------------------
MIN_SEVERITY = 0.7
HIGH_SEVERITY = 0.9
MEDIUM_SEVERITY = 0.7
COOLDOWN_MINUTES = 15
ALERT_FIELDS = ("message", "source", "severity")

# --- fixed values: alert texts, line by line; {names} are fields -----------
ALERT_TEXTS = {
    SENSOR_SOURCE: [
        "[{severity_label} SEVERITY] Sensor Anomaly Detected",
        "Sensor: {sensor_id} ({sensor_type})",
        "Location: {location}",
        "Value: {value}{unit}",
        "Anomaly Score: {anomaly_score}",
        "Timestamp: {timestamp}",
    ],
    SOCIAL_SOURCE: [
        "[{severity_label} SEVERITY] Social Media Anomaly Detected",
        "User: {user_id}",
        "Topic: {topic}",
        "Sentiment: {sentiment}",
        "Anomaly Score: {anomaly_score}",
        "Timestamp: {timestamp}",
    ],
    MARKET_SOURCE: [
        "[{severity_label} SEVERITY] Market Anomaly Detected",
        "Symbol: {symbol}",
        "Price: {price}",
        "Price Change: {price_change}",
        "Anomaly Score: {anomaly_score}",
        "Timestamp: {timestamp}",
    ],
}
OTHER_ALERT_TEXT = [
    "[{severity_label} SEVERITY] Anomaly Detected",
    "Source: {source}",
    "Details: {details}",
    "Anomaly Score: {anomaly_score}",
    "Timestamp: {timestamp}",
]
SUBJECT_TEXT = "Alert: {source} Anomaly Detected"
SCORE_FORMAT = "%.2f"
MISSING_TEXT = "unknown"
MISSING_SOURCE_IN_SUBJECT = "Unknown"
MISSING_FIELD_TEXT = "Missing required field: {field}"

# --- fixed values: cells of the anomaly table, details and value ----------
TABLE_CELLS = {
    SENSOR_SOURCE: ("{sensor_type} sensor in {location}", "{value} {unit}"),
    SOCIAL_SOURCE: (
        "User post with {sentiment} sentiment about {topic}",
        "Engagement: {engagement_count}",
    ),
    MARKET_SOURCE: ("{symbol} ({sector})", "{price_change_percent}% ({price})"),
}
SOURCE_SUFFIX = "_simulator"

# --- fixed values: reads and table lifecycle -----------------------------
RECENT_HOURS = 24
READ_LIMIT = 100
ARCHIVE_DAYS = 7
RETENTION_DAYS = {"processed_data": 30, "aggregated_data": 90, "anomalies": 365}
