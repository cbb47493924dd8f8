"""Sample rows with fixed values that several tests share."""

# The 12-row sample shipped with the original analytics module (fixed values).
SAMPLE_12 = [
    ("error", "Database connection failed after 3 retries", "2025-08-29 10:15:30", "database_service"),
    ("info", "User authentication successful for user_123", "2025-08-29 10:16:00", "auth_service"),
    ("error", "Request timeout while processing /api/users (took 5500ms)", "2025-08-29 10:16:30", "api_service"),
    ("warn", "Disk space usage at 85% on server-01", "2025-08-29 10:17:00", "system_monitor"),
    ("fatal", "Critical system failure: Out of memory", "2025-08-29 10:17:30", "system_monitor"),
    ("info", "Database backup completed successfully (took 1200ms)", "2025-08-29 10:18:00", "backup_service"),
    ("error", "Failed login attempt for user admin from IP 192.168.1.100", "2025-08-29 10:18:30", "auth_service"),
    ("error", "Database connection failed after 3 retries", "2025-08-29 10:19:00", "database_service"),
    ("warn", "API rate limit exceeded for client 192.168.1.50", "2025-08-29 10:19:30", "api_service"),
    ("error", "SQL injection attempt detected in parameter 'user_id'", "2025-08-29 10:20:00", "security_service"),
    ("info", "Cache cleared successfully", "2025-08-29 10:20:30", "cache_service"),
    ("error", "Request timeout while processing /api/reports (took 8000ms)", "2025-08-29 10:21:00", "api_service"),
]

# The 5-row sample of the original integration test (fixed values).
SAMPLE_5 = [
    ("error", "Database connection failed", "2024-01-15 10:30:00", "db-service"),
    ("error", "Authentication failed for user", "2024-01-15 10:31:00", "auth-service"),
    ("warn", "High memory usage detected", "2024-01-15 10:32:00", "monitor-service"),
    ("info", "User login successful", "2024-01-15 10:33:00", "auth-service"),
    ("debug", "Cache hit for user data", "2024-01-15 10:34:00", "cache-service"),
]


def make_logs(spark, rows):
    from pyspark.sql import functions as F
    data = [(i + 1, lv, msg, ts, src) for i, (lv, msg, ts, src) in enumerate(rows)]
    df = spark.createDataFrame(data, "id bigint, level string, message string, ts string, source string")
    return df.select("id", F.col("ts").cast("timestamp_ntz").alias("log_ts"), "level", "message", "source")
