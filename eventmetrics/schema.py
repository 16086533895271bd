"""Table layouts of the data model, as DDL text for ``schema=`` arguments."""


EVENTS = (
    "id string, organization_id string, data_source_id string, event_name string, "
    "timestamp timestamp, payload string, created_at timestamp"
)
RAW_EVENTS = (
    "event_name string, timestamp string, payload string, data_source_id string, "
    "_corrupt_record string"
)
DATA_SOURCES = (
    "id string, organization_id string, name string, type string, "
    "config map<string,string>, is_active boolean, is_deleted boolean"
)
API_KEYS = (
    "organization_id string, name string, prefix string, hashed_key string, "
    "is_active boolean, expires_at timestamp, is_deleted boolean"
)
MEMBERSHIPS = (
    "user_id string, organization_id string, role string, is_deleted boolean"
)
ALERT_RULES = (
    "id string, organization_id string, name string, is_enabled boolean, "
    "metric_type string, operator string, threshold double, time_window_minutes int, "
    "current_state string, muted_until timestamp, snooze_duration_minutes int, "
    "slack_webhook string, email_recipient string, is_deleted boolean"
)
ALERT_HISTORIES = (
    "alert_rule_id string, organization_id string, state string, value double, "
    "threshold double, details string, created_at timestamp"
)
DASHBOARDS = (
    "id string, organization_id string, name string, is_public boolean, "
    "share_token string, is_deleted boolean"
)
WIDGETS = (
    "id string, dashboard_id string, name string, type string, layout string, "
    "query_config string, is_deleted boolean"
)
REPORT_SCHEDULES = (
    "id string, organization_id string, dashboard_id string, name string, "
    "frequency string, recipients array<string>, is_active boolean, is_deleted boolean"
)
REPORT_HISTORIES = (
    "id string, report_schedule_id string, organization_id string, triggered_at timestamp, "
    "status string, error_message string, file_path string, is_deleted boolean"
)
