"""Declared schemas. Readers never infer: partition columns stay strings, missing keys become NULL."""

from __future__ import annotations

DAILY = "year string, month string, day string"
HOURLY = DAILY + ", hour string"

# Table layouts of the lake.
BATCH_FIELDS = """
batch_id string, batch_timestamp bigint,
batch_metadata struct<user_id string, device_id string, session_id string, app_version string, os_version string,
  device_model string, platform string, timezone string, network_type string>,
events array<struct<event_id string, timestamp bigint, event_type string, event_name string, screen_name string,
  action string, category string, label string, value double, duration double,
  focus_session struct<session_type string, duration_seconds double, completion_rate double, technique_used string,
    difficulty_level string, mood_before string, mood_after string, interruptions bigint>,
  breathing_exercise struct<exercise_type string, breaths_per_minute double, total_breaths bigint,
    session_duration double, pattern_type string, guide_used boolean, completion_status string>,
  danger_probability struct<danger_level string, probability_level string, context string, user_confidence double,
    technique_applied string, outcome_rating string>,
  user_interaction struct<interaction_type string, element_id string, position struct<x double, y double>,
    gesture string, response_time_ms bigint>,
  response string, focus string, specific_focus string>>
"""
BEHAVIOR_FIELDS = """
behavior_id string, user_id string, session_id string, device_id string, timestamp bigint, behavior_type string,
screen_name string, action string,
wellness_metrics struct<session_completion_rate double, total_focus_time_minutes double,
  breathing_sessions_completed bigint, mood_improvement_score double, stress_reduction_rating double,
  technique_effectiveness string, weekly_consistency_score double, goal_achievement_rate double>,
engagement_patterns struct<daily_active_minutes double, preferred_session_times array<string>,
  favorite_techniques array<string>, difficulty_progression string, feature_usage_frequency map<string,bigint>,
  retention_indicators struct<days_since_first_use bigint, consecutive_active_days bigint,
    last_session_quality string>>,
user_preferences struct<preferred_session_duration double, notification_settings map<string,boolean>,
  accessibility_options array<string>, privacy_settings map<string,string>, theme_preferences string>,
device_context struct<app_version string, os_name string, os_version string, device_model string,
  network_type string, battery_level double, available_storage_gb double, memory_usage_mb double>
"""
FEEDBACK_FIELDS = """
feedback_id string, user_id string, device_id string, session_id string, timestamp bigint, feedback_type string,
category string, severity string, priority string, title string, description string, steps_to_reproduce string,
expected_behavior string, actual_behavior string, user_rating double, tags array<string>,
attachments array<struct<type string, filename string, size bigint, s3_key string, url string>>,
device_info struct<device_model string, os_name string, os_version string, app_version string,
  screen_resolution string, available_memory bigint, available_storage bigint, battery_level double,
  network_type string>,
app_state struct<current_screen string, previous_screen string, user_actions array<string>, error_logs array<string>,
  performance_metrics struct<cpu_usage double, memory_usage double, load_time double, crash_occurred boolean>>,
processing_status struct<status string, assigned_to string, processed_at bigint, resolved_at bigint,
  resolution_notes string, internal_tags array<string>>
"""
TRANSACTION_FIELDS = """
transaction_id string, user_id string, device_id string, session_id string, timestamp bigint,
transaction_type string, product_id string, product_name string, product_category string, amount double,
currency string, payment_method string,
subscription_info struct<subscription_id string, plan_type string, billing_period string, trial_period boolean,
  renewal_date bigint, cancellation_date bigint, upgrade_from string, downgrade_to string>,
transaction_status string, payment_processor string, payment_processor_transaction_id string,
refund_info struct<refund_id string, refund_amount double, refund_reason string, refund_date bigint,
  refund_status string>,
promo_code struct<code string, discount_type string, discount_amount double, campaign_id string>,
tax_info struct<tax_amount double, tax_rate double, tax_jurisdiction string, tax_exempt boolean>,
receipt_info struct<receipt_id string, receipt_url string, receipt_email string, receipt_sent boolean>,
risk_assessment struct<risk_score double, fraud_indicators array<string>, verification_status string,
  chargeback_risk double>
"""
RAW_EVENT_FIELDS = "event_id string, timestamp string, user_id string, event_type string, properties map<string,string>"
METRIC_FIELDS = "timestamp string, metric_name string, value double, tags string"
MESSAGE_COLUMNS = ["message_id", "queue", "group_id", "dedup_id", "body", "sent_ms", "receive_count"]

CORRUPT = "_corrupt_record"

BATCHES = f"{BATCH_FIELDS}, {HOURLY}"
BEHAVIOR = f"{BEHAVIOR_FIELDS}, {HOURLY}"
FEEDBACK = f"{FEEDBACK_FIELDS}, {DAILY}"
TRANSACTIONS = f"{TRANSACTION_FIELDS}, {DAILY}"
RAW_EVENTS = f"{RAW_EVENT_FIELDS}, year int, month int, day int, hour int"
METRICS = METRIC_FIELDS
MESSAGES = (
    "message_id string, queue string, group_id string, dedup_id string, body string, sent_ms bigint, receive_count int"
)
