"""Schemas of the workload model; readers declare them and never infer."""

from __future__ import annotations

EVENT = "ts_micros long, session_id long, user string, db string, query string, orig_query_time_s double, fingerprint_id long"
#: An event with its place in the capture.
ORDERED_EVENT = f"ordinal long, {EVENT}"
FINGERPRINT = "id long, text string"
PCAP_COUNTERS = (
    "packets", "truncated_packets", "ip_fragments_skipped", "connections", "connections_decoded", "connections_tls_skipped", "connections_compressed_skipped",
    "connections_midstream_skipped", "connections_broken", "statements_expanded", "statements_inexpandable", "responses_missing",
)
PCAP = ", ".join(f"{c}: long" for c in PCAP_COUNTERS)
SUMMARY = (
    "source_dialect string, event_count long, session_count long, admin_commands_ignored long, server_restarts_seen long, "
    f"pcap struct<{PCAP}, server_versions: array<string>>, fingerprints array<struct<id: long, text: string>>"
)
#: One line of a capture file: the columns of all its kinds of records.
RECORD = f"type string, version int, tool_version string, created_at string, {EVENT}, {SUMMARY}"

CHECKSUM = "struct<events: long, no_result: long, rows_total: long, digest: string, columns: array<string>, shape_varied: boolean, nondeterministic: boolean>"
RESULT_BYTES = "struct<total: long, min: long, max: long, mean: double, p50: long, p95: long>"
SIZE_BUCKET = "struct<bucket: string, count: long, p50_us: long, p95_us: long, mean_us: double, max_us: long, bytes_total: long>"
FINGERPRINT_REPORT = (
    "id: long, fingerprint: string, count: long, errors: long, first_error: string, skipped: long, not_run: long, p50_us: long, p95_us: long, p99_us: long, "
    f"max_us: long, mean_us: double, checksum: {CHECKSUM}, result_bytes: {RESULT_BYTES}, size_buckets: array<{SIZE_BUCKET}>"
)
FLAGS = "struct<max_connections: long, allow_writes: boolean, read_only: boolean, db_override: string, speed: string, checksum: boolean, pool: long, warmup: boolean, filter_db: string, filter_user: string, time_window: string>"
TOTALS = "struct<events: long, sessions: long, executed: long, skipped: long, errors: long, not_run: long, connect_failures: long, qps: double, filtered: long>"
RUN = (
    "tool string, tool_version string, capture_file string, capture_dialect string, latency_source string, target_url string, target_server_version string, started_at string, "
    f"ended_at string, wall_secs double, aborted boolean, aggregation struct<passes: long, method: string>, flags {FLAGS}, totals {TOTALS}, "
    "saturation struct<samples: long, saturated_samples: long, saturated_pct: double>, pacing struct<speed: double, paced_events: long, max_lag_us: long, mean_lag_us: double>, "
    f"target_settings map<string, string>, fingerprints array<struct<{FINGERPRINT_REPORT}>>"
)
#: What became of each event in each pass of a replay.
EXEC_LOG = (
    "pass int, ordinal long, session_id long, fingerprint_id long, outcome string, latency_us long, result_bytes long, error string, start_us long, due_us long, "
    "digest decimal(20,0), digest_rows long, columns array<string>"
)
RECORDED, REPLAYED = "recorded-slow-log", "replayed"
