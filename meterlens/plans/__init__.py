"""The reports: one function per analysis, each returning a lazy DataFrame.

``REPORTS`` maps the report key to its function.  Every function takes a
``Tables`` first; time-bounded ones take ``as_of`` next.
"""

from . import audit, billing, consumption, cost, operations, querylog

REPORTS = {
    # A: daily cost by object
    "clustering_cost_daily": cost.clustering_cost_daily,
    "mview_cost_daily": cost.mview_cost_daily,
    "search_opt_cost_daily": cost.search_opt_cost_daily,
    "pipe_cost_daily": cost.pipe_cost_daily,
    "replication_cost_daily": cost.replication_cost_daily,
    # B: weekly mean of daily credits
    "clustering_weekly_avg": cost.clustering_weekly_avg,
    "mview_weekly_avg": cost.mview_weekly_avg,
    "search_opt_weekly_avg": cost.search_opt_weekly_avg,
    "pipe_weekly_avg": cost.pipe_weekly_avg,
    "replication_weekly_avg": cost.replication_weekly_avg,
    # C: metering and consumption
    "credits_by_warehouse_all": consumption.credits_by_warehouse_all,
    "credits_by_warehouse_recent": consumption.credits_by_warehouse_recent,
    "credits_by_hour_of_day": consumption.credits_by_hour_of_day,
    "query_volume_by_hour": consumption.query_volume_by_hour,
    "cloud_services_ratio": consumption.cloud_services_ratio,
    "warehouse_over_7day_avg": consumption.warehouse_over_7day_avg,
    "cost_per_query": consumption.cost_per_query,
    "credits_by_user": consumption.credits_by_user,
    "credits_by_client": consumption.credits_by_client,
    "warehouse_utilization": consumption.warehouse_utilization,
    # D: query-log analysis
    "most_expensive_queries": querylog.most_expensive_queries,
    "most_expensive_queries_recent": querylog.most_expensive_queries_recent,
    "frequent_queries": querylog.frequent_queries,
    "longest_queries": querylog.longest_queries,
    "most_scanned_queries": querylog.most_scanned_queries,
    "execution_time_buckets": querylog.execution_time_buckets,
    "full_scan_users": querylog.full_scan_users,
    "full_scan_queries": querylog.full_scan_queries,
    "heavy_scanners": querylog.heavy_scanners,
    "top_remote_spillers": querylog.top_remote_spillers,
    "spill_ratio": querylog.spill_ratio,
    "queue_pressure": querylog.queue_pressure,
    "cache_usage": querylog.cache_usage,
    "role_segmentation": querylog.role_segmentation,
    # E: billing and forecast
    "billing_ledger": billing.billing_ledger,
    "usage_forecast": billing.usage_forecast,
    # F: ingest and tasks
    "ingest_daily": operations.ingest_daily,
    "failed_tasks": operations.failed_tasks,
    "long_tasks": operations.long_tasks,
    # G: identity and configuration audit
    "idle_users": audit.idle_users,
    "users_never_logged_in": audit.users_never_logged_in,
    "idle_roles": audit.idle_roles,
    "idle_warehouses": audit.idle_warehouses,
    "no_auto_resume": audit.no_auto_resume,
    "no_auto_suspend": audit.no_auto_suspend,
    "long_suspension": audit.long_suspension,
    "no_resource_monitor": audit.no_resource_monitor,
    "stale_streams": audit.stale_streams,
    "statement_timeouts": audit.statement_timeouts,
}

__all__ = ["REPORTS", "audit", "billing", "consumption", "cost", "operations", "querylog"]
