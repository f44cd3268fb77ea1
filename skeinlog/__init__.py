"""Session-log analytics and event-table operators on Spark."""
