"""Data-quality KPIs over related Spark tables: rates, scores, failing rows, alerts, history and corrections."""
