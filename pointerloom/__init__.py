"""Interaction-telemetry features on Spark: logs in, model-ready tables out."""
