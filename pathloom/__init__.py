"""Spark-native analytics for workflow recommendation and workflow-quality evaluation."""
