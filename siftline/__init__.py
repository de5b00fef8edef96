"""Evidence-funnel analytics as Spark DataFrame operators."""
