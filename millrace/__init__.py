"""Spark-first text-intelligence engine: cleaning, near-duplicate removal, extraction, scoring, warehouse and BI."""
