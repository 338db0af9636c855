"""Training-data operators: ten independent modules plus the queries that apply them to whole tables."""
