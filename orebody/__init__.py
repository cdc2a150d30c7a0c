"""Repository-history analytics on Spark: typed index tables, derived tables, views and question-shaped functions."""
