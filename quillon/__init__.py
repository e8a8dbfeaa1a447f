"""A small analytics engine on PySpark: a SQL dialect and a query builder that lower to DataFrame expressions."""
