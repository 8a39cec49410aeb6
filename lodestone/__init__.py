"""A T-SQL analytics engine on PySpark."""
