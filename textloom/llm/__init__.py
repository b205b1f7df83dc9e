"""Operators for building training data from very large document collections.

Nothing outside this subpackage imports it; its queries are in queries.py, the SQL that
checks them in sql.py."""
