"""The operators bound to the given tables, each with the SQL that must give the same rows."""
