"""Derived input views and the SQL that checks the operators."""
