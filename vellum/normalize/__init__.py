"""Parsed records to typed entities. Every projection is a select over record columns, without a shuffle."""
