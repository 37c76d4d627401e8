"""Registered queries over the supplied tables, and SQL that checks them."""
