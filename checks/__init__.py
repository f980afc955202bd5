"""Registered queries: every operator over the driver tables, with SQL to compare against."""
