"""Schemas, table and message sources, sinks."""
