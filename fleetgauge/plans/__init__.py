"""Plan shapes used by several operators."""
