"""The registered queries over the test tables, their mapping and their SQL twins."""
