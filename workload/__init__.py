"""The registered queries: bar tables derived from the test tables, and their SQL twins."""
