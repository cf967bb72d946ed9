"""Query front ends and the catalog of queries."""
