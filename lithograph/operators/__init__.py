"""Set-based operators: graph queries, rolling totals, skew-proof counts."""
