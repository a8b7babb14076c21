"""Plan-shape helpers: bounded windows, runs, interval and nearest joins,
exact quantiles and ranks, reliable lineage cuts."""
