"""Column helpers: cleaning of dirty identifiers and clocks, guarded statistics, ranks."""
