"""Where results go: partitioned panels, ordered exports, run folders with a manifest."""
