"""Search, grouping and enrichment of event logs as plain DataFrame functions."""
