"""Sources: typed tables, raw JSON records and envelopes, artifacts, fixtures."""
