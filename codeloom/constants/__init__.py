"""Languages, exclusions, thresholds and rule packs."""
