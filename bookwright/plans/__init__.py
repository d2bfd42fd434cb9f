"""Session settings, lineage cuts and the registered queries."""
