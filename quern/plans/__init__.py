"""Plan helpers: lineage cuts and checked broadcasts."""
