"""Training-data operators: packing, filtering, scanning, deduplication, scoring."""
