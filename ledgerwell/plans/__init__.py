"""Physical-plan helpers: snapshots, skew-safe running totals, distance joins."""
