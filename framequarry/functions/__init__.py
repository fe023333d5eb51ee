"""Part of the framequarry engine."""
