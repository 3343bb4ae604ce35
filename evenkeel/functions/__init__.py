"""Part of evenkeel."""
