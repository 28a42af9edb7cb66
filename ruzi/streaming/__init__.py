"""The dialect has no streaming statements, so nothing is here yet."""
