"""Part of eventmill."""
