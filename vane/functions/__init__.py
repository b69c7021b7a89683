"""Part of vane."""
