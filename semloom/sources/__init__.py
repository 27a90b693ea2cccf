"""semloom sources."""
