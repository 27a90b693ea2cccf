"""semloom plans."""
