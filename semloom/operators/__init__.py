"""semloom operators."""
