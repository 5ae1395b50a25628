"""Operators: lazy DataFrame -> DataFrame transformations, one module per area."""
