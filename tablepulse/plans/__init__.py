"""Rule catalogues and whole jobs put together from the operators."""
