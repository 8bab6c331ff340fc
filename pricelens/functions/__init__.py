"""functions of the catalog value-analytics library."""
