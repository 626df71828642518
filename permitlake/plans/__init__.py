"""Reports and jobs of the permit registry."""
