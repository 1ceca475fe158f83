"""Reports and batch jobs composed from the operators."""
