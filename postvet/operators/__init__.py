"""The jobs, one module per panel or page they serve."""
