"""Complete plans composed from the operators."""
