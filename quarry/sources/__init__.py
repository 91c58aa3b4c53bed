"""Front ends that fill the fact tables."""
