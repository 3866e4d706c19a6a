"""Jobs made of several operators."""
