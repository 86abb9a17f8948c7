"""lodestar: evidence retrieval and text analytics as DataFrame transformations."""
