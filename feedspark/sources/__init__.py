"""sources of feedspark."""
