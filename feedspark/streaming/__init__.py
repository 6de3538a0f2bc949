"""streaming of feedspark."""
