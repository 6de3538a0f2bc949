"""operators of feedspark."""
