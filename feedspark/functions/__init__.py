"""functions of feedspark."""
