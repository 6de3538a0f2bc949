"""plans of feedspark."""
