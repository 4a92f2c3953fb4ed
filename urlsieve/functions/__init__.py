"""urlsieve subpackage: see the README for the map of modules."""
