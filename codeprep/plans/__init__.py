"""Stage compositions and registered queries."""
