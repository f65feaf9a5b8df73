"""Views over the given tables that the registered queries share."""
