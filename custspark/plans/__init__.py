"""Multi-operator plans and the catalogue of registered queries."""
