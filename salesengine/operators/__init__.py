"""The metric modules, alerts, catalog changes and derived tables."""
