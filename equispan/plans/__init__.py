"""Pipeline, adapters and registered queries."""
