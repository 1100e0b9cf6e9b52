"""A bitemporal analytics engine on Spark."""
