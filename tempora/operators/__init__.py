"""Relational and temporal operators as DataFrame plans."""
