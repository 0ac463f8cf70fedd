"""Tessera: media-identity mapping and tracking analytics as Spark programs."""
