"""Tessera: claim-corroboration and corpus analytics as Spark DataFrame programs."""
