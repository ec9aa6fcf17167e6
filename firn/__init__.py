"""Hydro-climate analytics as Spark jobs: station series, regional outlooks, what-if runs."""
