"""Registered queries, their SQL, and the engine that runs a whole request."""
