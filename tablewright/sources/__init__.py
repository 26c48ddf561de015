"""Tables, providers, sources and sinks."""
