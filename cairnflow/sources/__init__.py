"""Readers: corpora of definitions, change events, and the driver tables seen as the engine's inputs."""
