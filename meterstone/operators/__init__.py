"""DataFrame operators: ordered log state, cubes, merges, pricing dimension, live state."""
