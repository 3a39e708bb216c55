"""DataFrame operators: similarity, entity resolution, gates, validation, publishing, search, increments."""
