"""DataFrame operators of the question bank."""
