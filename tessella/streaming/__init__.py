"""streaming of the note-corpus engine."""
