"""sources of the note-corpus engine."""
