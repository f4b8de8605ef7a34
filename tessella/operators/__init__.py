"""operators of the note-corpus engine."""
