"""functions of the note-corpus engine."""
