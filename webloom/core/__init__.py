"""Session, scratch storage and shared schemas."""
