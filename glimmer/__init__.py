"""Foreground concurrency for playback events: who is truly watching, per minute and dimension."""
