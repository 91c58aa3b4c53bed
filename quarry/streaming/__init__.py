"""The reload stream: relevant file changes, debounced into reloads."""
