"""The operators that keep state over a stream: tasks, sessions, uploads."""
