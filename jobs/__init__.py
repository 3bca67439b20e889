"""Runnable jobs: each is a function that takes a session and plain paths, with a command line and a small config file."""
