"""Runnable jobs: each is a function of a session and a small configuration, and has a command line."""
