"""Where files, repositories and symbols come from."""
