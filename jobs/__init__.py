"""Jobs to run from a command line; each has its work in run(), which takes a session."""
