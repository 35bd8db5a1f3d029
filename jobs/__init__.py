"""Jobs that users of the library run: each is a function of a session, a command line and a small configuration file."""
