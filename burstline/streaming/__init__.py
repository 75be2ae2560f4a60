"""Day windows over a stream of messages."""
