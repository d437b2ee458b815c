"""Messages, fitted parameters and the point archive."""
