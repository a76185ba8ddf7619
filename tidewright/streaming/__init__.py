"""Nothing is streamed: the operators of this library are all over finite tables."""
