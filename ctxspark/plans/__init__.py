"""Physical helpers: sessions, written stages, exchange sizing."""
