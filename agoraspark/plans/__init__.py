"""The registered queries with their SQL counterparts, by theme."""
