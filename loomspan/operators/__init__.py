"""DataFrame operators: matching, interval maps, offsets, statistics, catalogue."""
