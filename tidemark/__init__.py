"""Research-ready market, macro, calendar and news tables as Spark jobs."""
