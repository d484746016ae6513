"""tidewatch: operations analytics (workforce, tickets, market signals) as Spark jobs."""
