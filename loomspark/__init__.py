"""loomspark: analytics over crawled pages, links and search results as Spark DataFrames."""
