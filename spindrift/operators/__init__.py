"""DataFrame-to-DataFrame operators of the crawl and scrape engine."""
