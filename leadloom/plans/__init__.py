"""Multi-step plans: discovery, crawl over a stored corpus, lead building."""
