"""Analytics over tables of URLs, stored HTML, keywords, inspection records and motion samples."""
