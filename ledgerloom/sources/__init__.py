"""Sources and the cache: spreadsheets, closing texts, slips over HTTP, scans."""
